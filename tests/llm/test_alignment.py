import hashlib
import json
import random
from collections import Counter

import public_tokenizers as P
import pytest

from fieldloom.llm import alignment as al

FILES = (P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))


def brute(texts):
    """Tokens by the libraries, groups by sets of offsets, counts in a dictionary."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_of = Tokenizer.from_file(FILES[0])
    a_of.encode_special_tokens = True
    of = al.byte_characters()
    a_bytes = {i: bytes(of.get(c, 0) for c in p) for p, i in json.load(open(FILES[0], encoding="utf-8"))["model"]["vocab"].items()}
    b_of = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    rows, pairs = [], Counter()
    for t in texts:
        a, b = (a_of.encode(" " + t, add_special_tokens=False).ids, b_of.encode(t)) if t else ([], [])
        x, y = [a_bytes[i] for i in a], [al.piece_bytes(b_of.id_to_piece(i)) for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            rows.append(None)
            continue
        ends = lambda z: {len(b"".join(z[: k + 1])): k for k in range(len(z))}
        e, f = ends(x), ends(y)
        cuts = sorted(set(e) & set(f))
        links = [(a[e[c]], b[f[c]]) for c in cuts]
        pairs.update(links)
        said, i, j = [], 0, 0
        for c in cuts:
            said.append(",".join(map(str, a[i : e[c] + 1])) + "|" + ",".join(map(str, b[j : f[c] + 1])))
            i, j = e[c] + 1, f[c] + 1
        rows.append((len(a), len(b), links, ";".join(said)))
    top = Counter()
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, said = r
            out.append((n_a, n_b, len(links), len(links), sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(5)
    alphabet = "aabcdeé   \n\t'.,<|>0123ßñ日本😀▁\x1c\x85AB"
    words = ["the", "cat's", "über", "naïve", "<|endoftext|>", "<s>", "</s>", "<0x41>", "x" * 300, "1234567", "日本語", "--", "don't"]
    noise = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    return [None, "", " ", "  ", "\n", " a", "a ", " a  b ", "a\n\n b", "▁", "a▁b", *noise, *prose, prose[0], prose[0], "".join(rng.choice("abc") for _ in range(4_000)), "word " * 5_000]


@pytest.mark.parametrize("stripe_bytes", [al.STRIPE_BYTES, 4 << 20])
def test_against_brute_force(spark, monkeypatch, stripe_bytes):
    some = texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(some)], "doc_id long, text string, place long, stripe string").repartition(3)
    if stripe_bytes < al.STRIPE_BYTES:  # several slots a stripe, tasks that give their tallies out in between
        monkeypatch.setattr(al, "SLOT", 50)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in al.aligned(docs, *FILES, stripe_bytes=stripe_bytes).collect()}
    assert [got[i] for i in range(len(some))] == brute(some)


def test_memo_and_whole_texts_agree():
    with open(FILES[0], encoding="utf-8") as f, open(FILES[2], "rb") as g:
        aligner = al.Aligner(f.read(), FILES[1], g.read())
    assert aligner.cut
    some = [t for t in texts() if t]
    assert list(aligner.documents(some)) == [aligner.whole(t) for t in some]
    assert list(aligner.documents(some)) == [aligner.whole(t) for t in some]  # from the memo


def test_empty_and_nulls(spark):
    schema = "doc_id long, text string"
    assert al.aligned(spark.createDataFrame([], schema), *FILES).count() == 0
    rows = al.aligned(spark.createDataFrame([(None, "a b"), (None, None)], schema), *FILES).collect()
    assert sorted((r.n_a, r.groups_sha256 == "") for r in rows) == [(0, True), (2, False)]
