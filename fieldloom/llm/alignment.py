"""Alignment of two tokenizers over a corpus.

Tokenizer A is a byte-level BPE of the ``tokenizers`` JSON format, B a SentencePiece model; each token stands for bytes of a space
and the text. Byte offsets at which tokens of both end cut the text into groups; the A and the B token that end at such an
offset are a link. The count of an id pair is the number of its links in the whole corpus.

Counts are kept in dense matrices striped by id: B id b is row ``b // stripes`` of stripe ``b % stripes``, a stripe has
a column for each A id, and its memory is bounded by STRIPE_BYTES. Every task adds its links up by pair first, so a pair comes
from a task once however often it is linked; a stripe's task then adds these partial counts into its block with
``np.add.at`` and takes the row maxima, the best partners of its B ids. Links are scored where the counts of their stripe
are: links and counts are partitioned alike, by stripe and by a number of slots that follows the stripe's links (a B id may
hold a third of all links), and in each partition a stripe's counts come before its links. Only one block is in memory
at a time; links travel packed, by batches of documents, and scores come back the same way.

Neither tokenizer joins a character to the next over a single space between two characters that aren't white space, so texts
are cut there and workers keep a bounded memo of short pieces, ids aligned already. The memo and the cut only save time; a model
for which the cut isn't exact (its pieces hold inner spaces, or it normalises) is given whole texts.

Defined cases: null and empty texts, and texts whose tokens' bytes differ from space and text, have no tokens, zeros and an
empty digest; texts are read whole however long; repeated rows give a row each; a null identifier is kept; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.storage import cleared

from .common import bounded_batches, written

#: Bytes of a stripe's dense block of counts.
STRIPE_BYTES = 192 << 20
#: Pieces that each half of a worker's memo holds, and the characters of the longest one kept: about 180 MB in all.
MEMO, MEMO_CHARS = 250_000, 40
#: Distinct pairs that a task gathers before it gives them out, and links of documents that a slot of a stripe takes.
TALLY, SLOT = 2_000_000, 4_000_000


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def bpe_bytes(raw: str) -> dict[bytes, int]:
    """Bytes and id of each entry of a byte-level vocabulary, without special tokens. Ids must follow the order of merges."""
    model, of = json.loads(raw), byte_characters()
    special = {t["content"] for t in model["added_tokens"] if t["special"]}
    vocabulary = model["model"]["vocab"]
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids of the vocabulary must rise in the order of its merges")
    return {bytes(of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}


def piece_bytes(piece: str) -> bytes:
    """Bytes of a SentencePiece entry."""
    byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """A text cut at single spaces between characters that aren't white space; what stands for its first space is left out of each piece."""
    plain = text.split(" ")
    return plain if plain == text.split() else _CUT.split(text)


class _Words(dict):
    """What is written for a token: 4 id (+ 1 if it ends its group) for A, 4 id + 2 (+ 1) for B, -1 - id for the last B of a text."""

    def __missing__(self, word: int) -> str:
        id_, kind = (-1 - word, 4) if word < 0 else divmod(word, 4)
        out = self[word] = f"{id_}{',|,;\n'[kind]}"
        return out


class Aligner:
    """Both tokenizers in one worker."""

    def __init__(self, bpe: str, pattern: str, model: bytes):
        import sentencepiece
        import tiktoken

        ranks = bpe_bytes(bpe)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_bytes = {i: x for x, i in ranks.items()}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in names]
        self.n_a, self.n_b = max(self.a_bytes) + 1, len(names)
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(self.n_a)])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.words = _Words()
        probe = "  a \tﬁ "
        self.cut = self.b.normalize(probe) == ("▁" + probe).replace(" ", "▁") and not any(re.search("[^▁]▁", p) for p in names)
        self.memo, self.older = {}, {}

    def groups(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> list[tuple[int, int, str, bytes] | None]:
        """n_a, n_b, the groups and the links' codes of each text, which starts with its space; None where bytes differ."""
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        whole = "".join(texts).encode()
        if b"".join(map(self.a_bytes.__getitem__, flat_a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, flat_b.tolist())) != whole:
            return [self.groups([t], [x], [y])[0] for t, x, y in zip(texts, a, b)] if len(texts) > 1 else [None]
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        end_text = end_a[np.cumsum([len(x) for x in a]) - 1]
        if not np.array_equal(end_text, np.cumsum([len(t.encode()) for t in texts])) or not np.array_equal(end_text, end_b[np.cumsum([len(x) for x in b]) - 1]):
            return [self.groups([t], [x], [y])[0] for t, x, y in zip(texts, a, b)]
        ends = np.zeros(len(whole) + 1, np.int8)
        ends[end_a] += 1
        ends[end_b] += 1
        last_a, last_b = ends[end_a] == 2, ends[end_b] == 2
        # a token's place: those of its own side before it, and those of the other side in the groups before its own or up to it
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(flat_a)) + (np.cumsum(size_b) - size_b)[group_a]
        at_b = np.arange(len(flat_b)) + np.cumsum(size_a)[group_b]
        word = np.empty(len(flat_a) + len(flat_b), np.int64)
        word[at_a] = 4 * flat_a + last_a
        word[at_b] = 4 * flat_b + 2 + last_b
        links = flat_b[last_b] * self.n_a + flat_a[last_a]
        closes = np.isin(end_b, end_text, assume_unique=True)
        word[at_b[closes]] = -1 - flat_b[closes]
        strings = "".join(map(self.words.__getitem__, word.tolist())).split("\n")
        cuts = [0, *(8 * np.searchsorted(end_b[last_b], end_text, "right")).tolist()]
        raw = links.tobytes()
        return [(len(x), len(y), g, raw[i:j]) for x, y, g, i, j in zip(a, b, strings, cuts, cuts[1:])]

    def whole(self, text: str) -> tuple[int, int, str, bytes] | None:
        return self.groups([" " + text], [self.a.encode_ordinary(" " + text)], [self.b.encode(text)])[0]

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, bytes] | None]:
        """n_a, n_b, groups and links of each text; None for one without tokens."""
        if not self.cut:
            yield from (self.whole(t) if t else None for t in texts)
            return
        cut = [pieces(t) if t else [] for t in texts]
        memo, older, long = self.memo, self.older, {}
        asked = set().union(*cut).difference(memo)
        memo |= {p: older[p] for p in asked.intersection(older)}
        new = list(asked.difference(memo))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            spaced = [" " + p for p in some]
            found = self.groups(spaced, [*map(self.a.encode_ordinary, spaced)], self.b.encode(some, num_threads=1))
            for p, groups in zip(some, found):
                (memo if len(p) <= MEMO_CHARS else long)[p] = groups
        found = memo | long if long else memo
        for t, c in zip(texts, cut):
            if not c:
                yield None
                continue
            parts = list(map(found.__getitem__, c))
            if None in parts:  # its bytes may still agree as a whole
                yield self.whole(t)
            else:
                n_a, n_b, groups, codes = zip(*parts)
                yield sum(n_a), sum(n_b), ";".join(groups), b"".join(codes)
        if len(memo) >= MEMO:
            self.memo, self.older = {}, dict(islice(memo.items(), len(memo) - MEMO, None))


_ALIGNERS: dict[str, Aligner] = {}


def aligner_of(bpe: str, pattern: str, model: bytes) -> Aligner:
    """This process's aligner, made once."""
    key = hashlib.sha256(b"\0".join((bpe.encode(), pattern.encode(), model))).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(bpe, pattern, model)
    return _ALIGNERS[key]


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and their sums."""
    codes, at = np.unique(codes, return_inverse=True)
    return codes, np.bincount(at, counts, len(codes)).astype(np.int64)


class Stripes:
    """How B ids are dealt into dense blocks."""

    def __init__(self, n_a: int, n_b: int, most: int = STRIPE_BYTES):
        self.n_a, self.n_b = n_a, n_b
        self.n = max(1, -(-n_a * n_b * 8 // most))
        self.rows = -(-n_b // self.n)

    def of(self, codes: np.ndarray) -> np.ndarray:
        return codes // self.n_a % self.n

    def place(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column in the stripe's block."""
        return codes // self.n_a // self.n, codes % self.n_a

    def cut(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each stripe among the codes and the positions of its codes, in their order."""
        stripe = self.of(codes)
        order = np.argsort(stripe, kind="stable")
        starts = np.flatnonzero(np.diff(stripe[order], prepend=-1))
        for k, some in zip(stripe[order][starts].tolist(), np.split(order, starts[1:])):
            yield k, some


def _codes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


_KINDS = {"long": (T.LongType(), pa.int64()), "int": (T.IntegerType(), pa.int32()), "binary": (T.BinaryType(), pa.binary()), "string": (T.StringType(), pa.string())}


def _schema(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind][0]) for name, kind in (c.split() for c in columns.split(", "))])


def _rows(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = dict(_KINDS.values())
    columns = zip(*rows) if rows else [()] * len(schema.fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for f, c in zip(schema.fields, columns)], schema.names)


_DOCS = _schema("place long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary")
_TALLY = _schema("stripe int, codes binary, counts binary, entries long")
_LINKS = _schema("stripe int, slot int, kind int, batch long, docs binary, sizes binary, codes binary, counts binary")
_SCORES = _schema("batch long, docs binary, best binary, total binary")
_SUMS = _schema("place long, n_best long, count_sum long")


def _tallied(docs: DataFrame, stripes: Stripes) -> DataFrame:
    """Each task's links by pair, packed by stripe; ``entries``: how many (document, pair) there are."""

    def give(codes: np.ndarray, counts: np.ndarray, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, some in stripes.cut(codes):
            for i in range(0, len(some), 1 << 17):
                part = some[i : i + (1 << 17)]
                yield _rows(_TALLY, [(k, codes[part].tobytes(), counts[part].tobytes(), int(entries[part].sum()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        kept = (none, none, none)
        for b in batches:
            codes = _codes(b"".join(b.column("codes").to_pylist()))
            times = _codes(b"".join(b.column("times").to_pylist()))
            joined = np.concatenate([kept[0], codes])
            some, counts = summed(joined, np.concatenate([kept[1], times]))
            _, entries = summed(joined, np.concatenate([kept[2], np.ones(len(codes), np.int64)]))
            kept = (some, counts, entries)
            if len(some) >= TALLY:
                yield from give(*kept)
                kept = (none, none, none)
        yield from give(*kept)

    return docs.select("codes", "times").mapInArrow(scan, _TALLY)


def _blocks(tallies: DataFrame, stripes: Stripes) -> DataFrame:
    """The corpus's counts by stripe, added in a dense block, packed with the B ids' row maxima left to whoever reads them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, entries = None, None, 0

        def give() -> Iterator[pa.RecordBatch]:
            row, column = np.nonzero(block)
            codes, counts = (row * stripes.n + now) * stripes.n_a + column, block[row, column]
            for i in range(0, len(codes), 1 << 17):
                yield _rows(_TALLY, [(now, codes[i : i + (1 << 17)].tobytes(), counts[i : i + (1 << 17)].tobytes(), entries if i == 0 else 0)])

        for b in batches:
            for stripe, codes, counts, n in zip(*(b.column(c).to_pylist() for c in _TALLY.names)):
                if stripe != now:
                    if now is not None:
                        yield from give()
                    block = None
                    block, now, entries = np.zeros((stripes.rows, stripes.n_a), np.int64), stripe, 0
                np.add.at(block, stripes.place(_codes(codes)), _codes(counts))
                entries += n
        if now is not None:
            yield from give()

    return tallies.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(add, _TALLY)


def _links(docs: DataFrame, stripes: Stripes, slots: list[int]) -> DataFrame:
    """Links of documents, packed by stripe for each batch of documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in enumerate(batches):
            batch = TaskContext.get().partitionId() << 32 | number
            codes = [_codes(x) for x in b.column("codes").to_pylist()]
            if not sum(map(len, codes)):
                continue
            owner = np.repeat(b.column("place").to_numpy(), [len(c) for c in codes])
            flat, times = np.concatenate(codes), _codes(b"".join(b.column("times").to_pylist()))
            rows = []
            for k, some in stripes.cut(flat):
                mine = owner[some]
                starts = np.flatnonzero(np.diff(mine, prepend=-1))
                sizes = np.diff(starts, append=len(mine))
                rows.append((k, (batch * 2_654_435_761 >> 7) % slots[k], 1, batch, mine[starts].tobytes(), sizes.astype("<i8").tobytes(), flat[some].tobytes(), times[some].tobytes()))
            yield _rows(_LINKS, rows)

    return docs.select("place", "codes", "times").mapInArrow(scan, _LINKS)


def _scored(links: DataFrame, stripes: Stripes) -> DataFrame:
    """For each batch and stripe, the documents' links that are best and the sums of counts; counts (kind 0) come first."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, top, now = None, None, None
        for b in batches:
            rows = []
            for stripe, _, kind, batch, docs, sizes, codes, counts in zip(*(b.column(c).to_pylist() for c in _LINKS.names)):
                if stripe != now:
                    block = None
                    block, top, now = np.zeros((stripes.rows, stripes.n_a), np.int64), None, stripe
                place = stripes.place(_codes(codes))
                if kind == 0:
                    block[place] = _codes(counts)
                    top = None
                    continue
                if top is None:
                    top = block.max(axis=1)
                times, count = _codes(counts), block[place]
                starts = np.cumsum(_codes(sizes)) - _codes(sizes)
                best = np.add.reduceat(times * (count == top[place[0]]), starts)
                rows.append((batch, docs, best.tobytes(), np.add.reduceat(times * count, starts).tobytes()))
            yield _rows(_SCORES, rows)

    return links.repartition("stripe", "slot").sortWithinPartitions("stripe", "slot", "kind").mapInArrow(score, _SCORES)


def _summed(scores: DataFrame) -> DataFrame:
    """The documents' sums over stripes; a batch's documents meet in one task, packed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def give() -> pa.RecordBatch:
            places, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = []
            for i in (1, 2):
                total = np.zeros(len(places), np.int64)
                np.add.at(total, at, np.concatenate([p[i] for p in parts]))
                sums.append(pa.array(total))
            return pa.RecordBatch.from_arrays([pa.array(places), *sums], _SUMS.names)

        for b in batches:
            for batch, *arrays in zip(*(b.column(c).to_pylist() for c in _SCORES.names)):
                if batch != now and parts:
                    yield give()
                    parts = []
                now = batch
                parts.append([_codes(x) for x in arrays])
        if parts:
            yield give()

    return scores.repartition("batch").sortWithinPartitions("batch").mapInArrow(add, _SUMS)


def aligned(docs: DataFrame, bpe_path: str, pattern: str, model_path: str, doc_id: str = "doc_id", text: str = "text", stripe_bytes: int = STRIPE_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best``: links whose count is the highest of their B id, ties included; ``count_sum``: the counts of all links.
    Vocabularies are files on the driver, of fixed size, and are broadcast once.
    """
    spark = docs.sparkSession
    with open(bpe_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        files = (f.read(), pattern, g.read())
    shared = spark.sparkContext.broadcast(files)
    known = Aligner(*files)
    stripes = Stripes(known.n_a, known.n_b, stripe_bytes)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([own.schema["doc_id"], *_DOCS.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, at = aligner_of(*shared.value), TaskContext.get().partitionId() << 40
        gc.disable()  # the memo's values make no cycles, and walking them takes a third of the time
        for b in batches:
            rows = []
            for found in aligner.documents(b.column("text").to_pylist()):
                if found is None:
                    rows.append((at, 0, 0, 0, 0, "", b"", b""))
                else:
                    n_a, n_b, groups, links = found
                    codes, times = np.unique(_codes(links), return_counts=True)
                    n = len(links) // 8
                    rows.append((at, n_a, n_b, n, n, hashlib.sha256(groups.encode()).hexdigest(), codes.tobytes(), times.astype("<i8").tobytes()))
                at += 1
            done = _rows(_DOCS, rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *done.columns], schema.names)
        gc.enable()

    bounded_batches(spark)
    with cleared(spark) as keep:
        found = written(own.mapInArrow(scan, schema), "align-docs")
        counts = written(_blocks(_tallied(found, stripes), stripes), "align-counts")
        entries = {r["stripe"]: r["n"] for r in counts.groupBy("stripe").agg(F.sum("entries").alias("n")).collect()}  # a row for each stripe
        slots = [max(1, -(-entries.get(k, 0) // SLOT)) for k in range(stripes.n)]
        many = F.array(*[F.lit(n) for n in slots])[F.col("stripe")]
        table = counts.withColumn("slot", F.explode(F.sequence(F.lit(0), many - 1)))
        none = F.lit(None).cast("binary")
        table = table.select("stripe", "slot", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("batch"), none.alias("docs"), none.alias("sizes"), "codes", "counts")
        scores = written(_scored(_links(found, stripes, slots).unionByName(table), stripes), "align-scores")
        sums = _summed(scores)
        both = found.drop("codes", "times").join(sums, "place", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return keep(both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), "aligned")
