"""Quality classifier: a weak-label model trains a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or abstain on every document; each kind of fault is looked for by two or
more of them, and some (short, one line) are poor on purpose. Expectation-maximisation estimates the accuracies of the
labellers (how often each votes what, for good and for bad documents) and the share of good ones from the counts of
all vote patterns, of which there is a bounded number however large the corpus. An abstention tells nothing of the
class. The estimate starts from how rare a document's bad votes are, no labeller is trusted beforehand, and nothing is clamped; a
Dirichlet prior of PRIOR_SHARE of the documents says that labellers call few good documents bad (PRIOR).

The posterior of a document's pattern then is its training label: a linear scorer over hashed features of the text is
fitted to a bounded sample of TRAIN_ROWS documents, those with the smallest hash of identifier and text. No given
label is used.

Defined cases: null and empty texts get abstentions only and no features, and so the score of the bias; ties and
repeated rows get equal scores; a long text is measured whole; an empty table gives no row and a model that scores 0.5;
other columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from .common import bounded_batches

TRAIN_ROWS, WIDTH, L2, KEEP_FROM = 8_000, 2_048, 1e-5, 0.5
LABELLERS = ("symbols", "odd_words", "bars", "bar_lines", "capitals", "marks", "variety", "stutter", "pairs", "same_lines", "ends", "length", "short", "one_line")
GOOD, BAD, ABSTAIN = 2, 1, 0
#: Prior shares of votes (abstain, bad, good) for bad and for good documents, and the weight of the prior: so much of the
#: number of documents, PRIOR_LEAST at least.
PRIOR, PRIOR_SHARE, PRIOR_LEAST = ((0.2, 0.2, 0.6), (0.28, 0.02, 0.7)), 0.03, 3.0
#: The estimate's start: a document is likely bad if its bad votes are so rare together (sum of -log of their shares).
SURPRISE = 5.0
_SIGNS = frozenset("#$%&*+/<=>@[\\]^_`{}~")
_CLASS = np.full(256, 9, np.uint16)  # the rest of ASCII
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:'\"?-()", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~")):
    _CLASS[np.frombuffer(_set, np.uint8)] = _i
_CLASS[128:192], _CLASS[192:] = 10, 11
_KINDS = 12
_BUCKET = np.array([zlib.crc32(b"c:%d" % c) % WIDTH for c in range(_KINDS**3)])


def measures(text: str) -> dict[str, float]:
    """Figures of a non-empty text."""
    raw = np.bincount(_CLASS[np.frombuffer(text.encode(), np.uint8)], minlength=_KINDS)
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, raw[0] + raw[1])
    return {
        "words": len(words), "chars": len(text), "lines": len(lines),
        "symbols": raw[8] / max(1, raw.sum()), "capitals": raw[1] / letters, "separators": raw[7] / n, "marks": raw[6] / n,
        "variety": len(set(words)) / n, "stutter": sum(map(str.__eq__, words, words[1:])) / n,
        "ends": sum(w[-1] in ".!?" for w in words) / n, "same_lines": 1 - len(set(lines)) / max(1, len(lines)), "length": len(text) / n,
        "odd_words": sum(w[-1] in _SIGNS for w in words) / n, "bar_lines": sum("|" in x for x in lines) / max(1, len(lines)), "pairs": 1 - len(set(zip(words, words[1:]))) / max(1, n - 1),
    }


def votes(text: str | None) -> tuple[int, ...]:
    """A vote of each of LABELLERS."""
    if not text or not text.split():
        return (ABSTAIN,) * len(LABELLERS)
    m = measures(text)
    pick = lambda bad, good: BAD if bad else GOOD if good else ABSTAIN
    words, lines = m["words"], m["lines"]
    enough = words >= 15
    return (
        pick(m["symbols"] > 0.04, m["symbols"] < 0.01),
        pick(words >= 8 and m["odd_words"] > 0.1, m["odd_words"] < 0.02),
        pick(m["separators"] > 0.1, m["separators"] == 0),
        pick(m["bar_lines"] > 0.3, m["bar_lines"] == 0),
        pick(words >= 4 and m["capitals"] > 0.4, m["capitals"] < 0.15),
        pick(m["marks"] > 0.2, m["marks"] == 0),
        pick(enough and m["variety"] < 0.2, enough and m["variety"] > 0.4),
        pick(enough and m["stutter"] > 0.1, enough and m["stutter"] < 0.03),
        pick(enough and m["pairs"] > 0.5, enough and m["pairs"] < 0.2),
        pick(lines >= 3 and m["same_lines"] > 0.4, lines >= 3 and m["same_lines"] < 0.1),
        pick(words >= 30 and m["ends"] < 0.02, 0.03 <= m["ends"] <= 0.35),
        pick(enough and not 5.2 <= m["length"] <= 7.1, enough and 5.6 <= m["length"] <= 6.4),
        pick(words < 30, words >= 60),
        pick(lines < 2, lines >= 4),
    )


def features(text: str | None) -> np.ndarray:
    """Hashed features: square roots of the shares of character-class trigrams, and indicators of the figures."""
    out = np.zeros(WIDTH, np.float32)
    if not text or not text.split():
        return out
    c = _CLASS[np.frombuffer(text.encode(), np.uint8)].astype(np.int32)
    if len(c) >= 3:
        counts = np.bincount(c[:-2] * (_KINDS * _KINDS) + c[1:-1] * _KINDS + c[2:], minlength=_KINDS**3)
        np.add.at(out, _BUCKET, np.sqrt(counts / counts.sum()))
    m = measures(text)
    for name in ("symbols", "capitals", "separators", "marks", "variety", "stutter", "ends", "same_lines", "odd_words", "pairs"):
        out[zlib.crc32(f"{name}:{int(min(1.0, m[name]) * 10)}".encode()) % WIDTH] += 0.5
    return out


@F.arrow_udf(T.IntegerType())
def _pattern(texts: pa.Array) -> pa.Array:
    return pa.array((int("".join(map(str, votes(x.as_py()))), 3) for x in texts), pa.int32())


def _sparse(x: np.ndarray) -> bytes:
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


@F.arrow_udf(T.BinaryType())
def _features(texts: pa.Array) -> pa.Array:
    """Places and values of the features that aren't 0, six bytes each."""
    return pa.array((_sparse(features(x.as_py())) for x in texts), pa.binary())


def unpacked(pattern: int) -> list[int]:
    return [pattern // 3**i % 3 for i in range(len(LABELLERS) - 1, -1, -1)]


def label_model(counts: dict[int, int], rounds: int = 300) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good for each vote pattern, P(vote | class) of each labeller, and the share of good documents.

    Expectation-maximisation to convergence; ``table[k, y, vote]`` is labeller k's share of ``vote`` in class y (1: good).
    """
    patterns = sorted(counts)
    v = np.array([unpacked(p) for p in patterns], int).reshape(len(patterns), len(LABELLERS))
    n = np.array([counts[p] for p in patterns], float)
    cast = np.stack([(v == vote).astype(float) for vote in (ABSTAIN, BAD, GOOD)], axis=2)
    rate = np.tensordot(n, cast[:, :, BAD], 1) / max(1.0, n.sum())
    surprise = cast[:, :, BAD] @ -np.log(np.maximum(rate, 1e-9))
    post = np.select([surprise >= SURPRISE, surprise >= SURPRISE / 2], [0.05, 0.5], 0.95)
    prior = np.array(PRIOR) * max(PRIOR_LEAST, PRIOR_SHARE * n.sum())
    table, share = np.empty((len(LABELLERS), 2, 3)), 0.5
    for _ in range(rounds):
        share = ((n * post).sum() + 1) / (n.sum() + 2)
        for y, p in ((0, 1 - post), (1, post)):
            table[:, y] = np.tensordot(n * p, cast, 1) + prior[y]
        table /= table.sum(2, keepdims=True)
        lift = np.log(table[:, 1]) - np.log(table[:, 0])
        lift[:, ABSTAIN] = 0
        was, post = post, linear.sigmoid(np.log(share / (1 - share)) + np.tensordot(cast, lift, 2))
        if not len(post) or np.abs(post - was).max() < 1e-9:
            break
    return dict(zip(patterns, post.tolist())), table, float(share)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: What the label model estimated: P(vote | class) of each labeller, the share of good documents, and the share of
    #: documents whose label differs from the rule that one bad vote makes a bad document.
    accuracies: np.ndarray
    good_share: float = 0.5
    off_rule: float = 0.0

    def score(self, text: Column) -> Column:
        """Probability that a text is good."""
        weights, bias = self.weights, self.bias

        @F.arrow_udf(T.DoubleType())
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(linear.sigmoid(np.array([float(features(x.as_py()) @ weights) + bias for x in texts], float)), pa.float64())

        return score(text)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """The label model over all documents, and the scorer on a bounded sample of them."""
    bounded_batches(docs.sparkSession)
    seen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    patterns = seen.select(_pattern("text").alias("pattern")).groupBy("pattern").count()
    counts = {r["pattern"]: r["count"] for r in patterns.collect()}  # at most a row for each possible pattern
    posterior, accuracies, share = label_model(counts)
    off = sum(n for p, n in counts.items() if (posterior[p] >= 0.5) == (BAD in unpacked(p))) / max(1, sum(counts.values()))
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    # one row of each hash, so that copies of a row don't fill the sample; the hashes first, so that no text is sorted
    first = seen.select(order.alias("place")).distinct().orderBy("place").limit(rows)
    last = first.agg(F.max("place")).first()[0]
    if last is None:
        return Model(np.zeros(WIDTH), 0.0, accuracies)
    sample = seen.select(order.alias("place"), _pattern("text").alias("pattern"), "text").where(F.col("place") <= last)
    got = sample.dropDuplicates(["place"]).select("place", "pattern", _features("text").alias("x")).orderBy("place").collect()  # at most ``rows`` rows
    size = np.array([len(r["x"]) // 6 for r in got], int)
    sparse = linear.Rows([], None, WIDTH)
    sparse.n, sparse.row = len(got), np.repeat(np.arange(len(got)), size)
    sparse.column = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["x"], "<u2", n) for r, n in zip(got, size.tolist()))]).astype(np.int64)
    sparse.value = np.concatenate([np.empty(0), *(np.frombuffer(r["x"], "<f4", n, 2 * n) for r, n in zip(got, size.tolist()))]).astype(float)
    target = np.array([posterior[r["pattern"]] for r in got])
    del got
    w, b = linear.fit(sparse, target, L2, steps=250)
    return Model(w, b, accuracies, share, off)


def scored(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, score and kept (the score is at least KEEP_FROM)."""
    out = docs.select("doc_id", train(docs).score(F.col("text")).alias("score"))
    return out.withColumn("kept", F.col("score") >= KEEP_FROM)


def without_bad(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    return docs.where(train(docs, doc_id, text).score(F.col(f"`{text}`")) >= KEEP_FROM)
