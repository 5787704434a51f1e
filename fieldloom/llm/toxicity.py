"""Toxicity: a counterfactual-regularised hashed linear classifier.

A text's features are its distinct words and their leading letters, hashed. In every sentence of a training text that
names an identity term, the term is swapped for another of its set; the change of the score between the sentence and
its twin is penalised, so that the mere mention of a group doesn't move it. The sets are a parameter (IDENTITIES has some
in four languages). As corpora name groups by words that no list has, further terms are derived from the labelled
rows: frequent words that toxic and other rows use about equally, and which thus name what is talked about.

It is fitted on a bounded sample of labelled rows: at most TRAIN_ROWS of each label, those with the smallest hash
of their identifier, and at most MAX_FEATURES features, chosen by the likelihood ratio of their presence. Rows
whose crc32 of the identifier leaves remainder 1 by 3 are held out. Every text is scored whole.

Defined cases: null and empty texts have no features and get the score of the bias; a null identifier is the text
"" for the hold-out; repeated labels of a document count as toxic if one is; of labelled documents with equal identifiers
the one with the smallest hash of its text trains; repeated texts get equal scores; with no usable labels every score is
0.5; an empty table gives no row; a long text is scored by all its words; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from .common import bounded_batches, written

#: Bounds of the training sample (rows of each label) and of the model.
TRAIN_ROWS, MAX_FEATURES, HASH_BITS = 4_000, 4_096, 22
PREFIXES = (4, 5)
#: Tokens that a batch's memo holds; it only saves time.
MEMO = 300_000
L2, PAIR_PENALTY, THRESHOLD = 2e-5, 0.5, 0.7
MIN_ROWS, MIN_RATIO = 4, 12.0
#: Derived terms: how many at most, the least share of toxic and of other rows that have one, and how much the shares may differ.
DERIVED, DERIVED_SHARE, DERIVED_RATIO = 64, 0.02, 1.25
#: Sets of identity terms that may stand for one another; the last of a set is neutral and isn't looked for.
IDENTITIES = (
    ("women", "men", "girls", "boys", "people"), ("woman", "man", "girl", "boy", "person"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "people"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "local"),
    ("black", "white", "asian", "latino", "arab", "local"), ("gay", "straight", "lesbian", "bisexual", "transgender", "young"),
    ("immigrants", "foreigners", "refugees", "citizens"), ("old", "disabled", "deaf", "blind", "tall"),
    ("frauen", "männer", "mädchen", "jungen", "leute"), ("christen", "muslime", "juden", "atheisten", "leute"), ("ausländer", "flüchtlinge", "einwanderer", "bürger"),
    ("femmes", "hommes", "filles", "garçons", "gens"), ("chrétiens", "musulmans", "juifs", "athées", "gens"), ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "chicas", "chicos", "personas"), ("cristianos", "musulmanes", "judíos", "ateos", "personas"), ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def word_features(token: str) -> tuple[int, ...]:
    """Hashed features of one token: the word without outer punctuation, and its leading letters."""
    word = token.strip(_STRIP)
    if not word:
        return ()
    mask = (1 << HASH_BITS) - 1
    found = [zlib.crc32(b"w:" + word.encode()) & mask]
    return (*found, *(zlib.crc32(f"p{n}:{word[:n]}".encode()) & mask for n in PREFIXES if len(word) > n))


def features(text: str | None) -> set[int]:
    found: set[int] = set()
    for token in set((text or "").lower().split()):
        found.update(word_features(token))
    return found


def swaps(groups: tuple[tuple[str, ...], ...], derived: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Each identity term with what it may be swapped for."""
    found = {term: [t for t in group if t != term] for group in groups for term in group[:-1]}
    return found | {t: [x for x in derived if x != t] for t in derived if t not in found and len(derived) > 1}


def twins(text: str | None, terms: dict[str, list[str]]) -> list[tuple[set[int], set[int]]]:
    """For each sentence and identity term in it: the features that go and those that come when the term is swapped."""
    found: dict[tuple[str, str], tuple[set[int], set[int]]] = {}
    for sentence in _SENTENCE.split((text or "").lower()):
        words = {t.strip(_STRIP) for t in sentence.split()}
        for w in sorted(words & terms.keys()):
            other = [t for t in terms[w] if t not in words]
            if other:
                twin = other[zlib.crc32(sentence.encode()) % len(other)]
                if (w, twin) not in found:
                    gone, come = set(word_features(w)), set(word_features(twin))
                    found[w, twin] = (gone - come, come - gone)
    return [found[k] for k in sorted(found)]


def _packed(terms: dict[str, list[str]]):
    @F.arrow_udf(T.BinaryType())
    def packed(texts: pa.Array) -> pa.Array:
        """Features of each text, then what goes and what comes with each of its twins, as one run of 32-bit numbers: count, features, count, ..."""
        out = []
        for x in texts:
            parts = [features(x.as_py()), *(s for pair in twins(x.as_py(), terms) for s in pair)]
            out.append(b"".join(np.array([len(p), *sorted(p)], "<u4").tobytes() for p in parts))
        return pa.array(out, pa.binary())

    return packed


def derived_terms(sample: DataFrame, most: int = DERIVED) -> tuple[str, ...]:
    """Frequent words of a labelled sample (toxic, text) that toxic and other rows use about equally, most frequent first."""
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))).alias("word")).where("length(word) > 1")
    total = sample.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    if not total["toxic"] or total["toxic"] == total["n"]:
        return ()
    counts = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    one, two = F.col("toxic") / total["toxic"], (F.col("n") - F.col("toxic")) / (total["n"] - total["toxic"])
    kept = counts.where((F.least(one, two) >= DERIVED_SHARE) & (F.greatest(one, two) <= DERIVED_RATIO * F.least(one, two)))
    return tuple(r["word"] for r in kept.orderBy(F.desc("n"), "word").limit(most).collect())


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


class _Known(dict):
    """Token to those of its features that have a weight, bounded."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        found = self[token] = tuple(f for f in word_features(token) if f in self.weights)
        return found


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    #: Counterfactual twins that the fit penalised, and the identity terms that were looked for.
    n_twins: int = 0
    terms: tuple[str, ...] = ()

    def score(self, text: Column) -> Column:
        """Probability of toxicity of each whole text."""
        weights, bias = self.weights, self.bias

        @F.arrow_udf(T.DoubleType())
        def score(texts: pa.Array) -> pa.Array:
            memo = _Known(weights)
            out = []
            for x in texts:
                tokens = set((x.as_py() or "").lower().split())
                found = set().union(*filter(None, map(memo.__getitem__, tokens)))
                out.append(bias + sum(weights[f] for f in sorted(found)))
            return pa.array(linear.sigmoid(np.array(out, float)), pa.float64())

        return score(text)


def _unpacked(packed: bytes) -> Iterator[np.ndarray]:
    """The runs of 32-bit numbers of a text."""
    a, at = np.frombuffer(packed, "<u4"), 0
    while at < len(a):
        n = int(a[at])
        yield a[at + 1 : at + 1 + n]
        at += 1 + n


def fit_rows(rows: Iterable[Iterable[np.ndarray]], y: np.ndarray, pair_penalty: float = PAIR_PENALTY) -> Model:
    """A model from each row's features, followed by what goes and what comes with each of its twins.

    Rows are gone through once: of a twin only its number is kept, so the driver holds each row's features, in 32 bits, and the distinct twins.
    """
    if len(y) == 0 or y.min() == y.max():
        return Model({}, 0.0)
    own, times = [], Counter()
    for r in rows:
        runs = iter(r)
        own.append(np.array(next(runs), np.uint32))
        times.update((gone.astype(np.uint32).tobytes(), come.astype(np.uint32).tobytes()) for gone, come in zip(runs, runs))
    counted = [np.unique(np.concatenate([x for x, label in zip(own, y) if label == one] or [np.empty(0, np.uint32)]), return_counts=True) for one in (0, 1)]
    ids = np.union1d(counted[0][0], counted[1][0])
    neg, pos = np.zeros(len(ids)), np.zeros(len(ids))
    for into, (seen, count) in zip((neg, pos), counted):
        into[np.searchsorted(ids, seen)] = count
    n1, n, df = float(y.sum()), len(y), neg + pos
    ratio = np.zeros(len(ids))
    for seen, expected in ((pos, df * n1 / n), (df - pos, df * (n - n1) / n), (n1 - pos, (n - df) * n1 / n), (n - n1 - df + pos, (n - df) * (n - n1) / n)):
        ratio += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)
    good = np.flatnonzero((df >= MIN_ROWS) & (ratio >= MIN_RATIO))
    good = good[np.lexsort((ids[good], -ratio[good]))][:MAX_FEATURES]
    swapped = [np.frombuffer(s, np.uint32) for pair in times for s in pair]
    chosen = np.unique(np.concatenate([ids[good], *swapped])).astype(np.uint32)

    def kept(a: np.ndarray) -> np.ndarray:
        at = np.searchsorted(chosen, a)
        at[at == len(chosen)] = 0
        return at[chosen[at] == a] if len(chosen) else at[:0]

    x = linear.Rows([kept(r) for r in own], None, len(chosen))
    # equal twins once, with the root of their number as weight
    total, diffs, signs = sum(times.values()), [], []
    for (gone, come), n_equal in sorted(times.items()):
        gone, come = kept(np.frombuffer(gone, np.uint32)), kept(np.frombuffer(come, np.uint32))
        diffs.append(np.concatenate([gone, come]))
        signs.append(np.concatenate([np.ones(len(gone)), -np.ones(len(come))]) * (n_equal * len(times) / total) ** 0.5)
    w, b = linear.fit(x, y, L2, pairs=linear.Rows(diffs, signs, len(chosen)), pair_penalty=pair_penalty)
    return Model({int(f): float(v) for f, v in zip(chosen, w) if v}, b, total)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, pair_penalty: float = PAIR_PENALTY, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> Model:
    """Fit on a bounded sample of ``documents`` (doc_id, text) with ``labels`` (doc_id, toxic), held-out rows excluded."""
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = first(0).unionByName(first(1))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * rows narrow rows
    texts = texts.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = written(texts, "toxic-sample")
    derived = derived_terms(texts)
    terms = swaps(identities, derived)
    packed = written(texts.select("doc_id", "toxic", _packed(terms)("text").alias("packed")), "toxic-features")
    # at most 2 * rows rows, a partition at a time
    got = [(r["toxic"], bytes(r["packed"])) for r in packed.orderBy("doc_id").toLocalIterator()]
    model = fit_rows((_unpacked(x) for _, x in got), np.array([toxic for toxic, _ in got], float), pair_penalty)
    model.terms = tuple(terms)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score and predicted."""
    score = train(docs, labels).score(F.col("text"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
