"""Near-duplicates by SetSketch registers.

A document is the set of its distinct k-word shingles. Documents with equal sets become one set, so copies cost
nothing further. Each set gets REGISTERS registers: the minimum of a seeded hash over its shingles, taken as an
exponential variable and truncated on an exponential scale of base ``BASE``; registers of a union are the larger
registers, and two sets agree in a register with about their Jaccard similarity. Bands of ROWS registers are hashed;
a bucket's sets are candidates. At the threshold of 0.8 a pair shares no bucket with a probability of 1e-7.

No bucket is expanded into its pairs. Every member is compared with the bucket's leader (its smallest set), the
links found are made components, and only buckets that still hold several components are looked at again: for TURNS
rounds with another leader each; then the members outside a bucket's largest component, the strays, are compared with
everything that may be linked with them: sets are packed into blocks of bounded size, an exact prefix filter over rare
shingles says which blocks may hold a link, and two blocks are compared inside one task, which gives back one link for
each pair of components. So no row is ever made for a pair that isn't a link, and no link across components is left out.

Candidates of leaders are estimated by the joint likelihood of the registers, given both set sizes; a pair more than six
standard deviations below the threshold goes. The rest are verified on the full sets, computed from whole texts. A
shingle stands in its set as a 64-bit hash of its words: sizes and links are exact but for collisions of that hash
within one document or pair, about 1e-14 for texts of a thousand words.

Defined cases: null and empty texts have no shingles and are linked with nothing; fewer than k words make one
shingle; a null identifier never is a component's smallest unless all are null; repeated rows fall into one
component; identifiers may be of any ordered type; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.components import components as connected_components
from fieldloom.storage import cleared

from .common import Rows, bounded_batches, located, maybe_broadcast, written

BANDS, ROWS, BASE, RATE, TOP = 40, 5, 1.001, 20.0, 65_534
REGISTERS = BANDS * ROWS
#: Rounds of further leaders before what is left is compared across components.
TURNS = 1
#: Slots of the table of shingle counts that orders shingles by rarity, the shingles that a block aims at, and the ratio of
#: the sizes of its sets.
ORDER_SLOTS, BLOCK, CLASS_RATIO = 1 << 18, 16_384, 1.1
#: Standard deviations below the threshold at which an estimate rules a pair out.
SIGMAS = 6.0
#: Words and set keys that a task's memos hold; they only save time.
WORDS_KEPT, KEYS_KEPT = 60_000, 200_000
PLACE = ("home", "stray", "class", "deal", "n")
_ODD64 = np.random.default_rng(20_240_101).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD32 = np.random.default_rng(77).integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class _Words(dict):
    """Word to 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, ASCII letters in lower case."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(k, n)
    h = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        h += w[j : n - width + 1 + j] * _ODD64[j]
    h += np.uint64(width)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Exponentially spaced truncated minima: the larger, the smaller the minimum."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, np.multiply.outer(_ODD32, x[i : i + 1024]).min(axis=1), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    value = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    return np.clip(value, 0, TOP + 1).astype("<u2")


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows, given the set sizes."""
    over, under = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - over - under
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    tiny = 1e-12

    def likelihood(j):
        x, y = p(u - v * j), p(v - u * j)
        return over * np.log(x + tiny) + under * np.log(y + tiny) + same * np.log(np.maximum(1 - x - y, 0) + tiny)

    for _ in range(40):  # the likelihood is concave
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


@F.arrow_udf(T.DoubleType())
def _estimated(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    rows = lambda x: np.frombuffer(b"".join(x.to_pylist()), "<u2").reshape(len(x), REGISTERS).astype(np.int32)
    return pa.array(joint_estimate(rows(a), rows(b), n_a.to_numpy(False).astype(float), n_b.to_numpy(False).astype(float)))


@F.arrow_udf(T.LongType())
def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of shingles that two packed sets share."""
    return pa.array((len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True)) for x, y in zip(a, b)), pa.int64())


def across(one: list[dict], two: list[dict], percent: int) -> list[tuple[int, int]]:
    """A link (sid, sid) for each pair of components that sets of block ``one`` and sets of block ``two`` link."""
    sets = [np.frombuffer(m["shingles"], np.uint64) for m in two]
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(two)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    components, found = np.array([m["component"] for m in two]), {}
    for m in one:
        own = np.frombuffer(m["shingles"], np.uint64)
        low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        many = high - low
        places = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        shared = np.bincount(owner[places], minlength=len(two))
        for k in np.flatnonzero((100 * shared >= percent * (len(own) + sizes - shared)) & (components != m["component"])).tolist():
            found.setdefault((m["component"], two[k]["component"]), (m["sid"], two[k]["sid"]))
    return list(found.values())


def _marks(docs: DataFrame, k: int) -> DataFrame:
    """For each row: size and key of its set, and the registers where this task first meets the set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            sizes, keys, sketches = [], [], []
            for text in b.column("text"):
                h = shingles(text.as_py(), k)
                key = hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None
                first = key is not None and key not in seen
                if first:
                    if len(seen) >= KEYS_KEPT:
                        seen.clear()
                    seen.add(key)
                sizes.append(len(h))
                keys.append(key)
                sketches.append(registers(h).tobytes() if first else None)
            own = [b.column(n) for n in ("doc_id", "at_file", "at_row")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "at_file", "at_row", "n", "set_key", "sketch"])
        _WORDS.clear()

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at_file string, at_row long, n long, set_key binary, sketch binary")


def _packed(texts: DataFrame, k: int) -> DataFrame:
    """(sid, shingles): the sorted hashes of each text's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array((shingles(t.as_py(), k).tobytes() for t in b.column("text")), pa.binary())], ["sid", "shingles"])
        _WORDS.clear()

    return texts.mapInArrow(scan, "sid long, shingles binary")


def _like(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


class _Corpus:
    """The sets' sketches, and the full sets of those that share a bucket with another, written once."""

    def __init__(self, sets: DataFrame, packed: DataFrame, percent: int):
        self.sets, self.packed, self.percent = sets, packed, percent

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of the candidate pairs (a, b), written."""
        side = lambda c: self.sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
        whole = lambda c: self.packed.select(F.col("sid").alias(c), F.col("shingles").alias(f"all_{c}"))
        n_a, n_b = F.col("n_a"), F.col("n_b")
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(_like(n_a, n_b, self.percent))
        t = self.percent / 100
        cutoff = t - SIGMAS * (t * (1 - t) / REGISTERS) ** 0.5
        likely = written(pairs.where(_estimated("s_a", "s_b", "n_a", "n_b") >= cutoff).select("a", "b", "n_a", "n_b"), "near-likely")
        both = likely.join(whole("b"), "b").join(whole("a"), "a").withColumn("shared", _shared("all_a", "all_b"))
        return written(both.where(100 * F.col("shared") >= self.percent * (n_a + n_b - F.col("shared"))).select("a", "b"), "near-links")

    def stray_links(self, rest: DataFrame) -> DataFrame | None:
        """Links across components among the open buckets' sets, one for each pair of blocks and components.

        A set's home is its most crowded open bucket. A home's sets are dealt into blocks of about BLOCK shingles,
        strays and others apart. Of two linked sets, sorted by any common order, the first shared shingle stands
        among the first few of both: blocks that share no such prefix shingle hold no link. The order puts rare
        shingles first, so that a crowd's own shingles come last.
        """
        sizes = rest.select("sid", "component").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        tops = rest.groupBy("band", "component").agg(F.count(F.lit(1)).alias("members")).join(sizes, "component").groupBy("band").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("members").alias("crowd"))
        home = F.max(F.struct("crowd", "band"))["band"].alias("home")
        marked = rest.join(tops, "band").groupBy("sid").agg(F.max(F.col("component") != F.col("top.component")).alias("stray"), F.min("component").alias("component"), home)
        marked = written(marked.join(self.packed, "sid"), "near-marked")
        if marked.isEmpty():
            return None
        percent = self.percent

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(ORDER_SLOTS, np.int64)
            for b in batches:
                for s in b.column("shingles"):
                    np.add.at(total, (np.frombuffer(s.as_py(), np.uint64) % np.uint64(ORDER_SLOTS)).astype(np.int64), 1)
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], ["slot", "n"])

        common = np.zeros(ORDER_SLOTS, np.int64)
        seen = marked.select("shingles").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most ORDER_SLOTS rows
        common[seen["slot"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
        shared = rest.sparkSession.sparkContext.broadcast(common)

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The first shingles of each set, each with the number of shingles from it on."""
            for b in batches:
                rows, parts, rests = [], [], []
                for k, s in enumerate(b.column("shingles")):
                    h = np.frombuffer(s.as_py(), np.uint64)
                    first = np.lexsort((h, shared.value[(h % np.uint64(ORDER_SLOTS)).astype(np.int64)]))[: len(h) - -(-len(h) * percent // 100) + 1]
                    parts.append(h[first].view(np.int64))
                    rests.append(len(h) - np.arange(len(first), dtype=np.int32))
                    rows.append(np.full(len(first), k))
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in PLACE), pa.array(np.concatenate(parts)), pa.array(np.concatenate(rests))], [*PLACE, "shingle", "rest"])

        n = (F.octet_length("shingles") / 8).cast("int")
        sized = marked.withColumns({"n": n, "class": F.floor(F.log(n.cast("double")) / np.log(CLASS_RATIO)).cast("int")})
        deals = sized.groupBy("home", "stray", "class").agg(F.ceil(F.sum("n") / BLOCK).alias("deals"))
        dealt = sized.join(deals, ["home", "stray", "class"]).withColumn("deal", F.pmod(F.xxhash64("sid"), "deals"))
        place = F.struct("home", "stray", "class", "deal").alias("block")
        blocks = written(dealt.groupBy(place).agg(F.collect_list(F.struct("sid", "component", "shingles")).alias("members")), "near-blocks")
        flat = dealt.select(*PLACE, "shingles").mapInArrow(prefixes, "home long, stray boolean, class int, deal long, n int, shingle long, rest int")
        begins = flat.groupBy(place, "shingle").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
        begins = written(begins, "near-begins")
        side = lambda name: [F.col("block").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("low", "high", "rest")]]
        left, right = begins.where("block.stray").select("shingle", *side("one")), begins.select("shingle", *side("two"))
        # of two linked sets, the rest of either from the first shared shingle on holds all that they share
        sizes_fit = f"{percent} * one_low <= 100 * two_high AND {percent} * two_low <= 100 * one_high"
        enough_left = f"{100 + percent} * least(one_rest, two_rest) >= {percent} * (one_low + two_low)"
        met = left.join(right, "shingle").where(f"(NOT two.stray OR one <= two) AND {sizes_fit} AND {enough_left}").select("one", "two").distinct()

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for one, two in zip(b.column("strays"), b.column("others")):
                    found = across(one.as_py(), two.as_py(), percent)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        pairs = written(met, "near-met-blocks").join(blocks.select(F.col("block").alias("one"), F.col("members").alias("strays")), "one").join(blocks.select(F.col("block").alias("two"), F.col("members").alias("others")), "two")
        found = pairs.select("strays", "others").mapInArrow(compare, "a long, b long")
        return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-crossed")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept (it is its component's first row), at_file, at_row.

    ``component_id`` is the smallest identifier reachable over links, sets that share at least ``percent`` hundredths.
    """
    bounded_batches(docs.sparkSession)
    with cleared(docs.sparkSession) as keep:
        return keep(_near_classes(docs, doc_id, text, k, percent), "near-classes")


def _near_classes(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    source = located(docs, {"doc_id": F.col(f"`{doc_id}`"), "text": F.col(f"`{text}`")}, "near-input")
    marks = written(_marks(source, k), "near-marks")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at_file", "at_row")
    sets = marks.where("set_key IS NOT NULL").groupBy("set_key").agg(F.max("sketch").alias("sketch"), F.first("n").alias("n"), F.min(place).alias("least"))
    sets = written(sets.select(F.monotonically_increasing_id().alias("sid"), "set_key", "sketch", "n", "least", "least.at_file", "least.at_row"), "near-sets")

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = sets.select("sid", F.explode(band).alias("band"))
    buckets = written(bands.groupBy("band").agg(F.min("sid").alias("leader"), F.max("sid").alias("last")).where("leader < last").select("band", "leader"), "near-buckets")
    members = written(bands.join(maybe_broadcast(buckets), "band"), "near-members")

    wanted = written(sets.join(members.select("sid").distinct(), "sid", "left_semi").select("sid", "at_file", "at_row"), "near-wanted")
    texts = source.select("at_file", "at_row", "text").join(maybe_broadcast(wanted), ["at_file", "at_row"]).select("sid", "text")
    corpus = _Corpus(sets, written(_packed(texts, k), "near-packed"), percent)
    pairs = members.where("sid > leader").select(F.col("leader").alias("a"), F.col("sid").alias("b")).distinct()
    links = connected_components(corpus.verified(written(pairs, "near-pairs")))
    mine = members.select("sid").distinct().join(links.select(F.col("node").alias("sid"), "component"), "sid", "left")
    labels = written(mine.select("sid", F.coalesce("component", "sid").alias("component")), "near-labels")

    def open_buckets() -> DataFrame:
        """Members of the buckets that still hold several components."""
        named = members.join(labels, "sid")
        several = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
        return written(named.join(maybe_broadcast(written(several, "near-open")), "band", "left_semi"), "near-rest")

    def joined(found: DataFrame) -> DataFrame:
        """The labels after further links: whole components are joined, so the graph has one only for each that is linked."""
        end = lambda c: labels.select(F.col("sid").alias(c), F.col("component").alias(f"{c}_component"))
        found = maybe_broadcast(found)
        both = end("a").join(found, "a").join(end("b"), "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b")).where("a != b").distinct()
        roots = connected_components(both).select(F.col("node").alias("component"), F.col("component").alias("root"))
        renamed = labels.join(maybe_broadcast(roots), "component", "left").select("sid", F.coalesce("root", "component").alias("component"))
        return written(renamed, "near-labels")

    rest = open_buckets()
    for turn in range(TURNS):  # another leader of each bucket, by a hash: most components that can be joined are
        leaders = rest.groupBy("band").agg(F.min(F.struct(F.xxhash64("sid", "band", F.lit(turn)).alias("h"), "sid", "component")).alias("lead"))
        met = rest.join(leaders, "band").where("component != lead.component").select(F.least("sid", "lead.sid").alias("a"), F.greatest("sid", "lead.sid").alias("b")).distinct()
        met = written(met, "near-met")
        if met.isEmpty():
            break
        labels = joined(corpus.verified(met))
        rest = open_buckets()

    crossed = corpus.stray_links(rest)
    if crossed is not None and not crossed.isEmpty():
        labels = joined(crossed)

    named = sets.select("sid", "set_key", "least").join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    named = named.join(first, "component").select("set_key", "first")
    out = marks.drop("sketch").join(named, "set_key", "left")
    own = F.col("first").isNull() | ((F.col("first.at_file") == F.col("at_file")) & (F.col("first.at_row") == F.col("at_row")))
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), own.alias("kept"), "at_file", "at_row")


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns, whatever their names."""
    rows = Rows(docs, "near-rows")
    found = near_classes(rows.plain, rows.own(doc_id), rows.own(text), k, percent)
    return rows.without(written(found.where(~F.col("kept")).select("at_file", "at_row"), "near-dropped"))
