"""Approximate nearest neighbours by randomly rotated one-bit codes.

Rows go to the nearest of a few centres. A row's residual from its centre is rotated by one random rotation, and only the signs are
kept, packed to bits, with two scalars: the residual's norm and the cosine between residual and code. The inner product of
a query's residual with a row's is estimated from the bits and divided by that cosine; the estimate's error is bounded by SIGMAS standard
deviations, sqrt((1 - f^2) / f^2 / (D - 1)) for a cosine f. Rows whose smallest distance by that bound is within a query's
threshold are reranked by exact distances in double precision; the others can't be among the nearest but with the bound's probability.

Each scan task packs its rows by centre into blocks of BLOCK_BYTES at most, codes, scalars and vectors together, so the index
needs no shuffle and a crowded centre is many blocks. Queries are packed alike. A query first searches one block of its own
centre, which gives its threshold, the k-th nearest found; then it goes to the blocks of each centre that the triangle inequality
doesn't rule out. Blocks of a centre are dealt into slots by number, each with a copy of the centre's queries, so a hot centre is many
tasks. A task keeps the k best for each query over all its blocks, which lowers the thresholds as it goes, and the lists
are merged by a ranked window, cut before its shuffle. Every query meets all rows, in blocks, and no row is made for a pair that isn't kept.

The centres are fitted by k-means to at most FIT_ROWS rows and FIT_BYTES (those of the smallest hashes of the vector); every row is indexed.
The centres and the rotation are broadcast: CENTRES x D and D x D numbers.

Defined cases: null, zero or empty vectors and vectors with null, NaN or infinite entries take no part, as query or row; vectors of
different dimensions never meet; rows with a query's own identifier aren't its neighbours; repeated query rows are searched
once; equal distances go to the smaller identifier, a null one last; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.storage import cleared

from .common import bounded_batches, written

CENTRES, FIT_ROWS, FIT_BYTES = 32, 8_192, 16 << 20
#: Bytes of vectors in a block of the index or of queries, and blocks of a centre that a slot takes.
BLOCK_BYTES, SLOT_BLOCKS = 512 << 10, 8
#: Standard deviations of the estimate that the bound allows.
SIGMAS = 2.5
NONE = np.iinfo(np.int64).max

_INDEX = "dimension int, centre int, block long, rows int, far double, ids binary, codes binary, norms binary, cosines binary, vectors binary"
_QUERIES = "dimension int, centre int, pack long, ids binary, vectors binary, limits binary"
_FOUND = "query_id long, vec_id long, score double"


def takes_part(vector: Column) -> Column:
    """Whether a vector has entries, all finite, and isn't zero."""
    finite = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda c: c != 0), F.lit(False))


def rotation(dimension: int) -> np.ndarray:
    """The same random rotation everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(1_311).normal(size=(dimension, dimension)))
    return q * np.sign(r.diagonal())


def k_means(sample: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centres of a bounded sample: k-means++ starts of a fixed seed, a few Lloyd rounds."""
    rng, centres = np.random.default_rng(11), sample[:1]
    near = ((sample - centres[0]) ** 2).sum(1)
    while len(centres) < k and near.sum() > 0:
        one = sample[np.searchsorted(np.cumsum(near), rng.random() * near.sum()).clip(0, len(sample) - 1)]
        centres, near = np.vstack([centres, one]), np.minimum(near, ((sample - one) ** 2).sum(1))
    for _ in range(rounds):
        own = nearest(sample, centres)[0]
        centres = np.stack([sample[own == i].mean(0) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and the squared distances to all."""
    square = np.maximum((vectors**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * vectors @ centres.T, 0)
    return square.argmin(1), square


def distances(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances of aligned rows, squares added in the order of the dimensions."""
    total = np.zeros(len(rows))
    for r, q in zip(rows.T, queries.T):
        total += (r - q) ** 2
    return np.sqrt(total)


class Geometry:
    """Centres and rotation of one dimension."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.rotation = rotation(centres.shape[1])

    def codes(self, vectors: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs of rotated residuals, the residuals' norms, and their cosines with the codes."""
        residual = (vectors - self.centres[own]) @ self.rotation
        norm = np.sqrt((residual**2).sum(1))
        cosine = np.abs(residual).sum(1) / np.maximum(norm, 1e-300) / np.sqrt(residual.shape[1])
        return np.packbits(residual >= 0, axis=1), norm, np.where(norm > 0, cosine, 1.0)


class Block:
    """A packed block of the index, opened."""

    def __init__(self, row: dict, geometry: Geometry):
        self.d, self.centre, self.geometry = row["dimension"], row["centre"], geometry
        self.vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, self.d)
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.norms, self.cosines = np.frombuffer(row["norms"], "<f8"), np.frombuffer(row["cosines"], "<f8")
        bits = np.unpackbits(np.frombuffer(row["codes"], np.uint8).reshape(len(self.ids), -1), axis=1, count=self.d)
        self.signs = bits.astype(np.float32) * np.float32(2 / np.sqrt(self.d)) - np.float32(1 / np.sqrt(self.d))

    def estimates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances of each query to each row, and what they are at least by the bound."""
        residual = (queries - self.geometry.centres[self.centre]) @ self.geometry.rotation
        away = np.sqrt((residual**2).sum(1))[:, None]
        inner = (residual.astype(np.float32) @ self.signs.T).astype(float) * (self.norms / self.cosines)
        slack = np.sqrt(np.maximum(1 - self.cosines**2, 0)) / self.cosines / np.sqrt(max(self.d - 1, 1)) * self.norms
        sizes = away**2 + self.norms**2
        square = sizes - 2 * inner
        least = np.maximum(square - 2 * SIGMAS * away * slack, (away - self.norms) ** 2)
        return square, least - 1e-6 * sizes  # the product of single precision

    def limits(self, queries: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
        """For each query, a distance within which there are k rows: the k-th of those that look nearest; infinite if they are fewer."""
        square = np.where(self.ids == names[:, None], np.inf, self.estimates(queries)[0])
        likely = np.argsort(square, axis=1)[:, : 4 * k]
        query, at = np.repeat(np.arange(len(names)), likely.shape[1]), likely.ravel()
        exact = np.where(self.ids[at] == names[query], np.inf, distances(self.vectors[at], queries[query])).reshape(likely.shape)
        return np.sort(exact, axis=1)[:, k - 1] if exact.shape[1] >= k else np.full(len(names), np.inf)

    def within(self, queries: np.ndarray, names: np.ndarray, limits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position of the query, identifier, distance) of the rows within the queries' limits, in parts of bounded size."""
        query, at = np.nonzero((self.estimates(queries)[1] <= (limits**2 * (1 + 1e-9))[:, None]) & (self.ids != names[:, None]))
        for i in range(0, len(query), 1 << 16):
            q, r = query[i : i + (1 << 16)], at[i : i + (1 << 16)]
            near = distances(self.vectors[r], queries[q])
            good = near <= limits[q]
            yield q[good], self.ids[r[good]], near[good]


class Best:
    """The k nearest found for each query of a task."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def limits(self, names: np.ndarray, given: np.ndarray) -> np.ndarray:
        own = [kept[0][-1] if (kept := self.kept.get(n)) and len(kept[0]) == self.k else np.inf for n in names.tolist()]
        return np.minimum(given, own)

    def add(self, names: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        starts = np.flatnonzero(np.diff(names, prepend=-1 if not len(names) else names[0] - 1))
        for name, some in zip(names[starts].tolist(), np.split(np.arange(len(names)), starts[1:])):
            scores, found = near[some], ids[some]
            if name in self.kept:
                scores, found = np.concatenate([self.kept[name][0], scores]), np.concatenate([self.kept[name][1], found])
            order = np.lexsort((found, scores))[: self.k]
            self.kept[name] = (scores[order], found[order])

    def rows(self) -> pa.RecordBatch:
        query = np.repeat(np.array(list(self.kept), np.int64), [len(s) for s, _ in self.kept.values()])
        scores = np.concatenate([np.empty(0), *[s for s, _ in self.kept.values()]])
        ids = np.concatenate([np.empty(0, np.int64), *[i for _, i in self.kept.values()]])
        self.kept = {}
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, mask=ids == NONE), pa.array(scores)], ["query_id", "vec_id", "score"])


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)


def _packed(rows: DataFrame, geometry: dict, queries: bool, block_bytes: int) -> DataFrame:
    """Rows (vec_id, vector) packed by centre, without a shuffle: blocks of the index, or of queries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = {}
        number = TaskContext.get().partitionId() << 32

        def give(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, vectors = (np.concatenate(x) for x in zip(*waiting.pop(key)))
            head = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([number])]
            blob = lambda *x: [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in x]
            if queries:
                return pa.RecordBatch.from_arrays([*head, *blob(ids, vectors, np.full(len(ids), np.inf))], [c.split()[0] for c in _QUERIES.split(", ")])
            codes, norms, cosines = geometry.value[key[0]].codes(vectors, np.full(len(ids), key[1]))
            return pa.RecordBatch.from_arrays([*head, pa.array([len(ids)], pa.int32()), pa.array([float(norms.max())]), *blob(ids, codes, norms, cosines, vectors)], [c.split()[0] for c in _INDEX.split(", ")])

        for b in batches:
            size = np.diff(b.column("vector").offsets.to_numpy())
            ids = b.column("vec_id").fill_null(NONE).to_numpy()
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                vectors = _vectors(b.column("vector").take(pa.array(at)), d)
                own = nearest(vectors, geometry.value[d].centres)[0]
                for c in np.unique(own).tolist():
                    some, most = np.flatnonzero(own == c), max(1, block_bytes // (8 * d))
                    held = waiting.setdefault((d, c), [])
                    for i in range(0, len(some), most):
                        part = some[i : i + most]
                        if sum(len(x[0]) for x in held) + len(part) > most:
                            yield give((d, c))
                            held = waiting.setdefault((d, c), [])
                        held.append((ids[at[part]], vectors[part]))
        for key in list(waiting):
            if waiting[key]:
                yield give(key)

    return rows.mapInArrow(scan, _QUERIES if queries else _INDEX)


def _asked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and identifiers of a pack of queries."""
    return np.frombuffer(row["q_vectors"], "<f8").reshape(-1, row["dimension"]), np.frombuffer(row["q_ids"], "<i8")


def _dealt(met: DataFrame, geometry: dict, k: int, far: dict[int, dict[int, float]]) -> DataFrame:
    """Queries with limits from one block of their own centre, packed for every centre that they must see."""
    names = [c.split()[0] for c in _QUERIES.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                d, (queries, ids) = row["dimension"], _asked(row)
                limits = np.full(len(ids), np.inf) if row["block"] is None else Block(row, geometry.value[d]).limits(queries, ids, k)
                away = np.sqrt(nearest(queries, geometry.value[d].centres)[1])
                for c, reach in far.get(d, {}).items():
                    some = np.flatnonzero(away[:, c] - reach <= limits * (1 + 1e-6) + 1e-6)
                    if len(some):
                        blobs = [pa.array([np.ascontiguousarray(x[some]).tobytes()], pa.binary()) for x in (ids, queries, limits)]
                        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([c], pa.int32()), pa.array([row["pack"]]), *blobs], names)

    return met.mapInArrow(deal, _QUERIES)


def _searched(pairs: DataFrame, geometry: dict, k: int) -> DataFrame:
    """The k best of each query within a task, over pairs of a pack of queries and a block of the index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                queries, names = _asked(row)
                if len(best.kept) + len(names) > 500_000:
                    yield best.rows()
                limits = best.limits(names, np.frombuffer(row["q_limits"], "<f8"))
                for q, ids, near in Block(row, geometry.value[row["dimension"]]).within(queries, names, limits):
                    best.add(names[q], ids, near)
        yield best.rows()

    return pairs.mapInArrow(scan, _FOUND)


def _sample(rows: DataFrame, dimension: int) -> np.ndarray:
    """At most FIT_ROWS rows and FIT_BYTES of one dimension, those of the smallest hashes."""
    most = max(1, min(FIT_ROWS, FIT_BYTES // (8 * dimension)))
    some = rows.where(F.size("vector") == dimension).orderBy(F.xxhash64("vector", "vec_id")).limit(most).select("vector").collect()
    return np.array([r["vector"] for r in some], float)


def neighbours(rows: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k nearest rows found for each row of ``is_query`` (a condition on vec_id): query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    own = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector")).where(takes_part(F.col("vector")))
    bounded_batches(spark)
    with cleared(spark) as keep:
        return keep(_neighbours(spark, own, is_query, k, block_bytes), "neighbours")


def _neighbours(spark: SparkSession, own: DataFrame, is_query: Column, k: int, block_bytes: int) -> DataFrame:
    asked = written(own.where(F.col("vec_id").isNotNull() & is_query), "near-asked").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    dimensions = sorted(r[0] for r in own.select(F.size("vector")).distinct().collect())  # a row for each dimension
    shared = spark.sparkContext.broadcast({d: Geometry(k_means(_sample(own, d), CENTRES)) for d in dimensions})
    index = written(_packed(own, shared, False, block_bytes), "near-index")
    packs = written(_packed(asked, shared, True, block_bytes), "near-packs")
    # at most CENTRES rows for each dimension
    cells = index.groupBy("dimension", "centre").agg(F.count(F.lit(1)).alias("blocks"), F.max("far").alias("far")).collect()
    far: dict[int, dict[int, float]] = {}
    for r in cells:
        far.setdefault(r["dimension"], {})[r["centre"]] = r["far"]
    slots = spark.createDataFrame([(r["dimension"], r["centre"], -(-r["blocks"] // SLOT_BLOCKS)) for r in cells], "dimension int, centre int, slots int")
    slots = F.broadcast(slots)
    slot = lambda of: F.pmod(F.xxhash64(of), "slots").cast("int")
    renamed = lambda q: q.select("dimension", "centre", "slot", "pack", *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "limits")])
    slotted = index.join(slots, ["dimension", "centre"]).withColumn("slot", slot("block")).drop("slots")

    # one block of a query's own centre gives its limit; packs of a centre take the first blocks of its slots in turn
    firsts = slotted.groupBy("dimension", "centre", "slot").agg(F.min("block").alias("block"))
    turn = renamed(packs.join(slots, ["dimension", "centre"], "left").withColumn("slot", slot("pack")))
    met = turn.join(firsts, ["dimension", "centre", "slot"], "left").join(index.drop("dimension", "centre"), "block", "left")
    dealt = written(_dealt(met, shared, k, far), "near-dealt")
    every = dealt.join(slots, ["dimension", "centre"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    found = written(_searched(renamed(every).join(slotted, ["dimension", "centre", "slot"]), shared, k), "near-found")
    order = Window.partitionBy("query_id").orderBy("score", F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
