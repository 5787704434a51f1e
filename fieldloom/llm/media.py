"""Media columns: content-defined chunks, stored once each, and verified reconstruction.

A payload of bytes is stored losslessly as the 8-bit samples of a greyscale image (binary PGM, WIDTH samples a row;
the payload's length is a multiple of WIDTH * WIDTH). The medium's bytes are cut by a rolling gear hash: a cut
follows a byte where the top bits of the hash of the last 32 bytes are zero, so equal stretches of different
media are cut alike. Joins on the chunks' digests find for each distinct chunk the medium that owns it.

Store: one row for each distinct medium: its ordered chunk list, the places in it whose bytes another row owns, and
the bytes it owns itself. Reading back, a row that owns all its chunks is put together where it is read; only the
others fetch chunks by digest. Every medium's digest is verified after reconstruction.

Defined cases: a null or empty text is a payload of padding only; equal texts share one store row; a chunk that
repeats within a medium is stored once; a long text is a long medium and reconstructed in time proportional to it;
identifiers may be of any type, null or repeated; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.storage import cleared

from .common import bounded_batches, located, maybe_broadcast, scratch, written

WIDTH, PAD = 24, b"\xff"
UNIT = WIDTH * WIDTH
#: Chunk sizes in bytes: least, aimed at (a power of two) and most.
LEAST, AIM, MOST = 256, 2_048, 16_384
#: Places that want a chunk that one task serves.
SALT_ROWS = 1_000
_GEAR = np.random.default_rng(576).integers(0, 2**32, 256, dtype=np.uint32)
_MASK = np.uint32((AIM - 1) << (32 - AIM.bit_length() + 1))
_FACTS = "medium binary, verified boolean, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def medium_of(payload: bytes) -> bytes:
    """A binary PGM image of the payload."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples_of(medium: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a PGM image."""
    magic, size, top, samples = medium.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit PGM image")
    return width, height, samples


def gear_cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # the sum of the last 32 gear values, each shifted by its age
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    cuts, start, n = [], 0, len(data)
    for c in np.flatnonzero((h & _MASK) == 0).tolist():
        end = c + 1
        while end - start > MOST:
            start += MOST
            cuts.append(start)
        if end - start >= LEAST:
            cuts.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        cuts.append(start)
    if start < n:
        cuts.append(n)
    return cuts


def chunks_of(data: bytes) -> list[bytes]:
    ends = gear_cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


_CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32())]))


def _manifest(source: DataFrame) -> DataFrame:
    """For each row: its medium's digest and ordered chunk list."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, lists = [], [], []
            for x in b.column("text"):
                text = x.as_py()
                medium = medium_of(payload_of(text))
                keys.append(hashlib.sha256(medium).digest())
                sizes.append(len((text or "").encode()))
                lists.append([{"digest": _digest(c), "size": len(c)} for c in chunks_of(medium)])
            own = [b.column(n) for n in ("doc_id", "at_file", "at_row")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, _CHUNKS)], ["doc_id", "at_file", "at_row", "n_bytes", "medium", "chunks"])

    return source.mapInArrow(scan, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, at_file string, at_row long, n_bytes long, medium binary, chunks array<struct<digest binary, size int>>")


def _packed(rows: DataFrame) -> DataFrame:
    """Store rows: the bytes of the chunks that a medium owns."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                keys, lists, data = [], [], []
                for x, away in zip(part.column("text"), part.column("away").to_pylist()):
                    medium = medium_of(payload_of(x.as_py()))
                    pieces, not_own = chunks_of(medium), set(away)
                    keys.append(hashlib.sha256(medium).digest())
                    lists.append([{"digest": _digest(c), "size": len(c)} for c in pieces])
                    data.append(b"".join(c for k, c in enumerate(pieces) if k not in not_own))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lists, _CHUNKS), part.column("away"), pa.array(data, pa.binary())], ["medium", "chunks", "away", "data"])

    return rows.select("text", "away").mapInArrow(scan, "medium binary, chunks array<struct<digest binary, size int>>, away array<int>, data binary")


def store(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the store to ``path``; the manifest: doc_id, n_bytes and medium of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    source = located(docs, {"doc_id": F.col(f"`{doc_id}`"), "text": F.col(f"`{text}`")}, "media-input")
    manifest = written(_manifest(source), "media-manifest")
    place = F.struct("at_file", "at_row")
    repeated = manifest.groupBy("medium").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = written(repeated.select("medium", F.col("first.at_file").alias("f"), F.col("first.at_row").alias("r")), "media-repeated")
    rows = manifest.join(maybe_broadcast(repeated), "medium", "left")
    copy = F.col("f").isNotNull() & ~((F.col("f") == F.col("at_file")) & (F.col("r") == F.col("at_row")))
    rows = rows.withColumn("copy", copy).drop("f", "r")

    refs = rows.where("NOT copy").select("at_file", "at_row", F.posexplode("chunks").alias("pos", "chunk")).select("at_file", "at_row", "pos", "chunk.digest")
    owners = refs.groupBy("digest").agg(F.min(F.struct("at_file", "at_row", "pos")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    owners = written(owners.select("digest", "owner"), "media-owners")
    away = refs.join(maybe_broadcast(owners), "digest").where(F.struct("at_file", "at_row", "pos") != F.col("owner"))
    away = away.groupBy("at_file", "at_row").agg(F.sort_array(F.collect_list("pos")).alias("away"))
    none = F.array().cast("array<int>")
    special = rows.where("copy").select("at_file", "at_row", none.alias("away"), F.lit(True).alias("copy")).unionByName(away.withColumn("copy", F.lit(False)))
    special = written(special, "media-special")
    left = source.join(maybe_broadcast(special), ["at_file", "at_row"], "left").where("copy IS NULL OR NOT copy")
    packs = _packed(left.select("text", F.coalesce("away", none).alias("away")))
    packs.write.option("compression", "zstd").parquet(path)
    return manifest.select("doc_id", "n_bytes", "medium")


def facts(medium: bytes, key: bytes) -> dict:
    """What is computed from a medium that was read back."""
    width, height, samples = samples_of(medium)
    a = np.frombuffer(samples, np.uint8)
    digest = hashlib.sha256(medium)
    cuts = len(gear_cuts(medium))
    return {
        "medium": key, "verified": digest.digest() == key, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-32:]),
        "media_bytes": len(medium), "media_sha256": digest.hexdigest(), "feature": f"{width}x{height};chunks={cuts};sum={int(a.sum(dtype=np.int64))};distinct={len(np.unique(a))}",
    }


def _facts_schema() -> pa.Schema:
    kinds = {"binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _FACTS.split(", "))])


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [facts(d.as_py(), k.as_py()) for k, d in zip(b.column("medium"), b.column("data"))]
        yield pa.RecordBatch.from_pylist(rows, _facts_schema())


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [facts(b"".join(p.as_py()), k.as_py()) for k, p in zip(b.column("medium"), b.column("pieces"))]
        yield pa.RecordBatch.from_pylist(rows, _facts_schema())


def _slices(packs: DataFrame) -> DataFrame:
    """(medium, pos, digest, piece) for each place in ``give``: owned chunks, cut out of ``data`` in one pass over its offsets."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for medium, chunks, away, data, give in zip(*(b.column(n) for n in ("medium", "chunks", "away", "data", "give"))):
                not_own, wanted, whole, rows, at = set(away.as_py()), set(give.as_py()), data.as_buffer(), [], 0
                for k, chunk in enumerate(chunks.as_py()):
                    if k not in not_own:
                        if k in wanted:
                            rows.append((k, chunk["digest"], whole.slice(at, chunk["size"]).to_pybytes()))
                        at += chunk["size"]
                if rows:
                    places, digests, pieces = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([medium.as_py()] * len(rows), pa.binary()), pa.array(places, pa.int32()), pa.array(digests, pa.binary()), pa.array(pieces, pa.binary())], ["medium", "pos", "digest", "piece"])

    return packs.select("medium", "chunks", "away", "data", "give").mapInArrow(cut, "medium binary, pos int, digest binary, piece binary")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """The facts of every distinct medium of a store."""
    packs = spark.read.schema("medium binary, chunks array<struct<digest binary, size int>>, away array<int>, data binary").parquet(path)
    whole = packs.where(F.size("away") == 0).select("medium", "data").mapInArrow(_read_whole, _FACTS)
    partial = packs.where(F.size("away") > 0)
    # places and digests are paired before they become rows, so no row carries a medium's lists
    digests = lambda places: F.explode(F.transform(places, lambda k: F.struct(k.alias("pos"), F.element_at("chunks", k + 1)["digest"].alias("digest")))).alias("at")
    owns = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), F.col("away"))
    wanted = written(partial.select("medium", digests(F.col("away"))).select("medium", "at.*"), "media-wanted")
    asked = written(wanted.groupBy("digest").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("salts")), "media-digests")
    found = packs.select("medium", digests(owns)).select("medium", "at.*").join(maybe_broadcast(asked.select("digest")), "digest", "left_semi")
    found = written(found.groupBy("medium").agg(F.collect_list("pos").alias("give")), "media-give")
    given = _slices(packs.join(maybe_broadcast(found), "medium")).select("digest", "piece")
    # a chunk that very many media share goes to as many tasks as it takes
    crowds = maybe_broadcast(written(asked.where("salts > 1"), "media-crowds"))
    salted = wanted.join(crowds, "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("medium", "pos"), "salts"), F.lit(0))).drop("salts")
    spread = given.join(crowds, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    fetched = salted.join(spread, ["digest", "salt"]).select("medium", "pos", "piece")
    own = _slices(partial.withColumn("give", owns)).select("medium", "pos", "piece")
    pieces = fetched.unionByName(own)
    joined = pieces.groupBy("medium").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return whole.unionByName(joined.select("medium", F.transform("p", lambda x: x["piece"]).alias("pieces")).mapInArrow(_read_pieces, _FACTS))


def media_columns(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store every document's payload, read the store back: one row of facts for each document."""
    spark = docs.sparkSession
    with cleared(spark) as keep:
        path = path or scratch(spark, "media")
        manifest = store(docs, path)
        found = written(read_back(spark, path), "media-facts")
        return keep(manifest.join(found, "medium").drop("medium"), "media-columns")
