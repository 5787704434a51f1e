import hashlib
import random
import time
import zlib

from fieldloom.llm import media


def want(text):
    payload = media.payload_of(text)
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload)


def test_chunks():
    rng = random.Random(4)
    data = rng.randbytes(60_000)
    pieces = media.chunks_of(data)
    assert b"".join(pieces) == data and max(map(len, pieces)) <= media.MOST and min(map(len, pieces[:-1])) >= media.LEAST
    shifted = media.chunks_of(rng.randbytes(777) + data)
    assert len(set(pieces) & set(shifted)) > len(pieces) / 2
    assert b"".join(media.chunks_of(b"\0" * 100_000)) == b"\0" * 100_000


def test_round_trip(spark, tmp_path):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh é") for _ in range(40_000))
    texts = ["", None, "a", "x" * 576, long, long, long[:20_000] + "changed" + long[20_000:], "z" * 100_000, "q " + long[5_000:]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (2, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = media.media_columns(docs, str(tmp_path / "m")).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32, r.payload_bytes, r.verified)) for r in got) == sorted(str((i, len((t or "").encode()), *want(t), True)) for i, t in rows)
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert stored.count() == len({media.payload_of(t) for t in texts})
    kept = sum(len(r.data) for r in stored.collect())
    assert kept < len(long) * 1.1 * 1.5 + 120_000
    assert media.media_columns(docs.where("false")).count() == 0


def test_media_fields_by_their_definition(spark):
    """Payload, image and feature recomputed from the text alone."""
    texts = ["", None, "plain words", "é" * 500, "b" * 1_151, "0123456789" * 3_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in media.media_columns(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        blocks = max(1, (len(raw) + 575) // 576)
        payload = raw.ljust(576 * blocks, b"\xff")
        image = f"P5\n24 {24 * blocks}\n255\n".encode() + payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), 576 * blocks, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        shape, chunks, total, distinct = r.feature.split(";")
        assert (shape, total, distinct) == (f"24x{24 * blocks}", f"sum={sum(payload)}", f"distinct={len(set(payload))}")
        assert 1 <= int(chunks.removeprefix("chunks=")) <= len(image) // media.LEAST + 1


def test_long_media_that_share_nearly_all(spark, monkeypatch):
    """Two media of some 4 MB and many short ones with one chunk in common; crowded chunks are salted."""
    monkeypatch.setattr(media, "SALT_ROWS", 5)
    rng = random.Random(9)
    long = rng.randbytes(2_000_000).hex()
    shared = rng.randbytes(20_000).hex()
    texts = [long, long[:1_000_000] + "x" + long[1_000_000:], *[f"{i} {shared}" for i in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(6)
    began = time.time()
    got = {r.doc_id: r for r in media.media_columns(docs).collect()}
    assert time.time() - began < 100
    for i, t in enumerate(texts):
        assert got[i].verified and (got[i].payload_sha256, got[i].tail_crc32, got[i].payload_bytes) == want(t)
