import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def same(codec, library, text):
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a", "Hello, world! it's 1234", "a  b", "a   b\n\n c", "tab\t x\n \n y ", "x\n ", " \n", "don't we'll I'M",
    "ünïcödé ß 東京 🙂🙂   x", "a" * 5000, "ab" * 3000, "é" * 2000, "<|endoftext|>", "\x1c \x1d a \x85 b​ c",
])
def test_as_the_library(codec, library, text):
    same(codec, library, text)


def test_random_texts(codec, library):
    rng = random.Random(5)
    signs = "ab cdE'st  \n\t.,!?019éß東🙂 \x1c\x0b"
    for _ in range(400):
        same(codec, library, "".join(rng.choice(signs) for _ in range(rng.randrange(60))))


def test_every_character_is_classed_alike(codec, library):
    for start in range(0, sys.maxunicode, 997):
        text = "x".join(chr(c) for c in range(start, min(start + 40, sys.maxunicode)) if not 0xD800 <= c <= 0xDFFF)
        same(codec, library, text)


def test_columns(spark, library):
    texts = [(1, "some text here"), (2, None), (3, ""), (3, "some text here"), (None, "y" * 100_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    tokenizer = bpe.Tokenizer(spark, PATH, public_tokenizers.PATTERN)
    rows = docs.select("doc_id", "text", tokenizer.encode(F.col("text")).alias("ids")).withColumn("back", tokenizer.decode(F.col("ids")))
    for r in rows.withColumn("n", bpe.n_tokens(F.col("ids"))).collect():
        want = library.encode_ordinary(r.text or "")
        assert r.n == len(want) and bytes(r.back) == (r.text or "").encode()
        assert hashlib.sha256(bytes(r.ids)).digest() == hashlib.sha256(np.array(want, "<u4").tobytes()).digest()
    assert docs.where("false").select(tokenizer.encode(F.col("text"))).count() == 0


def test_unknown_id(codec):
    with pytest.raises(ValueError):
        codec.decode((10**6).to_bytes(4, "little"))


def test_round_trip_is_the_librarys(spark, library):
    """The column that the query reads, for null, repeated, clashing and very long rows."""
    rng = random.Random(12)
    texts = [None, "", " \n\t", "héllo 日本 😀", "x" * 5_000, "word " * 8_000, "same", "same", *["".join(rng.choice("ab é\n'1.日 ") for _ in range(rng.randrange(80))) for _ in range(100)]]
    docs = spark.createDataFrame([(i, t, b"own", b"own") for i, t in enumerate(texts)], "doc_id int, text string, ids binary, decoded binary").repartition(3)
    codec = bpe.Tokenizer(spark, PATH, public_tokenizers.PATTERN)
    done = docs.select("doc_id", "ids", codec.round_trip(F.col("text")).alias("done")).select("doc_id", F.col("ids").alias("own"), "done.*").collect()
    for r in done:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() == library.decode_bytes(np.frombuffer(r.ids, "<u4").tolist()) and bytes(r.own) == b"own"
