"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, media, mixing, near_dedup, neighbours, quality, toxicity, url_filter, warc, whitening
from .bpe import Tokenizer, n_tokens
from .common import table
from .pii import BASE, find_pii, listed


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("at_file", "at_row")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filter.judged(url_filter.dated_captures(pages), url_filter.list_log(pages))
    return found.select("page_id", "url", "fetched_at", "verdict.*")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_rows(warc.captures(table(spark, sf_dir, "pages")))


def multilingual_tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = multilingual_tokenizer(spark)
    done = table(spark, sf_dir, "documents").select("doc_id", codec.round_trip(F.col("text")).alias("done")).select("doc_id", "done.ids", "done.decoded")
    return done.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", find_pii(F.col("text")).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"), F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"), k=2).drop("at_file", "at_row")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return alignment.aligned(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_warc": op4_warc,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_media_columns": op7_media_columns,
    "op8_pii": op8_pii,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_neighbours": op11_neighbours,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op1_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g') AS plain FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY plain) AS group_size,
       row_number() OVER (PARTITION BY plain ORDER BY points DESC, doc_id) = 1 AS kept,
       sha256(plain) AS text_sha256
FROM t
""",
    "op2_source_mixing": mixing.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op4_warc": warc.ORACLE,
    # the exact search: the operator may miss some, at a rate that its bound sets; it finds all on the given tables
    "op11_neighbours": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_prepend(0e0, list_transform(list_zip(q.v, c.v), lambda s: (s[1] - s[2]) * (s[1] - s[2]))), lambda a, b: a + b)) AS score
  FROM e q JOIN e c ON len(q.v) = len(c.v) AND c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id NULLS LAST)::int AS rank, vec_id, score FROM p QUALIFY rank <= 10
""",
}
