"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import load

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .content_sort import exact_duplicates

    found = exact_duplicates(load(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP7_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import media_digest, store_text

    return media_digest(store_text(load(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(load(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, train

    docs = load(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return identify(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    import public_tokenizers

    counts = token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import roundtrip

    import public_tokenizers

    found = roundtrip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dups import near_duplicates

    found = near_duplicates(load(spark, sf_dir, "documents"), size=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


#: All pairs that share a shingle, their exact similarity, and components by recursion.
OP9_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(a) < 4 THEN array_to_string(a, ' ') ELSE array_to_string(a[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, a, unnest(range(1, greatest(2, len(a) - 2))) AS i FROM w WHERE len(a) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(c.b) AS component_id, d.doc_id = min(c.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id GROUP BY d.doc_id, n.n
"""


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: toxic 0, low quality 1, good 2."""
    labels = load(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out
    from .quality import grade, train

    docs = load(spark, sf_dir, "documents")
    model = train(docs, ratings(spark, sf_dir), ~held_out("id"))
    return grade(docs, model, wanted=2).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "expected_grade", "tail_prob", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_matroska": op8_matroska,
    "op9_minhash": op9_minhash,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op7_exact_dedup": OP7_SQL,
    "op9_minhash": OP9_SQL,
}
