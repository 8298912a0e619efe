"""A corpus pipeline of five stages over ``documents``; each stage is written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex.llm import byte_bpe, content_sort, langid, mixing, near_dups, runtime


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, so that a decision holds for a row and not for all rows of its identifier, and the
    number's column, of a name that no column has. They are written, so that a later scan, however it is divided,
    finds each row under its number."""
    row, taken = "loomlex_row", {c.lower() for c in docs.columns}
    while row in taken:
        row += "_"
    return runtime.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification; documents of which no language can be told go: those of a null or empty text or one
    without a letter, and those that score too low. Repeated rows share a fate; an empty table stays empty."""
    return langid.accepted(docs, langid.train(docs, ~langid.held_out()))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact de-duplication; of equal texts the one of the smallest identifier stays, one without an identifier only
    where none has one, and one of rows that are equal in both. Null texts count as empty ones; an empty table stays
    empty."""
    rows, row = _rows(docs)
    kept = content_sort.exact_duplicates(rows, row_col=row).where("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates by five words; of each component the document of the smallest identifier stays, one without an
    identifier only where none has one; documents without words (null and empty texts too), which are linked with
    nothing, all do. One of repeated rows stays; an empty table stays empty."""
    rows, row = _rows(docs)
    found = near_dups.near_duplicates(rows, row_col=row)
    alone = found.where("n_shingles = 0").select("row")
    best = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    least = found.where("n_shingles > 0").groupBy("component").agg(best.alias("best")).select("best.row")
    return rows.join(alone.unionByName(least).withColumnRenamed("row", row), row, "left_semi").drop(row)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document that the mix takes more than once occurs as often. A null
    source is one like others; documents of no words count for nothing and may stay or go; of repeated rows as many
    stay as the mix takes; an empty table stays empty."""
    rows, row = _rows(docs)
    copies = mixing.mix(rows, row_col=row).where("copies > 0").select(F.col("row").alias(row), "copies")
    copies = copies.select(row, F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    return rows.join(copies, row).drop(row)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of what is left, decoded again: doc_id, n_tokens, ids_sha256 and decoded_sha256, a row for each
    row. Null and empty texts have no tokens; an empty table gives no rows."""
    import public_tokenizers

    found = byte_bpe.roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Language scores and byte-pair merges are beyond SQL, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = runtime.materialise(docs, f"stage-{k}")
    return docs
