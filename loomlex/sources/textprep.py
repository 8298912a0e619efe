"""Plain text before tagging: lines, paragraphs, and filters of boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What lines of boilerplate begin with.
PREFIXES = (
    "frontiers-fpsyg-corpus.txt Journal Information",
    "Journal ID (publisher-id):",
    "Psychology Journal Abbreviation:",
    "Psychology ISSN:",
    "Publisher: Frontiers Research Foundation",
    "Article Information",
    "Copyright",
    "open-access:",
    "Received Day:",
    "Accepted Day:",
    "Electronic publication date:",
    "collection publication date:",
    "Volume:",
    "DOI:",
    "[doi:",
    "Front.",
    "____",
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n\n").text(path)
    return rows.select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("value")).where("value <> ''")


def load_prefixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """One prefix a line; blank lines and those that begin with # don't count. A short list, read to the driver."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return tuple(r["value"].rstrip("\r\n") for r in rows.collect())


def filter_lines(lines: DataFrame, column: str = "value", prefixes: tuple[str, ...] = PREFIXES, strip_caret: bool = False, limit: int | None = None) -> DataFrame:
    """Lines that aren't blank and begin with none of the prefixes; with ``strip_caret`` carets go first."""
    value = F.translate(column, "^", "") if strip_caret else F.col(column)
    rows = lines.withColumn(column, value).where(F.trim(column) != "")
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.col(column).startswith(p)
    rows = rows.where(~bad)
    return rows.limit(limit) if limit else rows


def filter_counts(lines: DataFrame, column: str = "value", prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """How many lines are written and removed."""
    bad = F.lit(False)
    for p in prefixes:
        bad = bad | F.col(column).startswith(p)
    rows = lines.where(F.trim(column) != "")
    return rows.agg(F.coalesce(F.sum((~bad).cast("long")), F.lit(0)).alias("written"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("removed"))
