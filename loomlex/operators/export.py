"""Results as CSV, XML and JSON lines. Lines are columns, so large results are written by all executors; the small
page that a user asks for is joined on the driver."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlex.functions.text import csv_field, xml_escape

FORMATS = ("json", "csv", "xml")
SKETCH_HEADER = "relation,lemma,collocate,pos,frequency,log_dice"
EXAMPLES_HEADER = "seed,collocate,relation,sentence"
EXPLORE_HEADER = "type,word,log_dice,frequency_or_shared_by_count"
COMPARISON_HEADER = "word,category,present_in,total_nouns,avg_logdice,coverage"


def format_of(text: str | None) -> str:
    found = (text or "json").strip().lower()
    if found not in FORMATS:
        raise ValueError(f"the format is one of {', '.join(FORMATS)}")
    return found


def limit_of(text: str | None, default: int) -> int:
    if text is None or not text.strip():
        return default
    if not re.fullmatch(r"\d+", text.strip()) or not int(text):
        raise ValueError("a limit is a positive whole number")
    return int(text)


def file_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("_") or "export"


def _two(c: str) -> Column:
    """Two places as C's printf has them: the double's exact value decides, and of ties the even digit. (Java's
    format_string rounds the shortest decimal half up.)"""
    return F.replace(F.format_number(F.col(c), 2), F.lit(","), F.lit(""))


def _line(*cells: Column) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in cells])


def limited(rows: DataFrame, limit: int, *by: str, order: tuple = ()) -> DataFrame:
    """The first ``limit`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(*(order or (F.desc("log_dice"), F.desc("freq"), "collocate")))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def sketch_lines(rows: DataFrame, limit: int) -> DataFrame:
    """Short lines of a sketch, limited for each relation and head."""
    return limited(rows, limit, "rel", "head").select(_line(F.col("rel"), F.col("head"), F.col("collocate"), F.col("freq"), _two("log_dice")).alias("line"))


def sketch_csv(rows: DataFrame, limit: int) -> DataFrame:
    return limited(rows, limit, "rel", "head").select(_line(F.col("rel"), F.col("head"), F.col("collocate"), F.col("pos"), F.col("freq"), _two("log_dice")).alias("value"))


def examples_csv(rows: DataFrame, seed: str, collocate: str, relation: str) -> DataFrame:
    return rows.select(_line(F.lit(seed), F.lit(collocate), F.lit(relation), F.col("sentence")).alias("value"))


def explore_csv(seeds: DataFrame, core: DataFrame, limit: int) -> DataFrame:
    """Two sections below one another, each limited: seeds' collocates, then core collocates with the seed's score."""
    a = seeds.orderBy(F.desc("log_dice"), "collocate").limit(limit).select(_line(F.lit("seed_collocate"), F.col("collocate"), _two("log_dice"), F.col("freq")).alias("value"))
    b = core.orderBy(F.desc("shared_by"), F.desc("avg_log_dice"), "collocate").limit(limit).select(_line(F.lit("core_collocate"), F.col("collocate"), _two("seed_log_dice"), F.col("shared_by")).alias("value"))
    return a.unionByName(b)


def comparison_csv(compared: DataFrame, limit: int) -> DataFrame:
    """The last column is the commonality, under the name that readers of this format know."""
    rows = compared.orderBy(F.desc("commonality"), "collocate").limit(limit)
    return rows.select(_line(F.col("collocate"), F.col("category"), F.col("present_in"), F.col("total_seeds"), _two("avg_log_dice"), _two("commonality")).alias("value"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def xml_elements(rows: DataFrame, tag: str, body: str | None = None) -> DataFrame:
    """An element for each row, its columns as attributes; ``body`` goes inside as CDATA, cut where it would end."""
    attrs = [F.concat(F.lit(f' {c}="'), xml_escape(F.col(c)), F.lit('"')) for c in rows.columns if c != body]
    if body is None:
        return rows.select(F.concat(F.lit(f"<{tag}"), *attrs, F.lit("/>")).alias("value"))
    inside = F.replace(F.coalesce(F.col(body), F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return rows.select(F.concat(F.lit(f"<{tag}"), *attrs, F.lit("><![CDATA["), inside, F.lit(f"]]></{tag}>")).alias("value"))


def explore_xml(seeds: DataFrame, core: DataFrame, limit: int) -> DataFrame:
    """The two sections of ``explore_csv`` as elements, each limited."""
    a = seeds.orderBy(F.desc("log_dice"), "collocate").limit(limit).select(F.col("collocate").alias("word"), _two("log_dice").alias("log_dice"), F.col("freq").alias("frequency"))
    b = core.orderBy(F.desc("shared_by"), F.desc("avg_log_dice"), "collocate").limit(limit).select(F.col("collocate").alias("word"), _two("seed_log_dice").alias("log_dice"), "shared_by")
    return xml_elements(a, "seed_collocate").unionByName(xml_elements(b, "core_collocate"))


def comparison_xml(compared: DataFrame, limit: int) -> DataFrame:
    """The columns of ``comparison_csv`` as attributes."""
    rows = compared.orderBy(F.desc("commonality"), "collocate").limit(limit)
    named = rows.select(F.col("collocate").alias("word"), "category", "present_in", F.col("total_seeds").alias("total_nouns"), _two("avg_log_dice").alias("avg_logdice"), _two("commonality").alias("coverage"))
    return xml_elements(named, "collocate")


def document(rows: DataFrame, header: str | None = None, root: str | None = None) -> str:
    """A page of lines as one text, with a header line (CSV) or within a root element (XML)."""
    lines = [r["value"] for r in rows.collect()]
    if root:
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>\n' + "".join(f"  {x}\n" for x in lines) + f"</{root}>\n"
    return "".join(f"{x}\n" for x in ([header] if header else []) + lines)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)


def page_json(**parts) -> str:
    """A response: tables become lists of objects, the rest stays."""
    return json.dumps({k: [json.loads(r["value"]) for r in as_json(v).collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}, ensure_ascii=False)
