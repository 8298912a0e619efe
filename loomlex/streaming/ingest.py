"""An extension: CoNLL-U files as they arrive, parsed and counted by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlex.sources import conllu


def records(spark: SparkSession, path: str, files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.option("lineSep", "\n\n").option("maxFilesPerTrigger", files_a_trigger).text(path)


def lemmas(rows: DataFrame) -> DataFrame:
    line = rows.select(F.explode(conllu.lines_of(F.col("value"))).alias("line"))
    return line.select(F.lower(F.try_element_at(F.split("line", "\t"), F.lit(3))).alias("lemma_lc")).where("lemma_lc is not null")


def running_frequencies(rows: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Lemma frequencies so far, in memory under ``name``; each trigger updates what changed."""
    counts = lemmas(rows).groupBy("lemma_lc").agg(F.count("*").alias("freq"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def into_corpus(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each trigger's files become documents of the saved corpus at ``path``, with their frequencies beside them."""
    from loomlex.sources.corpus import Corpus

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.select(F.lit(f"batch-{number}").alias("source"), F.monotonically_increasing_id().alias("ord"), "value")
        tokens = conllu.parse(batch).persist()
        Corpus.of(tokens).save(path, "append")
        tokens.unpersist()

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
