"""Exact de-duplication by sorting content.

Normalised bytes are range-partitioned by sampled splitters, each partition is sorted externally so that equal
texts stand next to each other, and one streaming pass compares every text with its neighbour in full. The range
key is a short prefix of the bytes, their digest and the identifier: all of one width, so that what the sampler
sends to the driver doesn't depend on the texts' lengths, and a run of equal texts, however long, is cut over as
many partitions as it needs. Runs that touch a partition's edge are joined again by a full comparison of the
edges' texts, of which there are two a partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Bytes of the text in the range key.
PREFIX_BYTES = 48


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norm = pc.ascii_lower(pc.fill_null(b.column(1), "")).cast(pa.binary())
        values = norm.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                norm,
                pa.array([v[:PREFIX_BYTES] for v in values], pa.binary()),
                pa.array([hashlib.sha256(v).digest() for v in values], pa.binary()),
                b.column(2),
            ],
            ["id", "norm", "prefix", "digest", "row"],
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; the texts of the first and last run go along for the edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    before: bytes | None = None
    run, place = -1, 0
    held: tuple | None = None  # the last row seen; whether it ends the partition is known only later
    names = ["id", "row", "part", "run", "place", "sha", "edge"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for b in batches:
        rows = []
        for doc, norm, digest, row in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if norm != before:
                run, before = run + 1, norm
            if held is not None:
                rows.append(held)
            held = (doc, row, part, run, place, digest.hex(), norm if place == 0 else None)
            place += 1
        if rows:
            yield out(rows)
    if held is not None:
        yield out([(*held[:6], before)])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", partitions: int | None = None, row_col: str | None = None) -> DataFrame:
    """Groups of rows whose texts are equal after lower-casing A-Z.

    keep: the row of the ``smallest`` or the ``largest`` identifier of a group stays. Returns one row for each row of
    ``docs``: id, row (what ``row_col`` holds, a whole number, or null), keep_id, group_size, kept, sha (hex digest of
    the normalised UTF-8 bytes). A null text counts as an
    empty one; a null identifier comes after all others when choosing. Where an identifier occurs twice in a group,
    one of its rows stays. An empty table gives no rows; further columns of ``docs`` are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    spark = docs.sparkSession
    runtime.prepare(spark)
    n = partitions or runtime.shuffle_partitions(spark)
    rows = runtime.rows_of(docs, id_col, text_col, row_col)
    rows = rows.mapInArrow(_normalise, "id long, norm binary, prefix binary, digest binary, row long")
    ordered = rows.repartitionByRange(n, "prefix", "digest", "id").sortWithinPartitions("prefix", "digest", "norm", "id")
    placed = runtime.materialise(ordered.mapInArrow(_runs, "id long, row long, part int, run long, place long, sha string, edge binary"), "runs")

    best = F.max if keep == "largest" else F.min
    rank = F.struct(F.col("id").isNotNull().alias("known") if keep == "largest" else F.col("id").isNull().alias("unknown"), "id", "part", "place")
    runs = placed.groupBy("part", "run").agg(best(rank).alias("best"), F.count("*").alias("size"))
    edges = placed.where(F.col("edge").isNotNull()).select("part", "run", "edge").distinct()
    first = edges.groupBy("edge").agg(F.min(F.struct("part", "run")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    spanning = edges.join(first, "edge").select("part", "run", "lead")
    runs = runs.join(spanning, ["part", "run"], "left").withColumn("lead", F.coalesce("lead", F.struct("part", "run")))
    whole = runs.groupBy("lead").agg(best("best").alias("best"), F.sum("size").alias("size"))
    runs = runs.select("part", "run", "lead").join(whole, "lead").select("part", "run", "best", "size")
    return placed.join(runs, ["part", "run"]).select(
        "id",
        "row",
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("part") == F.col("best.part")) & (F.col("place") == F.col("best.place"))).alias("kept"),
        "sha",
    )
