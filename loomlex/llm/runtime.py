"""What every operator here needs from the session: a shared scratch folder, Arrow batch limits, the package on the workers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlex import workers

#: Rows of an Arrow batch. Texts can be long, so batches are kept short; Spark's own byte limit applies too.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, which are made when a result is read and so must stay bounded, and give the workers this
    package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    workers.ship(spark)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set and executors are threads of the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("loomlex.scratch", None) or tempfile.mkdtemp(prefix="loomlex-")
        spark.conf.set("loomlex.scratch", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/loomlex/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that other columns of the table, whatever their names, can't clash."""
    return docs.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def rows_of(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """id, text and row, a number that tells rows of one identifier apart, or null where no column holds one."""
    row = F.col(f"`{row_col}`") if row_col else F.lit(None)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), row.cast("long").alias("row"))


def purge(spark: SparkSession) -> None:
    """Delete all scratch data under the session's shared folder and the tables of blocks there: to be called when no
    result that reads them is open."""
    for t in spark.catalog.listTables():
        if t.name.startswith("loomlex_blocks_"):
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/loomlex")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
