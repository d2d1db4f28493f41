"""Intermediate tables that several parts of one query read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local-mode session without it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if getattr(spark, "_tunegrid_stages", None) is None:
        spark._tunegrid_stages = f"file://{tempfile.mkdtemp(prefix='tunegrid-')}"
    return spark._tunegrid_stages


def _on_disk(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: With this setting the shuffle files of a query are deleted at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Computed once, and cuts the lineage: a lost executor costs a reread, not a recomputation. The table goes
    with release(), else when the driver's JVM ends. The shuffle files behind it go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tunegrid-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    where, files = _on_disk(spark, path)
    files.deleteOnExit(where)
    read = spark.read.schema(df.schema).parquet(path)
    read._tunegrid_path = path
    return read


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        where, files = _on_disk(df.sparkSession, df._tunegrid_path)
        files.delete(where, True)


def numbered(rows: DataFrame, parts: int, *order: Column, name: str = "number") -> DataFrame:
    """rows with their place from 1 under order, which must tell rows apart: one range exchange, no task numbers all of them.

    A partition's rows are numbered where they lie; the counts of the partitions before it, a row for each, are added.
    """
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The partition's number in the upper bits, the row's place there in the lower 33.
    dealt = staged(sorted_rows.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__at", 33))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = F.sum("n").over(Window.orderBy("__part")) - F.col("n")
    offsets = sizes.select("__part", (before - F.col("first") + 1).alias("__offset"))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__offset")).drop("__at", "__part", "__offset")
