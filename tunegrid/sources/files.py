"""File sources and sinks: CSV results with resume, JSON charts, table copies, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_results(df: DataFrame, path: str) -> None:
    """Append rows as CSV with header; Spark's commit protocol takes the place of a lock file."""
    df.write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results read back leniently: fields that do not fit their type become null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def unprocessed(users: DataFrame, results: DataFrame, key: str = "id_user") -> DataFrame:
    """Users without a result yet, for resuming."""
    return users.join(results.select(key).distinct(), key, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def int_array(text: str) -> Column:
    """A JSON array's integers; bad JSON gives an empty array, other elements fall away."""
    items = F.from_json(F.col(text), "array<string>")
    return F.coalesce(F.array_compact(F.transform(items, lambda x: x.try_cast("bigint"))), F.array().cast("array<bigint>"))


def copy_table(df: DataFrame, path: str, keys: list[str], where: str | None = None, limit: int | None = None) -> None:
    """Filtered, the least row of each key, and of these the first limit in the keys' order, written as Parquet."""
    rows = df.where(where) if where else df
    every = F.struct(*[F.col(c) for c in df.columns])
    rows = rows.groupBy(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)]).agg(F.min(every).alias("_row")).select("_row.*")
    rows = rows.orderBy(*keys).limit(limit) if limit is not None else rows
    rows.write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(target)


def physical_statistics(table: DataFrame) -> DataFrame:
    """(files, rows, bytes, row_bytes) of a file-based table: row counts from the footers, sizes from the listing; no column is read."""
    per_file = table.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).groupBy("path").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return per_file.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("row_bytes", F.try_divide(F.col("bytes"), F.col("rows")))
