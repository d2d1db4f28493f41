"""Streams of ratings: event-time counts, and upserts with refreshed user vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunegrid.operators.vectors import user_vectors


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per window and type; duplicates of an event id within the watermark count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert_ratings(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Merge each batch of (id_user, id_release, rating, rating_date) into versioned Parquet under table.

    The rating of the latest date wins, whichever batch brings it; of equal dates that of the later batch, then the higher.
    Batch k reads version k - 1 and writes version k, so a retried batch starts from the same state; the version before
    those two is deleted.
    """
    keys = ["id_user", "id_release"]

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, "rating", "rating_date").withColumn("new", F.lit(1))
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{table}/v{number - 1}").withColumn("new", F.lit(0)))
        last = rows.groupBy(*keys).agg(F.max(F.struct("rating_date", "new", "rating")).alias("m"))
        last.select(*keys, "m.rating", "m.rating_date").write.mode("overwrite").parquet(f"{table}/v{number}")
        if number > 1:
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/v{number - 2}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refreshed_vectors(interactions: DataFrame, touched: DataFrame, vectors: DataFrame, least: int = 20) -> DataFrame:
    """Vectors of the touched users only."""
    return user_vectors(interactions.where("rating >= 3").join(touched.select("id_user").distinct(), "id_user", "left_semi"), vectors, least)
