"""Ranks, limits and diversification of long (user, item, score) frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrid.sources.adapter import AS_OF


def recency(date: str | Column) -> Column:
    """1 / log2(age + 1) with an age of at least one day; 1 without a date."""
    age = F.greatest(F.lit(1.0), F.date_diff(F.lit(AS_OF).cast("date"), F.col(date) if isinstance(date, str) else date).cast("double"))
    return F.coalesce(1.0 / F.log2(age + 1), F.lit(1.0))


def signal_weight() -> Column:
    return F.greatest(F.lit(0.1), F.col("rating") / 5) * recency("rating_date")


def top_per_user(df: DataFrame, limit: int | Column, *order: Column, by: tuple[str, ...] = ("id_user",), name: str = "rank") -> DataFrame:
    """The first rows of each user under order, numbered from 1 in column name."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= limit)


def by_score(df: DataFrame, limit: int, by: tuple[str, ...] = ("id_user",)) -> DataFrame:
    """Top rows by score rounded to 9 places, ties by release."""
    rounded = df.withColumn("score", F.round("score", 9))
    return top_per_user(rounded, limit, F.desc("score"), F.asc("id_release"), by=by)


def popularity_order() -> list[Column]:
    return [F.desc_nulls_last("ratings_count"), F.desc_nulls_last("avg_rating"), F.desc("id_release")]


def diversify(ranked: DataFrame, releases: DataFrame, limit: int) -> DataFrame:
    """First one release of each artist in rank order, then the others; unknown artists count as others. Renumbers rank."""
    known = ranked.join(releases.select("id_release", "artist_id"), "id_release", "left")
    artist = F.when(F.col("artist_id") > 0, F.col("artist_id"))
    # By user once, for both windows: the join may have left the rows by release.
    known = known.repartition("id_user")
    first = F.row_number().over(Window.partitionBy("id_user", artist).orderBy("rank"))
    marked = known.withColumn("late", F.when(artist.isNotNull() & (first == 1), 0).otherwise(1)).withColumnRenamed("rank", "pos")
    return top_per_user(marked, limit, F.asc("late"), F.asc("pos")).drop("late", "pos", "artist_id")
