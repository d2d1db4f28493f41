"""Audits of the stored data, and samples of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.functions.text import error_class
from tunegrid.operators.ranking import popularity_order

# Severity by error class.
SEVERITY = {"not_found": "low", "rate_limited": "medium", "timeout": "medium", "incomplete_read": "medium", "connection": "medium", "unknown": "high", "other": "high"}


def queue_errors(queue: DataFrame) -> DataFrame:
    """(kind, severity, n): rows in error by class."""
    kinds = F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (k, v)])
    rows = queue.where("status = 'error'").groupBy(error_class("last_error").alias("kind")).agg(F.count("*").alias("n"))
    return rows.select("kind", F.element_at(kinds, F.col("kind")).alias("severity"), "n")


def queue_issues(queue: DataFrame) -> DataFrame:
    """(category, id, detail): each row in error with its class and the first 500 characters of its error."""
    return queue.where("status = 'error'").select(error_class("last_error").alias("category"), "id", F.left("last_error", F.lit(500)).alias("detail"))


def mismatch(entities: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, expected, stored) where fewer rows are stored than expected; stored rows are counted before the join."""
    counts = stored.groupBy(key).agg(F.count("*").alias("n"))
    rows = entities.join(counts, key, "left").select(key, "expected", F.coalesce("n", F.lit(0)).cast("long").alias("stored"))
    return rows.where("expected > stored")


def orphans(links: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Links that miss their left or their right side."""
    x = left.select(a).distinct().withColumn("_l", F.lit(True))
    y = right.select(b).distinct().withColumn("_r", F.lit(True))
    return links.join(x, a, "left").join(y, b, "left").where("_l is null or _r is null").drop("_l", "_r")


def report(checks: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(category, severity, n, sample) over issue frames, worst first; sample holds the least and the greatest row as JSON."""
    from functools import reduce

    def one(category: str, severity: str, df: DataFrame) -> DataFrame:
        text = F.left(F.to_json(F.struct(*df.columns)), F.lit(120))
        return df.agg(F.count("*").alias("n"), F.array(F.min(text), F.max(text)).alias("sample")).select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), "n", "sample")

    rows = reduce(DataFrame.unionByName, [one(*c) for c in checks]).where("n > 0")
    return rows.orderBy(F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2), "category")


def top_releases(releases: DataFrame, n: int) -> DataFrame:
    return releases.orderBy(*popularity_order()).limit(n).select("id_release")


def sample_pairs(pairs: DataFrame, rated: DataFrame, n: int) -> DataFrame:
    """The n strongest pairs whose sides are both rated."""
    ids = rated.select("id_release").distinct()
    both = pairs.join(ids.withColumnRenamed("id_release", "id_release_1"), "id_release_1", "left_semi").join(ids.withColumnRenamed("id_release", "id_release_2"), "id_release_2", "left_semi")
    return both.orderBy(F.desc("pair_count"), F.desc_nulls_last("jaccard"), F.desc_nulls_last("lift"), "id_release_1", "id_release_2").limit(n)


def sample_interactions(interactions: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    rows = interactions.join(kept, "id_release", "left_semi")
    return rows.orderBy(F.desc("rating"), F.desc("rating_date"), "id_user", "id_release").limit(n)


def sample_users(users: DataFrame, kept: DataFrame, signals: DataFrame, least: int, roles: list[str]) -> DataFrame:
    """Users with enough ratings or a chosen role, who have kept interactions."""
    rows = users.join(signals, "id_user", "left").where((F.coalesce("n", F.lit(0)) >= least) | F.col("role").isin(roles))
    return rows.join(kept, "id_user", "left_semi").select("id_user", "role")
