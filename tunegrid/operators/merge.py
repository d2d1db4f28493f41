"""Keyed merges under explicit conflict policies, and queue transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("new", "coalesce_new", "coalesce_old", "greatest", "sticky")


def merge(old: DataFrame, new: DataFrame, keys: list[str], policies: dict[str, str], sticky: tuple[str, ...] = ("done",)) -> DataFrame:
    """old with new upserted by keys; policies gives each other column's rule on a conflict.

    new: the new row's value wins, even null; coalesce_new / coalesce_old: the first non-null
    with the new / old value first; greatest: the larger; sticky: an old value listed in
    `sticky` stays. Columns are keys and those named. Both sides must be unique by keys.
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    rows = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")

    def value(c: str, policy: str) -> Column:
        a, b, here = F.col(f"o.{c}"), F.col(f"n.{c}"), F.col("n._new").isNotNull()
        rule = {
            "new": F.when(here, b).otherwise(a), "coalesce_new": F.coalesce(b, a), "coalesce_old": F.coalesce(a, b), "greatest": F.greatest(a, b),
            "sticky": F.when(a.isin(*sticky), a).when(here, b).otherwise(a) if policy == "sticky" else None,
        }
        return rule[policy].alias(c)

    key = [F.when(F.col("n._new").isNotNull(), F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys]
    return rows.select(*key, *[value(c, p) for c, p in policies.items()])


def claim(queue: DataFrame, size: int) -> DataFrame:
    """queue with its next `size` pending rows (highest priority, then oldest) in processing and one more attempt."""
    chosen = queue.where("status = 'pending'").orderBy(F.desc("priority"), F.asc("updated_at"), F.asc("id")).limit(size).select("id").withColumn("_hit", F.lit(True))
    rows = queue.join(chosen, "id", "left")
    return rows.select("id", F.when(F.col("_hit"), "processing").otherwise(F.col("status")).alias("status"), "priority", (F.col("attempts") + F.coalesce(F.col("_hit").cast("int"), F.lit(0))).alias("attempts"), "updated_at")


def finish(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """queue with outcomes (id, error) applied: done without an error, else error with its first 500 characters; other rows stay as they are."""
    rows = queue.join(outcomes.withColumn("_hit", F.lit(True)), "id", "left")
    status = F.when(~F.coalesce("_hit", F.lit(False)), F.col("status")).when(F.col("error").isNull(), "done").otherwise("error")
    error = F.when(F.coalesce("_hit", F.lit(False)), F.left("error", F.lit(500))).otherwise(F.col("last_error"))
    return rows.withColumns({"status": status, "last_error": error}).drop("_hit", "error")


def set_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): insert or delete, to turn old links into new."""
    return new.select(*keys).distinct().join(old, keys, "left_anti").withColumn("change", F.lit("insert")).unionByName(old.select(*keys).distinct().join(new, keys, "left_anti").withColumn("change", F.lit("delete")))


def renumber(rows: DataFrame, key: str, order: list[str], blank: str) -> DataFrame:
    """position from 1 without gaps in input order; rows whose `blank` column is empty are dropped."""
    kept = rows.where(F.coalesce(F.trim(F.col(blank)), F.lit("")) != "")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def backfill(queue: DataFrame, entities: DataFrame, status: str = "pending") -> DataFrame:
    """queue with the ids of entities that it lacks."""
    missing = entities.select("id").distinct().join(queue, "id", "left_anti")
    blank = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in queue.schema.fields}
    blank |= {"id": F.col("id"), "status": F.lit(status).alias("status")}
    return queue.unionByName(missing.select(*[blank[f.name] for f in queue.schema.fields]))
