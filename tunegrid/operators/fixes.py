"""Change sets over several tables: planned, counted, applied, and committed as one new version of all of them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A change is (target, id, action): delete a queue's row, reset it, or enqueue an id that it may lack.
ACTIONS = ("delete", "reset", "enqueue")


def planned(issues: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(target, id, action) for issues (category, id); rules gives each category's target and action, others need none.

    An id that several issues name in one table is changed once: deleted rather than reset, reset rather than enqueued.
    """
    bad = [a for _, a in rules.values() if a not in ACTIONS]
    if bad:
        raise ValueError(f"unknown actions: {bad}")
    table = F.create_map(*[F.lit(x) for k, (t, _) in rules.items() for x in (k, t)])
    weight = F.create_map(*[F.lit(x) for k, (_, a) in rules.items() for x in (k, ACTIONS.index(a))])
    known = issues.where(F.col("category").isin(*rules) & F.col("id").isNotNull())
    first = known.groupBy(F.element_at(table, F.col("category")).alias("target"), "id").agg(F.min(F.element_at(weight, F.col("category"))).alias("w"))
    return first.select("target", "id", F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("w") + 1).alias("action"))


def dry_run(queues: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """(target, action, n): the rows that applying the changes would delete, reset or insert and reset; ids that a delete or reset does not find count nothing."""
    out = None
    for name, queue in queues.items():
        mine = changes.where(F.col("target") == name)
        found = mine.join(queue.select("id").withColumn("_there", F.lit(True)), "id", "left").where((F.col("action") == "enqueue") | F.col("_there"))
        counts = found.groupBy("target", "action").agg(F.count("*").alias("n"))
        out = counts if out is None else out.unionByName(counts)
    return out


def applied(queues: dict[str, DataFrame], changes: DataFrame, now: int) -> dict[str, DataFrame]:
    """The queues after the changes: rows deleted; reset and enqueued ones pending, without attempts and error, updated now."""
    out = {}
    for name, queue in queues.items():
        mine = changes.where(F.col("target") == name).select(F.col("id").alias("_id"), "action")
        there = queue.withColumn("_there", F.lit(True))
        rows = there.join(mine, there["id"] == mine["_id"], "full_outer").where("(action is null or action <> 'delete') and (_there or action = 'enqueue')")
        hit = F.col("action").isNotNull()
        values = {"id": F.coalesce("id", "_id"), "status": F.when(hit, "pending").otherwise(F.col("status")), "attempts": F.when(hit, 0).otherwise(F.col("attempts")), "last_error": F.when(~hit, F.col("last_error")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
        plain = {"priority": F.coalesce("priority", F.lit(0))} if "priority" in queue.columns else {}
        out[name] = rows.select(*[(values | plain).get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in queue.schema.fields])
    return out


# --- Versions ------------------------------------------------------------------------------------------------------


def current(spark: SparkSession, folder: str) -> int:
    """The last committed version, 0 without one."""
    try:
        return spark.read.schema("version long").json(f"{folder}/versions").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return 0


def read_version(spark: SparkSession, folder: str, names: list[str], version: int | None = None) -> dict[str, DataFrame]:
    version = current(spark, folder) if version is None else version
    return {name: spark.read.parquet(f"{folder}/{name}/version={version}") for name in names}


def commit(tables: dict[str, DataFrame], folder: str) -> int:
    """Write all tables as the next version and then say so: until the last step readers see the version before, whatever fails."""
    spark = next(iter(tables.values())).sparkSession
    version = current(spark, folder) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/version={version}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{folder}/versions")
    return version
