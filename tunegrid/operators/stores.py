"""Differences between two stores, and samples that hold what they refer to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest(df: DataFrame) -> Column:
    """64 bits of a row's values; a null differs from any value, and from a null in another column."""
    return F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("{}")) for c in df.columns])


def differing_buckets(old: DataFrame, new: DataFrame, keys: list[str], buckets: int = 256) -> DataFrame:
    """(bucket) of keys whose rows differ between the stores: counts and digest sums of each bucket, one pass over either side, no rows exchanged."""
    def summed(df: DataFrame, side: int) -> DataFrame:
        digest = _digest(df.select(*sorted(df.columns)))
        rows = df.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), digest.alias("d"), F.lit(side).alias("side"))
        return rows.groupBy("bucket", "side").agg(F.count("*").alias("n"), F.sum(F.col("d").cast("decimal(38,0)")).alias("s"), F.bit_xor("d").alias("x"))

    both = summed(old, 0).unionByName(summed(new, 1)).groupBy("bucket").agg(F.count("*").alias("sides"), F.count_distinct("n", "s", "x").alias("kinds"))
    return both.where("sides = 1 or kinds > 1").select("bucket")


def difference(old: DataFrame, new: DataFrame, keys: list[str], buckets: int = 256) -> DataFrame:
    """(keys, change, columns): rows added, removed or changed from old to new, unique by keys; columns names what changed.

    Only rows in differing buckets meet, so two stores that are nearly alike cost a scan of each. Null keys are equal to null keys.
    """
    others = [c for c in old.columns if c not in keys]
    few = F.broadcast(differing_buckets(old, new, keys, buckets))  # at most `buckets` rows
    a, b = (df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).join(few, "bucket", "left_semi").drop("bucket").withColumn("_here", F.lit(True)).alias(side) for df, side in ((old, "o"), (new, "n")))
    rows = a.join(b, reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]), "full_outer")
    gone, come = F.col("n._here").isNull(), F.col("o._here").isNull()
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in others]))
    change = F.when(come, "added").when(gone, "removed").when(F.size(changed) > 0, "changed")
    names = F.when(come | gone, F.lit("")).otherwise(F.array_join(changed, ","))
    found = rows.select(*[F.when(come, F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys], change.alias("change"), names.alias("columns"))
    return found.where("change is not null")


#: A reference: rows of table refer by column to rows of parent by its key.
Link = tuple[str, str, str, str]


def closed_sample(full: dict[str, DataFrame], chosen: dict[str, DataFrame], links: list[Link]) -> dict[str, DataFrame]:
    """Samples of all tables that hold the chosen rows and every row that they refer to, directly or through others.

    Tables are closed parents last, so each is read once; a cycle of references is refused. A reference that the full store does not
    hold, or null, adds nothing; a row that is chosen and referred to is there once.
    """
    left, order = set(full), []
    while left:
        free = sorted(t for t in left if not any(child in left and child != t for child, _, parent, _ in links if parent == t))
        if not free or any(child == parent for child, _, parent, _ in links):
            raise ValueError("references form a cycle")
        order += free
        left -= set(free)
    out: dict[str, DataFrame] = {}
    for table in order:
        refer = [(child, column, key) for child, column, parent, key in links if parent == table]
        wanted = full[table].where("false")
        if refer:
            keys = {key for *_, key in refer}
            for key in sorted(keys):
                asked = reduce(DataFrame.unionByName, [out[child].select(F.col(column).alias(key)) for child, column, k in refer if k == key]).distinct()
                wanted = wanted.unionByName(full[table].join(asked, key, "left_semi"))
        if table in chosen:
            wanted = wanted.unionByName(chosen[table].select(*full[table].columns))
        out[table] = wanted.distinct()
    return out


def orphans_of(sample: dict[str, DataFrame], links: list[Link]) -> DataFrame:
    """(child, column, n): references of the sample that it does not hold."""
    found = []
    for child, column, parent, key in links:
        missing = sample[child].where(F.col(column).isNotNull()).join(sample[parent].select(F.col(key).alias(column)), column, "left_anti")
        found.append(missing.agg(F.count("*").alias("n")).select(F.lit(child).alias("child"), F.lit(column).alias("column"), "n"))
    return reduce(DataFrame.unionByName, found)
