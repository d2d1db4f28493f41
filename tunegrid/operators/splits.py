"""Splits, padding, validation and small merges of the learning and serving paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrid.operators.features import dense_ids
from tunegrid.operators.fusion import portable_hash


def clamped(rating: Column) -> Column:
    """A rating on its scale of 0 to 5."""
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), rating))


def valid_ratings(raw: DataFrame, text: str) -> DataFrame:
    """Rows whose text is a positive number, with it as `rating`, clamped; others fall away."""
    value = F.trim(F.col(text)).try_cast("double")
    return raw.withColumn("rating", clamped(value)).where((value > 0) & ~F.isnan(value))


def least_test_split(rated: DataFrame, share: float, least: int, seed: int = 31) -> DataFrame:
    """(id_user, id_release, part): the last max(least, round(n * share)) in hash order are test, but train is never empty.

    Rounding is to the even number, as in the reference's language.
    """
    w = Window.partitionBy("id_user")
    n = F.count("*").over(w)
    order = w.orderBy(portable_hash(F.col("id_user"), F.col("id_release"), seed), "id_release")
    test = F.least(n - 1, F.greatest(F.lit(least), F.bround(n * share, 0).cast("long")))
    return rated.select("id_user", "id_release", F.when(F.row_number().over(order) > n - test, "test").otherwise("train").alias("part"))


def chunks(users: DataFrame, parts: int) -> DataFrame:
    """(id_user, chunk): near-equal slices of the users by id, numbered from 0.

    Users are numbered inside ranges of the id; only the ranges' sizes are summed in one place, so no
    task holds all users.
    """
    numbered = dense_ids(users.select("id_user"), "id_user", "place")
    total = F.lit(users.count())
    small, more = F.floor(total / parts), total % parts
    place = F.col("place")
    edge = more * (small + 1)
    return numbered.select("id_user", F.when(place < edge, F.floor(place / (small + 1))).otherwise(more + F.floor((place - edge) / F.greatest(small, F.lit(1)))).cast("long").alias("chunk"))


def modal_dimension(vectors: DataFrame) -> DataFrame:
    """(dim, n): the most common vector length, the smaller on ties."""
    sizes = vectors.where("vector is not null").groupBy(F.size("vector").cast("long").alias("dim")).agg(F.count("*").alias("n"))
    return sizes.agg(F.max(F.struct("n", (-F.col("dim")).alias("back"))).alias("m")).select((-F.col("m.back")).alias("dim"), "m.n")


def padded(values: Column, size: int, fill: int = 0) -> Column:
    """The array cut or filled to size."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill).cast("long"), size)), 1, size)


def overlap(lists: DataFrame, a: str, b: str) -> DataFrame:
    """(id_user, both, only_a, only_b) of two strategies' lists (id_user, strategy, id_release)."""
    sides = lists.where(F.col("strategy").isin(a, b)).groupBy("id_user", "id_release").agg(F.max(F.when(F.col("strategy") == a, 1).otherwise(0)).alias("x"), F.max(F.when(F.col("strategy") == b, 1).otherwise(0)).alias("y"))
    return sides.groupBy("id_user").agg(F.sum(F.col("x") * F.col("y")).alias("both"), F.sum(F.col("x") * (1 - F.col("y"))).alias("only_a"), F.sum((1 - F.col("x")) * F.col("y")).alias("only_b"))


def reset_users(interactions: DataFrame, users: DataFrame) -> DataFrame:
    """Interactions without those of the users reset."""
    return interactions.join(users.select("id_user").distinct(), "id_user", "left_anti")


def get_or_create(known: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id, created): known (id, name) by exact name; names not known, once each without regard to case, numbered on behind the largest id.

    Of names that differ only in case the least is created. New names are a small part of a crawl's batch;
    they are numbered in order, by the sizes of the groups that share their first two characters.
    """
    found = names.select("name").distinct().join(known.select("name", "id"), "name", "left")
    old = found.where("id is not null").select("name", "id", F.lit(False).alias("created"))
    new = found.where("id is null").groupBy(F.lower("name").alias("folded")).agg(F.min("name").alias("name")).select("name")
    most = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = new.withColumn("head", F.left("name", F.lit(2)))
    before = new.groupBy("head").agg(F.count("*").alias("n")).select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("head").orderBy("name"))
    numbered = new.withColumn("place", place).join(before, "head").select("name", (F.col("before") + F.col("place") + most).cast("long").alias("id"), F.lit(True).alias("created"))
    return old.unionByName(numbered)


def retry_waits(attempts: DataFrame, base: float, cap: float) -> DataFrame:
    """attempts (id, attempt, retry_after) with the seconds to wait: base * 2^(attempt - 1) up to cap; a Retry-After wins."""
    return attempts.withColumn("wait", F.coalesce(F.col("retry_after").cast("double"), F.least(F.lit(cap), base * F.pow(F.lit(2.0), F.col("attempt") - 1))))


def bucket_waits(arrivals: DataFrame, key: str, at: str, capacity: float, per_second: float) -> DataFrame:
    """(key, at, tokens): a token bucket run over each key's arrivals in order: tokens left after each, negative ones being owed."""
    ordered = arrivals.groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("ats"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(float(capacity)).alias("left"), F.array().cast(f"array<struct<at:{dict(arrivals.dtypes)[at]},tokens:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        refilled = F.least(F.lit(float(capacity)), s["left"] + F.coalesce((x.cast("double") - s["last"]) * per_second, F.lit(0.0))) - 1
        return F.struct(x.cast("double").alias("last"), refilled.alias("left"), F.concat(s["out"], F.array(F.struct(x.alias("at"), refilled.alias("tokens")))).alias("out"))

    return ordered.select(key, F.explode(F.aggregate("ats", start, step)["out"]).alias("o")).select(key, F.col("o.at").alias(at), F.col("o.tokens").alias("tokens"))


def progress(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of old with the columns that new names: null in new keeps what is stored; keys of new only are added."""
    a, b = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns]), new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns])
    return a.join(b, keys, "full").select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in columns])


def readiness(vectors: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(rows, wanted, missing, ready): whether every wanted key has a vector."""
    have = vectors.where("vector is not null").select(key).distinct().withColumn("_v", F.lit(1))
    counted = wanted.select(key).distinct().join(have, key, "left").agg(F.count("*").alias("wanted"), F.count("_v").alias("found"))
    total = vectors.count()
    return counted.select(F.lit(total).cast("long").alias("rows"), "wanted", (F.col("wanted") - F.col("found")).alias("missing"), (F.col("wanted") == F.col("found")).alias("ready"))
