"""User vectors as weighted means of item vectors, and top items by cosine or dot product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.operators.inner_product import top_inner_products


def user_vectors(positives: DataFrame, vectors: DataFrame, min_positives: int = 20) -> DataFrame:
    """(id_user, vector): mean of the positives' vectors weighted by max(0.1, rating / 5), scaled to length one.

    Users below min_positives have none. A zero mean becomes the uniform vector.
    """
    enough = positives.groupBy("id_user").agg(F.count("*").alias("n")).where(F.col("n") >= min_positives).select("id_user")
    rows = positives.join(enough, "id_user", "left_semi").join(vectors, "id_release")
    parts = rows.groupBy("id_user").agg(F.collect_list(F.struct(F.greatest(F.lit(0.1), F.col("rating") / 5).alias("w"), F.col("vector").alias("v"))).alias("p"))
    zero = F.transform(F.get("p", F.lit(0))["v"], lambda x: F.lit(0.0))
    total = F.aggregate("p", zero, lambda s, e: F.zip_with(s, e["v"], lambda a, b: a + e["w"] * b))
    parts = parts.select("id_user", total.alias("t"))
    norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda s, x: s + x * x))
    parts = parts.withColumn("norm", norm)
    return parts.select("id_user", F.when(F.col("norm") > 0, F.transform("t", lambda x: x / F.col("norm"))).otherwise(F.transform("t", lambda x: 1 / F.sqrt(F.size("t").cast("double")))).alias("vector"))


def vector_validity(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(id_release, valid): the vector exists, has dim finite elements and a positive norm."""
    sound = (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return vectors.select("id_release", F.coalesce(sound & F.exists("vector", lambda x: x != 0), F.lit(False)).alias("valid"))


def recommend_vectors(users: DataFrame, items: DataFrame, interactions: DataFrame, limit: int = 9, dim: int = 64, block: int | None = None, metric: str = "cosine") -> DataFrame:
    """Top items by cosine, or by dot product of the vectors as they are, among those the user has not interacted with.

    Item vectors of another dimension or zero norm are skipped. Items meet the users in blocks, exchanged, not held by the driver.
    """
    sound = items.where((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        sound = sound.withColumn("norm", norm).select("id_release", F.transform("vector", lambda x: x / F.col("norm")).alias("vector"))
    return top_inner_products(users, sound, interactions, limit, block)
