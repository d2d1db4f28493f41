"""Item and user neighbourhoods by cosine of user-centred ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunegrid.operators.ranking import top_per_user


def neighbours(rated: DataFrame, item: str, over: str, min_item: int, min_over: int, k: int = 30) -> DataFrame:
    """(item, neighbour, similarity, rank): cosine of `item` rows over `over`, ratings centred by user, both supports on raw counts.

    Ratings are scaled by their item's norm first, so that the sum over a co-rated pair is the cosine. The pairs are exchanged
    once, to their item, where they are summed and ranked; they are hardly ever equal within a task, so nothing is summed before.
    """
    rows = rated.withColumn("x", F.col("rating") - F.avg("rating").over(Window.partitionBy("id_user")))
    for key, least in ((item, min_item), (over, min_over)):
        enough = rated.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
        rows = rows.join(enough, key, "left_semi")
    norms = rows.groupBy(item).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 0")
    rows = rows.join(norms, item).select(item, over, (F.col("x") / F.col("norm")).alias("x"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col(f"a.{over}") == F.col(f"b.{over}")) & (F.col(f"a.{item}") != F.col(f"b.{item}"))).select(F.col(f"a.{item}").alias(item), F.col(f"b.{item}").alias("neighbour"), (F.col("a.x") * F.col("b.x")).alias("x"))
    sims = met.repartition(item).groupBy(item, "neighbour").agg(F.round(F.sum("x"), 9).alias("similarity"))
    return top_per_user(sims, k, F.desc("similarity"), F.asc("neighbour"), by=(item,))
