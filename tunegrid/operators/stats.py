"""Statistical comparison of strategies over per-user scores (wide frames id_user, a, b, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def head_to_head(df: DataFrame, a: str, b: str) -> DataFrame:
    share = lambda cond: F.avg(cond.cast("double"))
    return df.agg(share(F.col(a) > F.col(b)).alias("a_wins"), share(F.col(b) > F.col(a)).alias("b_wins"), share(F.col(a) == F.col(b)).alias("ties"), F.median(F.col(a) - F.col(b)).alias("median_diff"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference, its 95 % interval (normal quantile), t and Cohen's d."""
    d = F.col(a) - F.col(b)
    row = df.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return row.select("n", "mean", (F.col("mean") - 1.96 * se).alias("low"), (F.col("mean") + 1.96 * se).alias("high"), F.try_divide(F.col("mean"), se).alias("t"), F.try_divide(F.col("mean"), F.col("sd")).alias("d"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """(correlation) by Pearson: NaN where one column never varies, null without rows."""
    row = df.agg(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), F.covar_pop(a, b).alias("cov"), *[F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))).alias(f"sd_{k}") for k, (x, y) in enumerate(((a, b), (b, a)))])
    found = F.coalesce(F.try_divide(F.col("cov"), F.col("sd_0") * F.col("sd_1")), F.lit(float("nan")))
    return row.select(F.round(F.when(F.col("n") > 0, found), 5).alias("correlation"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed ranks, zeros ranked and dropped (Pratt), ties averaged, with the normal approximation.

    Ranks come from counts per distinct absolute difference and their running sum, so no task
    sorts the users; only the distinct differences pass through one window.
    """
    d = df.select(F.round(F.col(a) - F.col(b), 9).alias("d"))
    steps = d.groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    steps = steps.withColumn("rank", F.sum("n").over(Window.orderBy("m")) - (F.col("n") - 1) / 2)
    sums = steps.agg(
        F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum(F.col("down") * F.col("rank")).alias("w_minus"), F.sum("n").alias("n"), F.sum(F.when(F.col("m") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("m") > 0, F.col("n") * F.col("n") * F.col("n") - F.col("n")).otherwise(0)).alias("ties"),
    )
    n, z = F.col("n").cast("double"), F.col("zeros").cast("double")
    mean = (n * (n + 1) - z * (z + 1)) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - F.col("ties") / 2) / 24
    return sums.select("n", "w_plus", "w_minus", F.try_divide(F.least("w_plus", "w_minus") - mean, F.sqrt(var)).alias("z"))


def best_strategy(df: DataFrame, names: list[str]) -> DataFrame:
    """Users by their best strategy, the first named winning ties."""
    best = F.greatest(*[F.struct(F.col(n).alias("v"), F.lit(-k).alias("p"), F.lit(n).alias("name")) for k, n in enumerate(names)])
    return df.select(best["name"].alias("strategy")).groupBy("strategy").agg(F.count("*").alias("users"))


def combo_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Users by the set of strategies in which they reach that strategy's 75th percentile (and a positive score)."""
    cuts = df.agg(*[F.percentile(n, 0.75).alias(f"c_{n}") for n in names])
    good = F.array_compact(F.array(*[F.when((F.col(n) >= F.col(f"c_{n}")) & (F.col(n) > 0), F.lit(n)) for n in names]))
    return df.crossJoin(F.broadcast(cuts)).select(F.array_join(good, "+").alias("combination"), F.size(good).cast("long").alias("strategies")).groupBy("combination", "strategies").agg(F.count("*").alias("users"))


def spread(names: list[str]) -> Column:
    """Population standard deviation across columns."""
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    return F.sqrt(sum(((F.col(n) - mean) * (F.col(n) - mean) for n in names), F.lit(0.0)) / len(names))


def consensus(df: DataFrame, names: list[str]) -> DataFrame:
    """Users whose scores differ no more than the 33rd percentile of the differences."""
    rows = df.select("id_user", F.round(spread(names), 9).alias("spread"))
    return rows.crossJoin(F.broadcast(rows.agg(F.percentile("spread", 0.33).alias("cut")))).select("id_user", F.round("spread", 6).alias("spread"), (F.col("spread") <= F.col("cut")).alias("agree"))


def poor_performers(df: DataFrame, names: list[str], reference: str) -> DataFrame:
    cut = df.agg(F.percentile(reference, 0.25).alias("cut"))
    worst = F.greatest(*[F.col(n) for n in names])
    return df.crossJoin(F.broadcast(cut)).where(worst < F.col("cut")).select("id_user")


def ensemble_sim(df: DataFrame, names: list[str], weights: list[float]) -> DataFrame:
    """Mean, maximum and weighted ensembles of the scores, with the gain over the best single strategy."""
    cols = [F.col(n) for n in names]
    kinds = {"average": sum(cols, F.lit(0.0)) / len(cols), "maximum": F.greatest(*cols), "weighted": sum((w * c for w, c in zip(weights, cols, strict=True)), F.lit(0.0)) / sum(weights)}
    row = df.agg(*[F.avg(v).alias(k) for k, v in kinds.items()], F.greatest(*[F.avg(c) for c in cols]).alias("best"))
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("ensemble"), F.col(k).alias("mean"), (F.col(k) - F.col("best")).alias("gain")) for k in kinds]))
    return row.select(entries.alias("e")).select("e.ensemble", "e.mean", "e.gain")


def segments(df: DataFrame, size: str, names: list[str]) -> DataFrame:
    """Means by right-closed bins of size: up to 20, 50, 100, 200 and above."""
    bin_ = F.when(F.col(size) <= 20, "<=20").when(F.col(size) <= 50, "21-50").when(F.col(size) <= 100, "51-100").when(F.col(size) <= 200, "101-200").otherwise(">200")
    best = F.greatest(*[F.struct(F.avg(n).alias("v"), F.lit(-k).alias("p"), F.lit(n).alias("name")) for k, n in enumerate(names)])
    return df.groupBy(bin_.alias("segment")).agg(F.count("*").alias("users"), *[F.avg(n).alias(n) for n in names], best["name"].alias("best"))
