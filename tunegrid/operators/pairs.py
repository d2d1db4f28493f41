"""Co-occurrence of releases and the recommender built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.operators.ranking import by_score, signal_weight, top_per_user
from tunegrid.sources.staging import staged


#: Pairs of users' releases that one task counts, near enough: some 200 MB of its memory.
TASK_PAIRS = 1 << 20
#: Releases that are broadcast as hot ones, at most; one with fewer users than LEAST_HOT is never one.
HOT_RELEASES, LEAST_HOT = 50_000, 500


def release_pairs(positives: DataFrame, min_pair_count: int = 2) -> DataFrame:
    """(id_release_1, id_release_2, pair_count, jaccard, lift), both directions.

    lift is count / (n1 * n2), without the number of users. Each user's releases stand in one order, hot ones last by their
    number of users, and a release is sent with those after it, as one row: an unordered pair travels as one number to the release
    that comes first, where it is counted in tasks of TASK_PAIRS. So a release of many users meets only those of more.
    """
    rows = positives.select("id_user", "id_release").where("id_release is not null")
    total = rows.count()
    hot = rows.groupBy("id_release").agg(F.count("*").alias("n")).where(F.col("n") > max(LEAST_HOT, -(-total // HOT_RELEASES)))
    ordered = F.array_sort(F.collect_set(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "id_release")))["id_release"]
    liked = staged(rows.join(F.broadcast(hot), "id_release", "left").groupBy("id_user").agg(ordered.alias("ids")), "liked")
    base = liked.select(F.explode("ids").alias("id_release")).groupBy("id_release").agg(F.count("*").alias("n"))
    met = liked.agg(F.coalesce(F.sum(F.size("ids").cast("long") * (F.size("ids") - 1) / 2), F.lit(0)).cast("long")).first()[0]
    after = liked.where("id_user is not null").select("ids", F.posexplode("ids").alias("pos", "r1")).select("r1", F.slice("ids", F.col("pos") + 2, F.size("ids")).alias("rest"))
    dealt = after.where(F.size("rest") > 0).repartition(max(1, -(-met // TASK_PAIRS)), "r1")
    half = dealt.select("r1", F.explode("rest").alias("r2")).groupBy("r1", "r2").agg(F.count("*").alias("c")).where(F.col("c") >= min_pair_count)
    half = half.join(base.select(F.col("id_release").alias("r1"), F.col("n").alias("n1")), "r1").join(base.select(F.col("id_release").alias("r2"), F.col("n").alias("n2")), "r2")
    ratios = [F.col("c").alias("pair_count"), (F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias("jaccard"), (F.col("c") / (F.col("n1") * F.col("n2"))).alias("lift")]
    # Each row is turned into its two directions, so the counting above runs once.
    sides = F.explode(F.array(F.struct(F.col("r1").alias("x"), F.col("r2").alias("y")), F.struct(F.col("r2").alias("x"), F.col("r1").alias("y"))))
    return half.select(sides.alias("s"), *ratios).select(F.col("s.x").alias("id_release_1"), F.col("s.y").alias("id_release_2"), "pair_count", "jaccard", "lift")


def pair_scores(positives: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """(id_user, id_release, score, rank): targets of a user's strongest limit * 10 pair rows, scored and summed."""
    rows = positives.join(pairs, positives.id_release == pairs.id_release_1).drop("id_release")
    # From the cut on everything lies by user, so sums and ranks need no exchange of their own.
    rows = top_per_user(rows, limit * 10, F.desc("pair_count"), F.asc("id_release_1"), F.asc("id_release_2"), name="place")
    score = signal_weight() * F.col("pair_count") * (0.7 + 0.3 * F.col("lift")) * (0.5 + 0.5 * F.col("jaccard"))
    summed = rows.groupBy("id_user", F.col("id_release_2").alias("id_release")).agg(F.sum(score).alias("score"))
    return by_score(summed, limit)


def recommend_pairs(positives: DataFrame, interactions: DataFrame, pairs: DataFrame, limit: int = 9) -> DataFrame:
    """The first limit of the top 3 * limit targets that the user has not interacted with; the cut precedes the filter."""
    found = pair_scores(positives, pairs, limit * 3).drop("rank")
    # One row of history for each user meets the lists where they lie.
    seen = interactions.groupBy("id_user").agg(F.collect_list("id_release").alias("seen"))
    unseen = found.join(seen, "id_user", "left").where(F.coalesce(~F.array_contains("seen", F.col("id_release")), F.lit(True)))
    return by_score(unseen.select("id_user", "id_release", "score"), limit)
