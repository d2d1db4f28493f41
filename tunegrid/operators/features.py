"""Training features, matrices, samples and the factor model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.operators.fusion import portable_hash
from tunegrid.sources.staging import numbered, staged


def eligible(rated: DataFrame, min_user: int, min_item: int) -> DataFrame:
    """Ratings of users and items with enough ratings, both on raw counts."""
    rows = rated
    for key, least in (("id_user", min_user), ("id_release", min_item)):
        enough = rated.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
        rows = rows.join(enough, key, "left_semi")
    return rows


def eligible_matrix(rated: DataFrame, min_user: int, min_item: int) -> DataFrame:
    """(u, i, rating): the eligible ratings with dense ids from 0, the places in the sorted distinct ids."""
    # Counts, both numberings and the result read the ratings: they and the eligible ones are computed once.
    rows = staged(eligible(staged(rated, "rated"), min_user, min_item), "eligible")
    u, i = dense_ids(rows.select("id_user").distinct(), "id_user", "u"), dense_ids(rows.select("id_release").distinct(), "id_release", "i")
    return rows.join(u, "id_user").join(i, "id_release").select("u", "i", "rating")


def dense_ids(ids: DataFrame, key: str, name: str, per_task: int = 1_000_000) -> DataFrame:
    """key to its place from 0 among the distinct keys: sorted by ranges, each range numbered where it lies, so no task numbers all."""
    placed = numbered(ids.select(key), max(1, -(-ids.count() // per_task)), F.col(key), name="_place")
    return placed.select(key, (F.col("_place") - 1).alias(name))


def item_features(releases: DataFrame, release_genres: DataFrame, types: DataFrame) -> DataFrame:
    genres = release_genres.groupBy("id_release").agg(F.sort_array(F.collect_list("id_genre")).alias("g"))
    rows = releases.join(genres, "id_release", "left").join(F.broadcast(types), "release_type", "left")
    return rows.select(
        "id_release", "artist_id", F.coalesce("type_idx", F.lit(0)).cast("long").alias("type_idx"), F.coalesce(F.array_join(F.transform("g", lambda x: x.cast("string")), ","), F.lit("")).alias("genres"),
        F.round(F.coalesce((F.col("release_year") - 1900) / 200.0, F.lit(0.5)), 6).alias("year"), F.round(F.coalesce(F.col("avg_rating") / 5, F.lit(0.0)), 6).alias("avg"),
        F.round(F.log1p(F.col("ratings_count").cast("double")), 6).alias("popularity"),
    )


def user_features(users: DataFrame, signals: DataFrame, roles: DataFrame) -> DataFrame:
    rows = users.join(signals, "id_user", "left").join(F.broadcast(roles), "role", "left")
    return rows.select(
        "id_user", F.coalesce("role_idx", F.lit(0)).cast("long").alias("role_idx"), F.round(F.coalesce("objectivity_score", F.lit(50.0)) / 100, 6).alias("objectivity"),
        F.round(F.log1p(F.coalesce("n", F.lit(0)).cast("double")), 6).alias("ratings"),
        F.round(F.least(F.lit(1.0), F.coalesce("days", F.lit(0)) / 7300.0), 6).alias("age"),
    )


def negative_samples(positives: DataFrame, releases: DataFrame, per_positive: int = 3, seed: int = 5) -> DataFrame:
    """(id_user, positive, n, negative): hash-drawn releases of the whole catalogue other than the positive; they may be other positives.

    Releases are numbered by id; a draw is a number of steps, less than their count, on from the positive's, so every other
    release can be met.
    """
    numbered = dense_ids(releases.select("id_release").distinct(), "id_release", "place")
    items = F.lit(numbered.count())
    rows = positives.select("id_user", F.col("id_release").alias("positive")).join(numbered.select(F.col("id_release").alias("positive"), "place"), "positive")
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(per_positive))))
    drawn = portable_hash(F.col("id_user"), F.col("positive"), seed) * 31 + F.col("n") * 7907
    rows = rows.withColumn("place", F.pmod(F.col("place") + 1 + F.pmod(drawn, items - 1), items))
    return rows.join(numbered.select(F.col("id_release").alias("negative"), "place"), "place").select("id_user", "positive", F.col("n").cast("long").alias("n"), "negative")


def als_factors(rated: DataFrame, rank: int = 8, iterations: int = 5, seed: int = 42) -> DataFrame:
    """(kind, id, factors): non-negative alternating least squares on implicit feedback, ids of any size by their place among their kind."""
    from pyspark.ml.recommendation import ALS

    users = staged(dense_ids(rated.select("id_user").distinct(), "id_user", "u"), "als_users")
    items = staged(dense_ids(rated.select("id_release").distinct(), "id_release", "i"), "als_items")
    rows = rated.join(users, "id_user").join(items, "id_release").select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("rating").cast("float"))
    model = ALS(rank=rank, maxIter=iterations, seed=seed, nonnegative=True, implicitPrefs=True, userCol="u", itemCol="i", ratingCol="rating").fit(staged(rows, "als_ratings"))
    sides = (("user", model.userFactors, users, "u", "id_user"), ("item", model.itemFactors, items, "i", "id_release"))
    found = [factors.join(places, factors["id"] == places[place]).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col("features").alias("factors")) for kind, factors, places, place, key in sides]
    return found[0].unionByName(found[1])


def forest_best_strategy(features: DataFrame, columns: list[str], label: str, seed: int = 42) -> DataFrame:
    """Each row with the strategy a random forest predicts for it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    features = staged(features, "features")  # each tree level reads it again
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(features)
    steps = Pipeline(stages=[indexer, VectorAssembler(inputCols=columns, outputCol="_x"), RandomForestClassifier(featuresCol="_x", labelCol="_y", seed=seed, numTrees=20), IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)])
    return steps.fit(features).transform(features).select("id_user", label, "predicted")
