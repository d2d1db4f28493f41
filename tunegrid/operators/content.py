"""Profiles of genres and artists, and the content recommender."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrid.operators.ranking import by_score, signal_weight, top_per_user
from tunegrid.sources.adapter import AS_OF, POSITIVE
from tunegrid.sources.staging import staged

#: Users whose pools one task makes and ranks, near enough.
TASK_USERS = 8_192
#: Weights that a task holds at once, as a table of users and genres or artists.
TABLE_CELLS = 1 << 22


def profile_genres(positives: DataFrame, release_genres: DataFrame) -> DataFrame:
    """(id_user, id_genre, weight): a release's signal is split evenly over its genres."""
    counted = release_genres.withColumn("n_genres", F.count("*").over(Window.partitionBy("id_release")))
    return positives.join(counted, "id_release").groupBy("id_user", "id_genre").agg(F.sum(signal_weight() / F.col("n_genres")).alias("weight"))


def profile_artists(positives: DataFrame, releases: DataFrame) -> DataFrame:
    return positives.join(releases.select("id_release", "artist_id"), "id_release").where("artist_id > 0").groupBy("id_user", "artist_id").agg(F.sum(signal_weight()).alias("weight"))


def _facts(releases: DataFrame, release_genres: DataFrame, *more: Column) -> DataFrame:
    """A row per release with its artist, genres (null: none) and more columns; read by several steps, so computed once."""
    genre_list = release_genres.groupBy("id_release").agg(F.sort_array(F.collect_list("id_genre")).alias("genres"))
    return staged(releases.select("id_release", "artist_id", *more).join(genre_list, "id_release", "left"), "facts")


def _offers(facts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(side, key, ids): the `size` lowest ids of each genre and artist, and the facts of the releases offered.

    The lowest of a union lie among the lowest of its parts, so no pool needs more: the offers and the facts are as large as the
    dimensions of genres and artists, not as the catalogue.
    """
    none = F.array().cast("array<bigint>")
    keys = {"genre": facts.select("id_release", F.explode(F.coalesce("genres", none)).alias("key")), "artist": facts.where("artist_id > 0").select("id_release", F.col("artist_id").alias("key"))}
    kept = [top_per_user(rows.withColumn("side", F.lit(side)), size, F.asc("id_release"), by=("side", "key")) for side, rows in keys.items()]
    offers = staged(kept[0].unionByName(kept[1]).groupBy("side", "key").agg(F.sort_array(F.collect_list("id_release")).alias("ids")), "offers")
    offered = staged(facts.join(offers.select(F.explode("ids").alias("id_release")).distinct(), "id_release", "left_semi"), "offered")
    return offers, offered


def _profiles(interactions: DataFrame, facts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """One row per user: genre and artist weights as maps and the candidate pool; and the facts of all candidates.

    A pool is made where its user's row lies, from one row of offers, so that no exchange carries pools or profiles.
    """
    users, offers, offered = _people(interactions, facts, size)
    none = F.array().cast("array<bigint>")
    entries = [F.map_from_entries(F.collect_list(F.when(F.col("side") == side, F.struct("key", "ids")))).alias(f"{side}_offers") for side in ("genre", "artist")]

    def pool(profile: str, side: str) -> Column:
        ids = F.flatten(F.transform(F.map_keys(profile), lambda k: F.coalesce(F.try_element_at(f"{side}_offers", k), none)))
        return F.slice(F.array_sort(F.array_distinct(ids)), 1, size)

    users = users.crossJoin(F.broadcast(offers.agg(*entries))).select("id_user", "g", "a", F.array_except(F.array_union(pool("g", "genre"), pool("a", "artist")), "known").alias("pool"))
    return users, offered


def _people(interactions: DataFrame, facts: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row per user: genre and artist weights as maps and the offered releases that they know; the offers; and the facts of the releases offered.

    Only the liked rows meet the catalogue, and only those of releases that are offered are needed as seen ones.
    """
    offers, offered = _offers(facts, size)
    none = F.array().cast("array<bigint>")
    # A liked release travels to its user as one weight and its genres; the releases offered that the user knows go with them.
    liked = interactions.where(F.col("rating") >= POSITIVE).join(facts.select("id_release", "artist_id", "genres"), "id_release")
    liked = liked.select("id_user", F.struct(F.coalesce("genres", none).alias("genres"), F.when(F.col("artist_id") > 0, F.col("artist_id")).alias("artist"), signal_weight().alias("w")).alias("like"), F.lit(None).cast("bigint").alias("known"))
    known = interactions.join(offered.select("id_release"), "id_release", "left_semi").select("id_user", F.lit(None).cast(liked.schema["like"].dataType).alias("like"), F.col("id_release").alias("known"))
    # Users have pools of one size, so a task's share of users bounds what it sorts.
    parts = max(1, -(-interactions.agg(F.approx_count_distinct("id_user")).first()[0] // TASK_USERS))
    rows = liked.unionByName(known).where("id_user is not null").repartition(parts, "id_user").groupBy("id_user").agg(F.collect_list("like").alias("likes"), F.collect_list("known").alias("known"))
    of_genres = F.flatten(F.transform("likes", lambda e: F.transform(e["genres"], lambda g: F.struct(g.alias("k"), (e["w"] / F.size(e["genres"])).alias("w")))))
    of_artists = F.transform(F.filter("likes", lambda e: e["artist"].isNotNull()), lambda e: F.struct(e["artist"].alias("k"), e["w"].alias("w")))
    users = rows.select("id_user", "known", of_genres.alias("g"), of_artists.alias("a"))

    def summed(entries: str) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
        add = lambda k: F.aggregate(F.filter(entries, lambda e: e["k"] == k), F.lit(0.0), lambda s, e: s + e["w"])
        return F.map_from_arrays(keys, F.transform(keys, add))

    users = users.where((F.size("g") > 0) | (F.size("a") > 0)).select("id_user", "known", summed("g").alias("g"), summed("a").alias("a"))
    return users, offers, offered


def candidate_pool(interactions: DataFrame, releases: DataFrame, release_genres: DataFrame, limit: int = 9) -> DataFrame:
    """(id_user, id_release): up to 5 * limit releases by genre and as many by artist, without those interacted with."""
    return _profiles(interactions, _facts(releases, release_genres), 5 * limit)[0].select("id_user", F.explode("pool").alias("id_release"))


def recommend_content(interactions: DataFrame, releases: DataFrame, release_genres: DataFrame, limit: int = 9, genre_weight: float = 1.0, artist_weight: float = 0.8, prior: float = 0.3) -> DataFrame:
    """Top pool releases by profile weights of their genres and artist plus a popularity prior."""
    age = F.year(F.lit(AS_OF).cast("date")) - F.col("release_year")
    fresh = F.coalesce(F.greatest(F.lit(0.0), 1.0 - age / 50.0), F.lit(0.0))
    liked = 0.6 * (F.coalesce("avg_rating", F.lit(0.0)) / 5) + 0.3 * F.log1p(F.coalesce("ratings_count", F.lit(0)).cast("double")) + 0.1 * fresh
    profiles, offers, offered = _people(interactions, _facts(releases, release_genres, (prior * liked).alias("prior")), 5 * limit)
    keys = [F.map_keys("g").alias("g"), F.map_values("g").alias("gw"), F.map_keys("a").alias("a"), F.map_values("a").alias("aw")]
    facts = offered.select("id_release", "artist_id", "prior", "genres").toArrow()
    shared = offered.sparkSession.sparkContext.broadcast((facts, offers.toArrow()))
    kinds = {k: t.schema[k].dataType.simpleString() for t, k in ((profiles, "id_user"), (offered, "id_release"))}
    rows = profiles.select("id_user", *keys, "known").mapInArrow(_ranked(shared, limit, 5 * limit, genre_weight, artist_weight), ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", score double")
    return by_score(rows, limit)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of each element of lists."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _table(some: pa.RecordBatch, key: str, known: np.ndarray) -> np.ndarray:
    """Each user's weights of the known keys, and a last column of zeros for others."""
    (row, keys), weights = _flat(some.column(key)), some.column(f"{key}w").flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((some.num_rows, len(known) + 1))
    at = np.searchsorted(known, keys)
    met = np.append(known, 0)[at] == keys if len(known) else np.zeros(len(keys), bool)
    met &= at < len(known)
    out[row[met], at[met]] = weights[met]
    return out


def _pools(some: pa.RecordBatch, ids: np.ndarray, offers: dict[str, dict[int, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, release) of each user's pool: the size lowest ids of all genres' offers and of all artists', without those known; offers are places among ids."""
    sides = [(offers[side], some.column(key).to_pylist()) for side, key in (("genre", "g"), ("artist", "a"))]
    known, none, out = some.column("known").to_pylist(), np.empty(0, np.int64), []
    for row in range(some.num_rows):
        pool = np.zeros(len(ids), bool)
        for offered, keys in sides:
            mark = np.zeros(len(ids), bool)
            for key in keys[row]:
                mark[offered.get(key, none)] = True
            pool[np.flatnonzero(mark)[:size]] = True
        seen = np.array(known[row], np.int64)
        at = np.searchsorted(ids, seen)
        pool[at[at < len(ids)][ids[at[at < len(ids)]] == seen[at < len(ids)]]] = False
        out.append(np.flatnonzero(pool))
    return np.repeat(np.arange(len(out)), [len(x) for x in out]), ids[np.concatenate([none, *out])]


def _ranked(shared, limit: int, size: int, genre_weight: float, artist_weight: float) -> Callable:
    """Users' profiles to the candidates of their pools that can be among the first limit once scores are rounded: pools and their profiles are never rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, offers = shared.value[0].sort_by("id_release").combine_chunks(), {"genre": {}, "artist": {}}
        ids, prior = facts["id_release"].to_numpy(), facts["prior"].to_numpy()
        single = np.unique(ids)
        for side, key, listed in zip(*(shared.value[1][k].to_pylist() for k in ("side", "key", "ids")), strict=True):
            offers[side][key] = np.searchsorted(single, listed)
        of, genre = _flat(facts["genres"].combine_chunks())
        artists = pc.fill_null(facts["artist_id"], 0).to_numpy()
        genres, genre_at = np.unique(genre, return_inverse=True)
        known, artist_at = np.unique(artists, return_inverse=True)
        # The genres of a release side by side, in their order; places without one lead to the column of zeros.
        place = np.arange(len(of)) - np.searchsorted(of, of)
        wide = np.full((len(ids), place.max(initial=-1) + 1), len(genres))
        wide[of, place] = genre_at
        step = max(1, min(2_048, TABLE_CELLS // (len(genres) + len(known) + 2)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                some = batch.slice(lo, step)
                user, wanted = _pools(some, single, offers, size)
                first = np.searchsorted(ids, wanted)
                times = np.searchsorted(ids, wanted, side="right") - first
                user = np.repeat(user, times)
                at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(len(user))
                by_genre, by_artist = _table(some, "g", genres), _table(some, "a", known)
                total = np.zeros(len(user))
                for column in wide.T:
                    total = total + by_genre[user, column[at]]
                score = genre_weight * total + artist_weight * by_artist[user, artist_at[at]] + prior[at]
                order = np.lexsort((-score, user))
                user, at, score = user[order], at[order], score[order]
                begin = np.searchsorted(user, user)
                last = np.minimum(begin + limit, np.searchsorted(user, user, side="right")) - 1
                # Scores that rounding may make equal to the last one stay.
                kept = score >= score[last] - 1e-8
                yield pa.RecordBatch.from_arrays([some.column("id_user").take(pa.array(user[kept])), facts["id_release"].combine_chunks().take(pa.array(at[kept])), pa.array(score[kept])], names=["id_user", "id_release", "score"])

    return run
