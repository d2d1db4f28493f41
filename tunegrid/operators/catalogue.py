"""Histories, catalogue search and detail queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def user_collection(interactions: DataFrame, releases: DataFrame, artists: DataFrame) -> DataFrame:
    """Rated releases with title, artist and a display date, numbered newest first per user."""
    rows = interactions.where("rating > 0").join(releases.select("id_release", "title", "artist_id"), "id_release").join(artists.withColumnRenamed("name", "artist"), F.col("artist_id") == F.col("id_artist"))
    place = F.row_number().over(Window.partitionBy("id_user").orderBy(F.desc("rating_date"), F.asc("id_release"))).cast("long")
    return rows.select("id_user", place.alias("place"), "id_release", "title", "artist", "rating", F.date_format("rating_date", "dd/MM/yyyy").alias("rated_on"))


def history(interactions: DataFrame, condition: str) -> DataFrame:
    """(id_user, id_release, place) of the interactions that meet condition, newest first."""
    w = Window.partitionBy("id_user").orderBy(F.desc("rating_date"), F.asc("id_release"))
    return interactions.where(condition).select("id_user", "id_release", F.row_number().over(w).cast("long").alias("place"))


def catalogue_filter(query: str | None = None, artist: str | None = None, genre: int | None = None, year: int | None = None, kind: str | None = None) -> Column:
    """AND of the given filters over title, artist, genres, release_year and release_type; text is matched literally, ignoring case."""
    parts = [F.lit(True)]
    if query:
        parts.append(F.lower("title").contains(query.lower()) | F.lower("artist").contains(query.lower()))
    if artist:
        parts.append(F.lower("artist").contains(artist.lower()))
    if genre is not None:
        parts.append(F.array_contains("genres", F.lit(genre).cast("long")))
    if year is not None:
        parts.append(F.col("release_year") == year)
    if kind:
        parts.append(F.lower("release_type") == kind.lower())
    return reduce(lambda a, b: a & b, parts)


def searchable(releases: DataFrame, artists: DataFrame, release_genres: DataFrame) -> DataFrame:
    genres = release_genres.groupBy("id_release").agg(F.sort_array(F.collect_set("id_genre")).alias("genres"))
    return releases.join(artists.select(F.col("id_artist").alias("artist_id"), F.col("name").alias("artist")), "artist_id", "left").join(genres, "id_release", "left")


def search(catalogue: DataFrame, limit: int, offset: int = 0, **filters) -> DataFrame:
    """A page of matches by popularity, ties by title; a negative offset counts as 0."""
    order = [F.desc_nulls_last("ratings_count"), F.desc_nulls_last("avg_rating"), F.asc("title"), F.asc("id_release")]
    return catalogue.where(catalogue_filter(**filters)).orderBy(*order).offset(max(0, offset)).limit(limit)


def release_details(ids: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Details of (pos, id_release) in input order; missing releases fall away."""
    return ids.join(catalogue, "id_release").select("pos", "id_release", "title", "artist", "release_type", "release_year", "ratings_count", "avg_rating")


def releases_by_artist(releases: DataFrame) -> DataFrame:
    w = Window.partitionBy("artist_id").orderBy(F.desc_nulls_last("release_year"), F.asc("title"), F.asc("id_release"))
    return releases.select("artist_id", F.row_number().over(w).cast("long").alias("place"), "id_release", "title", "release_year")


def artists_enriched(artists: DataFrame, releases: DataFrame, release_genres: DataFrame, genres: DataFrame) -> DataFrame:
    """Artists with the sorted distinct names of their releases' genres; an empty array without any."""
    names = releases.select("id_release", "artist_id").join(release_genres, "id_release").join(genres, "id_genre").groupBy("artist_id").agg(F.sort_array(F.collect_set("name")).alias("g"))
    return artists.join(names, artists.id_artist == names.artist_id, "left").select("id_artist", artists["name"], F.coalesce("g", F.array().cast("array<string>")).alias("genres"))
