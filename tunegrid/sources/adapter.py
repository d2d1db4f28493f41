"""Domain views of the star-schema tables: users rate releases by artists in genres."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrid.sources.staging import staged

#: The fixed "today" of all recency terms.
AS_OF = "2001-09-01"
POSITIVE = 3.0


class Catalogue:
    """Lazy domain frames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def settled(self) -> Catalogue:
        """This catalogue with the latest ratings and the releases computed once, for queries that read them several times."""
        if "_settled" not in self.__dict__:
            self._settled = Catalogue(self.spark, self.sf_dir)
            self._settled.interactions = staged(self.by_user(), "interactions")
            self._settled.releases = staged(self._settled.releases, "releases")
            self._settled._settled = self._settled
        return self._settled

    def with_models(self, vectors: DataFrame | None = None, towers: DataFrame | None = None) -> Catalogue:
        """This catalogue with item vectors (id_release, vector) of trained models in place of those of the tables."""
        fed = Catalogue(self.spark, self.sf_dir)
        fed.__dict__.update({k: v for k, v in self.__dict__.items() if not k.startswith("_")})
        fed.__dict__.update({k: v for k, v in (("vectors", vectors), ("towers", towers)) if v is not None})
        return fed

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def all_ratings(self) -> DataFrame:
        """Every rating event: several per user and release."""
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.col("o_custkey").alias("id_user"), F.col("l_partkey").alias("id_release"), "o_orderdate", "l_orderkey", "l_linenumber", "l_quantity"
        )

    @cached_property
    def interactions(self) -> DataFrame:
        """The latest rating of each user and release; a maximum, so partial sums precede the shuffle."""
        return self._latest(self.all_ratings)

    def by_user(self) -> DataFrame:
        """The interactions, each user's in one place: for tables that are stored and then read by user. One exchange, not one for each grouping."""
        return self.__dict__["interactions"] if "interactions" in self.__dict__ else self._latest(self.all_ratings.repartition("id_user"))

    @staticmethod
    def _latest(ratings: DataFrame) -> DataFrame:
        last = F.max(F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_quantity")).alias("last")
        rows = ratings.groupBy("id_user", "id_release").agg(last)
        return rows.select("id_user", "id_release", (F.floor(F.col("last.l_quantity") / 5) / 2).cast("double").alias("rating"), F.col("last.o_orderdate").cast("date").alias("rating_date"))

    @cached_property
    def positives(self) -> DataFrame:
        return self.interactions.where(F.col("rating") >= POSITIVE)

    @cached_property
    def releases(self) -> DataFrame:
        stats = self.interactions.where("rating > 0").groupBy("id_release").agg(F.count("*").alias("n"), F.avg("rating").alias("avg_rating"))
        return self.parts.join(stats, "id_release", "left").select(
            "id_release", "title", "artist_id", "release_type", "release_year", F.coalesce("n", F.lit(0)).cast("long").alias("ratings_count"), "avg_rating"
        )

    @cached_property
    def parts(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id_release"), F.col("p_name").alias("title"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("artist_id"),
            F.col("p_type").alias("release_type"), (F.col("p_size") + 1950).cast("long").alias("release_year"),
        )

    @cached_property
    def artists(self) -> DataFrame:
        return self.raw("part").select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("id_artist"), F.col("p_brand").alias("name")).distinct()

    @cached_property
    def _words(self) -> DataFrame:
        return self.parts.select("id_release", F.explode(F.array_distinct(F.split("title", " "))).alias("name"))

    @cached_property
    def genres(self) -> DataFrame:
        """id_genre is the word's place in the sorted list; the list is a dimension of a few words."""
        words = F.array_sort(F.collect_set("name"))
        return self._words.agg(words.alias("w")).select(F.posexplode("w").alias("id_genre", "name")).select((F.col("id_genre") + 1).cast("long").alias("id_genre"), "name")

    @cached_property
    def release_genres(self) -> DataFrame:
        return self._words.join(self.genres, "name").select("id_release", "id_genre")

    @cached_property
    def users(self) -> DataFrame:
        score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("c_acctbal") / 100))
        return self.raw("customer").select(F.col("c_custkey").alias("id_user"), F.col("c_mktsegment").alias("role"), score.alias("objectivity_score"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id_release"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))

    @cached_property
    def towers(self) -> DataFrame:
        """Item vectors of the second model, of length one: the differences of the first table's halves stand for a tower's output."""
        half = F.zip_with(F.slice("vector", 1, 32), F.slice("vector", 33, 32), lambda a, b: a - b)
        rows = self.vectors.where(F.size("vector") == 64).select("id_release", half.alias("h"))
        norm = F.sqrt(F.aggregate("h", F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.withColumn("norm", norm)
        return rows.select("id_release", F.transform("h", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(1 / F.sqrt(F.lit(32.0)))).alias("vector"))

    @cached_property
    def signals(self) -> DataFrame:
        """(id_user, n_pos) for users with any interaction."""
        return self.interactions.groupBy("id_user").agg(F.count_if(F.col("rating") >= POSITIVE).alias("n_pos"))
