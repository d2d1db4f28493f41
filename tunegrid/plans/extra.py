"""Queries of validation, splits, small merges, waits and reports over the whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.operators import merge, splits
from tunegrid.operators.ranking import popularity_order, top_per_user
from tunegrid.plans import oracle as O
from tunegrid.plans.recommend import LIMIT, content_of, pairs_of
from tunegrid.plans.registry import register
from tunegrid.plans.upkeep import _QUEUE, queue_of
from tunegrid.sources import files
from tunegrid.sources.adapter import Catalogue

# What stands in a form field, by rating key.
_FIELD = "CASE WHEN l_partkey % 17 = 0 THEN 'none' WHEN l_partkey % 13 = 0 THEN '-1.5' WHEN l_partkey % 11 = 0 THEN ' 7.5 ' WHEN l_partkey % 7 = 0 THEN '' ELSE cast(l_linenumber AS string) || '.5' END"


def _fields(c: Catalogue) -> DataFrame:
    return c.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_FIELD).alias("field"))


register("valid_ratings", lambda c: splits.valid_ratings(_fields(c), "field").select("l_orderkey", "l_linenumber", "l_partkey", "rating"), f"""
    SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, least(5.0, v))::DOUBLE AS rating
    FROM (SELECT *, try_cast(trim({_FIELD.replace('AS string', 'AS varchar')}) AS DOUBLE) AS v FROM lineitem) WHERE v > 0""")
register("clamped_ratings", lambda c: c.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", splits.clamped((F.col("l_quantity") / 8 - 1).cast("double")).alias("rating")),
         "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, least(5.0, (l_quantity / 8 - 1)::DOUBLE)) AS rating FROM lineitem")
register("least_test_split", lambda c: splits.least_test_split(c.positives, 0.15, 2), f"""
    SELECT id_user, id_release, CASE WHEN r > n - least(n - 1, greatest(2, round_even(n * 0.15, 0)::BIGINT)) THEN 'test' ELSE 'train' END AS part FROM (
      SELECT id_user, id_release, count(*) OVER (PARTITION BY id_user) AS n,
             row_number() OVER (PARTITION BY id_user ORDER BY (id_user * 2654435761 + id_release * 40503 + {97 * 31}) % 1000003, id_release) AS r FROM pos)""")
register("user_chunks", lambda c: splits.chunks(c.users, 7), """
    SELECT id_user, (CASE WHEN p < more * (small + 1) THEN p // (small + 1) ELSE more + (p - more * (small + 1)) // small END)::BIGINT AS chunk
    FROM (SELECT id_user, row_number() OVER (ORDER BY id_user) - 1 AS p, count(*) OVER () // 7 AS small, count(*) OVER () % 7 AS more FROM usr)""")
register("modal_dimension", lambda c: splits.modal_dimension(c.vectors.withColumn("vector", F.when(F.col("id_release") % 9 == 0, F.slice("vector", 1, 32)).otherwise(F.col("vector")))), """
    SELECT dim::BIGINT AS dim, count(*) AS n FROM (SELECT CASE WHEN vec_id % 9 = 0 THEN 32 ELSE len(embedding) END AS dim FROM embeddings WHERE embedding IS NOT NULL) GROUP BY 1 ORDER BY n DESC, dim LIMIT 1""")
register("padded_genres", lambda c: c.release_genres.groupBy("id_release").agg(F.sort_array(F.collect_list("id_genre")).alias("g")).select("id_release", F.array_join(splits.padded(F.col("g"), 4).cast("array<string>"), ",").alias("genres")), """
    SELECT id_release, array_to_string(list_concat(g, [0, 0, 0, 0])[1:4], ',') AS genres FROM (SELECT id_release, list_sort(list(id_genre)) AS g FROM rg GROUP BY 1)""")


def _two_lists(c: Catalogue) -> DataFrame:
    c = c.settled()
    return pairs_of(c, LIMIT).select("id_user", F.lit("pairs").alias("strategy"), "id_release").unionByName(content_of(c, LIMIT).select("id_user", F.lit("content").alias("strategy"), "id_release"))


_TWO = f"SELECT id_user, 'pairs' AS strategy, id_release FROM ({O.rec_pairs(LIMIT)}) UNION ALL SELECT id_user, 'content', id_release FROM ({O.rec_content(LIMIT)})"
register("strategy_overlap", lambda c: splits.overlap(_two_lists(c), "pairs", "content"), """
    SELECT id_user, sum(x * y)::BIGINT AS "both", sum(x * (1 - y))::BIGINT AS only_a, sum((1 - x) * y)::BIGINT AS only_b FROM (
      SELECT id_user, id_release, max((strategy = 'pairs')::INT) AS x, max((strategy = 'content')::INT) AS y FROM two GROUP BY 1, 2) GROUP BY 1""", two=_TWO)
register("most_recommended", lambda c: top_per_user(_two_lists(c).groupBy("strategy", "id_release").agg(F.count("*").alias("n")), 5, F.desc("n"), F.asc("id_release"), by=("strategy",)), """
    SELECT strategy, id_release, count(*) AS n, row_number() OVER (PARTITION BY strategy ORDER BY count(*) DESC, id_release) AS rank FROM two GROUP BY 1, 2 QUALIFY rank <= 5""", two=_TWO)
register("reset_users", lambda c: splits.reset_users(c.interactions, c.users.where("id_user % 6 = 2")).select("id_user", "id_release", "rating", "rating_date"), "SELECT id_user, id_release, rating, rating_date FROM inter WHERE NOT (id_user % 6 = 2 AND id_user IN (SELECT id_user FROM usr))")
# Names as crawled: known titles, and new spellings of others that differ in case.
_KNOWN = "SELECT min(p_partkey) AS id, p_name AS name FROM part WHERE p_partkey % 3 <> 0 GROUP BY 2"
_CRAWLED = "SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part"


def _parts(c: Catalogue, sql: str) -> DataFrame:
    return c.spark.sql(sql.replace("FROM part", "FROM {part}"), part=c.raw("part"))


register("get_or_create_names", lambda c: splits.get_or_create(_parts(c, _KNOWN.replace("GROUP BY 2", "GROUP BY p_name")), _parts(c, _CRAWLED)), """
    SELECT name, id, false AS created FROM (SELECT DISTINCT name FROM crawled) JOIN known USING (name)
    UNION ALL SELECT name, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY name), true FROM (
      SELECT min(name) AS name FROM (SELECT DISTINCT name FROM crawled) ANTI JOIN known USING (name) GROUP BY lower(name))""", known=_KNOWN, crawled=_CRAWLED)
register("chart_list", lambda c: top_per_user(c.releases.where("ratings_count > 0"), 25, *popularity_order(), by=("release_year",)).select("release_year", "rank", "id_release"), """
    SELECT release_year, row_number() OVER (PARTITION BY release_year ORDER BY ratings_count DESC NULLS LAST, avg_rating DESC NULLS LAST, id_release DESC) AS rank, id_release FROM rel WHERE ratings_count > 0 QUALIFY rank <= 25""")


def _years(c: Catalogue) -> tuple[DataFrame, DataFrame]:
    by_year = c.parts.groupBy("release_year").agg(F.count("*").alias("n"))
    old = by_year.where("release_year % 4 != 0").select("release_year", F.col("n").alias("albums"), F.lit(None).cast("string").alias("status"))
    new = by_year.where("release_year % 3 != 0").select("release_year", F.when(F.col("release_year") % 2 == 0, F.col("n") + 1).alias("albums"), F.lit("done").alias("status"))
    return old, new


register("year_progress", lambda c: splits.progress(*_years(c), ["release_year"], ["albums", "status"]), """
    SELECT release_year, CASE WHEN release_year % 3 <> 0 AND release_year % 2 = 0 THEN n + 1 WHEN release_year % 4 <> 0 THEN n END AS albums, CASE WHEN release_year % 3 <> 0 THEN 'done' END AS status
    FROM (SELECT release_year, count(*) AS n FROM parts GROUP BY 1) WHERE release_year % 4 <> 0 OR release_year % 3 <> 0""")
register("vector_readiness", lambda c: splits.readiness(c.vectors, c.releases.where("ratings_count >= 25"), "id_release"), """
    SELECT (SELECT count(*) FROM embeddings) AS "rows", count(*) AS wanted, count(*) - count(vec_id) AS missing, count(*) = count(vec_id) AS ready
    FROM (SELECT id_release FROM rel WHERE ratings_count >= 25) LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings WHERE embedding IS NOT NULL) ON vec_id = id_release""")
register("retry_waits", lambda c: splits.retry_waits(c.raw("lineitem").select("l_orderkey", F.col("l_linenumber").alias("attempt"), F.when(F.col("l_partkey") % 10 == 0, F.col("l_quantity")).alias("retry_after")), 0.5, 20.0).select("l_orderkey", "attempt", "wait"),
         "SELECT l_orderkey, l_linenumber AS attempt, coalesce(CASE WHEN l_partkey % 10 = 0 THEN l_quantity::DOUBLE END, least(20.0, 0.5 * pow(2.0, l_linenumber - 1)))::DOUBLE AS wait FROM lineitem")
register("bucket_waits", lambda c: splits.bucket_waits(c.raw("orders").select("o_custkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day")), "o_custkey", "day", 3, 1 / 64).groupBy("o_custkey", "day").agg(F.round(F.min("tokens"), 6).alias("least")), """
    WITH RECURSIVE o AS (SELECT o_custkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INT AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE) AS k FROM orders),
    b AS (SELECT o_custkey, k, day, 2.0::DOUBLE AS tokens FROM o WHERE k = 1
      UNION ALL SELECT o.o_custkey, o.k, o.day, (least(3.0, b.tokens + (o.day - b.day) / 64.0) - 1)::DOUBLE FROM b JOIN o ON o.o_custkey = b.o_custkey AND o.k = b.k + 1)
    SELECT o_custkey, day, round(min(tokens), 6) AS "least" FROM b GROUP BY 1, 2""")
register("attempt_telemetry", lambda c: c.raw("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("slow"), F.round(F.avg("value"), 6).alias("mean")),
         "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS slow, round(avg(value), 6) AS mean FROM events GROUP BY 1")
register("parametrised_read", lambda c: c.spark.sql("SELECT p_partkey AS id_release, p_name AS title FROM {part} WHERE p_size >= :size AND p_brand = :brand", args={"size": 20, "brand": "Brand#13"}, part=c.raw("part")),
         "SELECT p_partkey AS id_release, p_name AS title FROM part WHERE p_size >= 20 AND p_brand = 'Brand#13'")
register("profile_columns", lambda c: c.users.select("id_user", "role", F.round("objectivity_score", 6).alias("objectivity_score")).join(c.interactions.groupBy("id_user").agg(F.min("rating_date").alias("first_seen"), F.max("rating_date").alias("last_seen"), F.count("*").alias("n")), "id_user", "left"), """
    SELECT id_user, role, round(objectivity_score, 6) AS objectivity_score, first_seen, last_seen, n FROM usr
    LEFT JOIN (SELECT id_user, min(rating_date) AS first_seen, max(rating_date) AS last_seen, count(*) AS n FROM inter GROUP BY 1) USING (id_user)""")


def _stats(c: Catalogue) -> DataFrame:
    """Rows stored and rows after the reduction to well-rated releases, by table."""
    kept = c.releases.where("ratings_count >= 20").select("id_release")
    tables = {"interactions": (c.interactions, c.interactions.join(kept, "id_release", "left_semi")), "releases": (c.parts, kept), "vectors": (c.vectors, c.vectors.join(kept, "id_release", "left_semi")), "tracks": (tracks := c.raw("lineitem").select(F.col("l_partkey").alias("id_release")), tracks.join(kept, "id_release", "left_semi"))}
    one = lambda name, full, less: full.agg(F.count("*").alias("full_rows")).crossJoin(F.broadcast(less.agg(F.count("*").alias("reduced_rows")))).select(F.lit(name).alias("name"), "full_rows", "reduced_rows")  # noqa: E731  one row each
    parts = [one(name, full, less) for name, (full, less) in tables.items()]
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    return found.withColumn("ratio", F.when(F.col("full_rows") > 0, F.concat(F.round(F.col("reduced_rows") * 100 / F.col("full_rows"), 0).cast("long").cast("string"), F.lit(" %"))).otherwise("N/D"))


register("reduction_summary", _stats, """
    SELECT name, full_rows, reduced_rows, CASE WHEN full_rows > 0 THEN round(reduced_rows * 100 / full_rows, 0)::BIGINT || ' %' ELSE 'N/D' END AS ratio FROM (
      SELECT 'interactions' AS name, count(*) AS full_rows, count(*) FILTER (id_release IN (SELECT id_release FROM kept)) AS reduced_rows FROM inter
      UNION ALL SELECT 'releases', count(*), (SELECT count(*) FROM kept) FROM parts
      UNION ALL SELECT 'vectors', count(*), count(*) FILTER (vec_id IN (SELECT id_release FROM kept)) FROM embeddings
      UNION ALL SELECT 'tracks', count(*), count(*) FILTER (l_partkey IN (SELECT id_release FROM kept)) FROM lineitem)""", kept="SELECT id_release FROM rel WHERE ratings_count >= 20")
def physical(c: Catalogue) -> DataFrame:
    """(name, files, rows, bytes, row_bytes) of each stored table from the files' footers and sizes: no column is read."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
    found = [files.physical_statistics(c.raw(name)).select(F.lit(name).alias("name"), "*") for name in names]
    return reduce(DataFrame.unionByName, found)


register("physical_statistics", lambda c: physical(c).select("name", "rows", (F.col("bytes") >= F.col("files") * 100).alias("sized")), " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, true AS sized FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")))
register("orphans_removed", lambda c: c.all_ratings.select("id_user", "id_release").distinct().join(c.users.where("id_user % 10 != 3").select("id_user"), "id_user", "left_semi").join(c.parts.where("id_release % 10 != 7").select("id_release"), "id_release", "left_semi").select("id_user", "id_release"),
         "SELECT DISTINCT o_custkey AS id_user, l_partkey AS id_release FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 3 AND l_partkey % 10 <> 7 AND o_custkey IN (SELECT c_custkey FROM customer) AND l_partkey IN (SELECT p_partkey FROM part)")


def _outcomes(c: Catalogue) -> DataFrame:
    """Every row in processing comes back: even ids well, odd ones with an error."""
    return queue_of(c).where("status = 'processing'").select("id", F.when(F.col("id") % 2 == 1, F.concat(F.lit("HTTP 500 at "), F.col("id").cast("string"))).alias("error"))


register("queue_finish", lambda c: merge.finish(queue_of(c).select("id", "status", "last_error"), _outcomes(c)).select("id", "status", "last_error"), """
    SELECT id, CASE WHEN status <> 'processing' THEN status WHEN id % 2 = 0 THEN 'done' ELSE 'error' END AS status,
           CASE WHEN status <> 'processing' THEN last_error WHEN id % 2 = 1 THEN 'HTTP 500 at ' || id END AS last_error FROM q""", q=_QUEUE)
