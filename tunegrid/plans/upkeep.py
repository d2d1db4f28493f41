"""Queries of data health, sampling and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.operators import health, merge
from tunegrid.plans.recommend import pair_table, rounded
from tunegrid.plans.registry import register
from tunegrid.sources.adapter import Catalogue

# The crawl queue's states and errors by key.
_STATUS = "CASE id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN 'error' WHEN 3 THEN 'processing' ELSE 'pending' END"
_ERROR = "CASE WHEN id % 5 = 2 THEN CASE id % 7 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'Too many requests' WHEN 2 THEN 'Read timeout' WHEN 3 THEN 'IncompleteRead(0 bytes)' WHEN 4 THEN 'Connection reset' WHEN 5 THEN '' ELSE 'odd page' END END"
_QUEUE = f"SELECT id_user AS id, {_STATUS.replace('id %', 'id_user %')} AS status, id_user % 4 AS priority, {_ERROR.replace('id %', 'id_user %')} AS last_error, id_user % 3 AS attempts, id_user * 37 % 101 AS updated_at FROM usr"


def queue_of(c: Catalogue) -> DataFrame:
    rows = c.users.select(F.col("id_user").alias("id"))
    return rows.selectExpr("id", f"{_STATUS} AS status", "id % 4 AS priority", f"{_ERROR} AS last_error", "id % 3 AS attempts", "id * 37 % 101 AS updated_at")


def expected_of(c: Catalogue) -> DataFrame:
    stored = c.interactions.groupBy("id_user").agg(F.count("*").alias("n"))
    return c.users.join(stored, "id_user", "left").select("id_user", (F.coalesce("n", F.lit(0)) + F.col("id_user") % 3).alias("expected"))


def release_expected(c: Catalogue) -> DataFrame:
    return c.releases.select("id_release", (F.col("ratings_count") + F.when(F.col("id_release") % 11 == 0, 1).otherwise(0)).alias("expected"))


register("queue_errors", lambda c: health.queue_errors(queue_of(c)), """
    SELECT kind, CASE kind WHEN 'not_found' THEN 'low' WHEN 'unknown' THEN 'high' WHEN 'other' THEN 'high' ELSE 'medium' END AS severity, count(*) AS n FROM (
      SELECT CASE WHEN coalesce(last_error, '') = '' THEN 'unknown' WHEN contains(lower(last_error), '404') THEN 'not_found' WHEN contains(lower(last_error), '429') OR contains(lower(last_error), 'too many') THEN 'rate_limited'
        WHEN contains(lower(last_error), 'timeout') THEN 'timeout' WHEN contains(lower(last_error), 'incomplet') THEN 'incomplete_read' WHEN contains(lower(last_error), 'connection') OR contains(lower(last_error), 'reset') THEN 'connection' ELSE 'other' END AS kind
      FROM q WHERE status = 'error') GROUP BY 1""", q=_QUEUE)
register("incomplete_profiles", lambda c: c.users.join(c.interactions.groupBy("id_user").agg(F.min("rating_date").alias("joined")), "id_user", "left").where(F.col("role").isNull() | F.col("joined").isNull() | (F.col("role") == "MACHINERY")).select("id_user", "role"),
         "SELECT id_user, role FROM usr LEFT JOIN (SELECT id_user, min(rating_date) AS joined FROM inter GROUP BY 1) USING (id_user) WHERE role IS NULL OR joined IS NULL OR role = 'MACHINERY'")
register("user_mismatch", lambda c: health.mismatch(expected_of(c), c.interactions, "id_user"), "SELECT id_user, coalesce(n, 0) + id_user % 3 AS expected, coalesce(n, 0) AS stored FROM usr LEFT JOIN (SELECT id_user, count(*) AS n FROM inter GROUP BY 1) USING (id_user) WHERE id_user % 3 > 0")
register("release_gaps", lambda c: c.releases.where("avg_rating is null or release_year is null or ratings_count < 20").select("id_release", "ratings_count"), "SELECT id_release, ratings_count FROM rel WHERE avg_rating IS NULL OR release_year IS NULL OR ratings_count < 20")
register("release_mismatch", lambda c: health.mismatch(release_expected(c), c.interactions.where("rating > 0"), "id_release"), "SELECT id_release, ratings_count + 1 AS expected, ratings_count AS stored FROM rel WHERE id_release % 11 = 0")
register("artists_without_genres", lambda c: c.artists.join(c.parts.where((F.col("title").startswith("red")) & (F.col("id_release") % 20 == 0)).select(F.col("artist_id").alias("id_artist")).distinct(), "id_artist", "left_anti").select("id_artist"),
         "SELECT DISTINCT artist_id AS id_artist FROM parts WHERE artist_id NOT IN (SELECT artist_id FROM parts WHERE starts_with(title, 'red') AND id_release % 20 = 0)")
register("orphans", lambda c: health.orphans(c.all_ratings.select("id_user", "id_release").distinct(), c.users.where("id_user % 10 != 3"), c.parts.where("id_release % 10 != 7"), "id_user", "id_release"),
         "SELECT DISTINCT o_custkey AS id_user, l_partkey AS id_release FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 = 3 OR l_partkey % 10 = 7")
register("health_report", lambda c: health.report([("user_mismatch", "medium", health.mismatch(expected_of(c), c.interactions, "id_user")), ("release_mismatch", "low", health.mismatch(release_expected(c), c.interactions.where("rating > 0"), "id_release")), ("queue_unknown", "high", health.queue_errors(queue_of(c)).where("kind = 'unknown'"))]).select("category", "severity", "n"),
         "SELECT 'user_mismatch' AS category, 'medium' AS severity, count(*) AS n FROM usr WHERE id_user % 3 > 0 UNION ALL SELECT 'release_mismatch', 'low', count(*) FROM parts WHERE id_release % 11 = 0 UNION ALL SELECT 'queue_unknown', 'high', 1")
_POP = "ratings_count DESC NULLS LAST, avg_rating DESC NULLS LAST, id_release DESC"
register("sample_vectors", lambda c: c.vectors.join(health.top_releases(c.releases, 600), "id_release", "left_semi").select("id_release", F.size("vector").cast("long").alias("dim")), f"SELECT vec_id AS id_release, len(embedding) AS dim FROM embeddings SEMI JOIN (SELECT id_release AS vec_id FROM rel ORDER BY {_POP} LIMIT 600) USING (vec_id)")
register("sample_pairs", lambda c: rounded(health.sample_pairs(pair_table(c), c.interactions.where("rating > 0"), 2800), "jaccard", "lift"), "SELECT id_release_1, id_release_2, pair_count, round(jaccard, 6) AS jaccard, round(lift, 6) AS lift FROM prs ORDER BY pair_count DESC, jaccard DESC, lift DESC, id_release_1, id_release_2 LIMIT 2800")
register("sample_interactions", lambda c: health.sample_interactions(c.interactions, health.top_releases(c.releases, 800), 6000), f"SELECT id_user, id_release, rating, rating_date FROM inter SEMI JOIN (SELECT id_release FROM rel ORDER BY {_POP} LIMIT 800) USING (id_release) ORDER BY rating DESC, rating_date DESC, id_user, id_release LIMIT 6000")
register("sample_users", lambda c: health.sample_users(c.users, c.interactions.where("rating = 5"), c.interactions.groupBy("id_user").agg(F.count("*").alias("n")), 45, ["MACHINERY"]),
         "SELECT id_user, role FROM usr LEFT JOIN (SELECT id_user, count(*) AS n FROM inter GROUP BY 1) USING (id_user) WHERE (coalesce(n, 0) >= 45 OR role = 'MACHINERY') AND id_user IN (SELECT id_user FROM inter WHERE rating = 5)")


def _old_new(c: Catalogue) -> tuple[DataFrame, DataFrame]:
    """Releases as first stored and as crawled again: gaps on either side."""
    facts = c.releases
    old = facts.where("id_release % 3 != 0").select("id_release", F.when(F.col("id_release") % 2 == 0, F.col("title")).alias("title"), "ratings_count")
    new = facts.where("id_release % 5 != 0").select("id_release", F.when(F.col("id_release") % 7 != 0, F.upper("title")).alias("title"), (F.col("ratings_count") + F.col("id_release") % 4 - 2).alias("ratings_count"))
    return old, new


_OLD = "SELECT id_release, CASE WHEN id_release % 2 = 0 THEN title END AS title, ratings_count FROM rel WHERE id_release % 3 <> 0"
_NEW = "SELECT id_release, CASE WHEN id_release % 7 <> 0 THEN upper(title) END AS title, ratings_count + id_release % 4 - 2 AS ratings_count FROM rel WHERE id_release % 5 <> 0"
for _name, _policy, _title in (("merge_new_wins", "new", "CASE WHEN n.id_release IS NOT NULL THEN n.title ELSE o.title END"), ("merge_coalesce_new", "coalesce_new", "coalesce(n.title, o.title)"), ("merge_coalesce_old", "coalesce_old", "coalesce(o.title, n.title)")):
    register(_name, (lambda p: lambda c: merge.merge(*_old_new(c), ["id_release"], {"title": p, "ratings_count": "greatest"}))(_policy),
             f"SELECT id_release, {_title} AS title, greatest(o.ratings_count, n.ratings_count) AS ratings_count FROM olds o FULL JOIN news n USING (id_release)", olds=_OLD, news=_NEW)
register("queue_enqueue", lambda c: merge.merge(queue_of(c).select("id", "status", "priority"), c.users.where("id_user % 2 = 0").select(F.col("id_user").alias("id"), F.lit("pending").alias("status"), F.lit(2).cast("long").alias("priority")), ["id"], {"status": "sticky", "priority": "greatest"}),
         "SELECT id, CASE WHEN status = 'done' THEN status WHEN id % 2 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN id % 2 = 0 THEN greatest(priority, 2) ELSE priority END AS priority FROM q", q=_QUEUE)
register("queue_claim", lambda c: merge.claim(queue_of(c).drop("last_error"), 100), """
    SELECT id, CASE WHEN hit THEN 'processing' ELSE status END AS status, priority, attempts + hit::INT AS attempts, updated_at FROM (
      SELECT *, status = 'pending' AND row_number() OVER (PARTITION BY status ORDER BY priority DESC, updated_at, id) <= 100 AS hit FROM q)""", q=_QUEUE)
register("queue_backfill", lambda c: merge.backfill(queue_of(c).where("id % 4 != 1").select("id", "status"), c.users.select(F.col("id_user").alias("id"))), "SELECT id, CASE WHEN id % 4 = 1 THEN 'pending' ELSE status END AS status FROM q", q=_QUEUE)
register("genre_diff", lambda c: merge.set_changes(c.release_genres.where("(id_release + id_genre) % 3 != 0"), c.release_genres.where("(id_release + id_genre) % 4 != 0"), ["id_release", "id_genre"]),
         "SELECT id_release, id_genre, CASE WHEN (id_release + id_genre) % 3 = 0 THEN 'insert' ELSE 'delete' END AS change FROM rg WHERE ((id_release + id_genre) % 3 = 0) <> ((id_release + id_genre) % 4 = 0)")
register("track_renumber", lambda c: merge.renumber(c.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 6 != 0, F.col("l_returnflag")).alias("title")), "l_orderkey", ["l_linenumber", "l_partkey"], "title").select("l_orderkey", "position", "l_partkey"),
         "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS position, l_partkey FROM lineitem WHERE l_partkey % 6 <> 0")
