"""Queries on histories and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunegrid.functions import text
from tunegrid.operators import catalogue as ops
from tunegrid.operators import fusion
from tunegrid.plans.registry import register
from tunegrid.sources.adapter import POSITIVE


def _search(c):
    return ops.searchable(c.releases, c.artists, c.release_genres)


register("interactions_latest", lambda c: c.interactions, "SELECT id_user, id_release, rating, rating_date FROM inter")
register("user_collection", lambda c: ops.user_collection(c.interactions, c.releases, c.artists), """
    SELECT id_user, row_number() OVER (PARTITION BY id_user ORDER BY rating_date DESC, id_release) AS place, id_release, title, 'Brand#' || artist_id AS artist, rating, strftime(rating_date, '%d/%m/%Y') AS rated_on
    FROM inter JOIN parts USING (id_release) WHERE rating > 0""")
for _name, _condition in (("rated_ids", "rating > 0"), ("seen_ids", "rating = 0"), ("interacted_ids", "rating >= 0"), ("positive_ids", f"rating >= {POSITIVE}")):
    register(_name, (lambda k: lambda c: ops.history(c.interactions, k))(_condition), f"SELECT id_user, id_release, row_number() OVER (PARTITION BY id_user ORDER BY rating_date DESC, id_release) AS place FROM inter WHERE {_condition}")
register("interaction_counts", lambda c: c.interactions.groupBy("id_user").agg(F.count_if(F.col("rating") > 0).alias("rated"), F.count_if(F.col("rating") == 0).alias("seen")),
         "SELECT id_user, count(*) FILTER (rating > 0) AS rated, count(*) FILTER (rating = 0) AS seen FROM inter GROUP BY 1")
register("positive_counts", lambda c: c.signals, "SELECT id_user, n_pos FROM sig")
register("advanced_level", lambda c: c.signals.select("id_user", fusion.level(F.col("n_pos")).alias("level"), F.when(F.col("n_pos") < 20, 20).when(F.col("n_pos") < 30, 30).cast("long").alias("next_at")),
         "SELECT id_user, CASE WHEN n_pos < 20 THEN 0 WHEN n_pos < 30 THEN 1 ELSE 2 END::BIGINT AS level, CASE WHEN n_pos < 20 THEN 20 WHEN n_pos < 30 THEN 30 END::BIGINT AS next_at FROM sig")
register("advanced_weights", lambda c: c.signals.select("id_user", fusion.blend_weights(F.col("n_pos"))[0].alias("nmf"), fusion.blend_weights(F.col("n_pos"))[1].alias("towers")), """
    SELECT id_user, CASE WHEN n_pos < 30 THEN 1.0 WHEN n_pos < 51 THEN 0.5 WHEN n_pos < 101 THEN 0.4 WHEN n_pos < 201 THEN 0.3 ELSE 0.2 END::DOUBLE AS nmf,
      CASE WHEN n_pos < 30 THEN 0.0 WHEN n_pos < 51 THEN 0.5 WHEN n_pos < 101 THEN 0.6 WHEN n_pos < 201 THEN 0.7 ELSE 0.8 END::DOUBLE AS towers FROM sig""")
_CAT = "SELECT rel.*, 'Brand#' || artist_id AS artist FROM rel"
register("search_catalog", lambda c: ops.search(_search(c), 36, 36, query="ring", artist="brand#1").select("id_release", "title", "artist", "release_year", "ratings_count"), """
    SELECT id_release, title, artist, release_year, ratings_count FROM cat WHERE (contains(lower(title), 'ring') OR contains(lower(artist), 'ring')) AND contains(lower(artist), 'brand#1')
    ORDER BY ratings_count DESC NULLS LAST, avg_rating DESC NULLS LAST, title, id_release LIMIT 36 OFFSET 36""", cat=_CAT)
register("count_catalog", lambda c: _search(c).where(ops.catalogue_filter(artist="brand#1", kind="economy")).agg(F.count_distinct("id_release").alias("n")),
         "SELECT count(DISTINCT id_release) AS n FROM cat WHERE contains(lower(artist), 'brand#1') AND lower(release_type) = 'economy'", cat=_CAT)
register("release_details", lambda c: ops.release_details(c.interactions.where("rating = 5").select(F.col("id_release")).distinct().withColumn("pos", F.pmod(F.col("id_release") * 7919, F.lit(1009))), _search(c)),
         "SELECT (id_release * 7919) % 1009 AS pos, id_release, title, artist, release_type, release_year, ratings_count, avg_rating FROM cat WHERE id_release IN (SELECT id_release FROM inter WHERE rating = 5)", cat=_CAT)
register("releases_by_artist", lambda c: ops.releases_by_artist(c.releases), "SELECT artist_id, row_number() OVER (PARTITION BY artist_id ORDER BY release_year DESC NULLS LAST, title, id_release) AS place, id_release, title, release_year FROM parts")
register("artists_enriched", lambda c: ops.artists_enriched(c.artists, c.releases, c.release_genres, c.genres).withColumn("genres", F.to_json("genres")), """
    SELECT artist_id AS id_artist, 'Brand#' || artist_id AS name, '["' || array_to_string(list_sort(list(DISTINCT gen.name)), '","') || '"]' AS genres
    FROM parts JOIN rg USING (id_release) JOIN gen USING (id_genre) GROUP BY 1""")
register("tracklists", lambda c: c.raw("lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))).alias("t")).select(F.col("l_orderkey").alias("id"), F.concat_ws(",", "t").alias("tracks")),
         "SELECT l_orderkey AS id, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS tracks FROM lineitem GROUP BY 1")
register("list_genres", lambda c: c.genres.orderBy("name"), "SELECT id_genre, name FROM gen")
register("list_years", lambda c: c.parts.select("release_year").distinct().orderBy(F.desc("release_year")), "SELECT DISTINCT release_year FROM parts")
register("list_types", lambda c: c.parts.select("release_type").distinct().orderBy("release_type"), "SELECT DISTINCT release_type FROM parts")
register("store_stats", lambda c: c.interactions.agg(F.count("*").alias("n")).select(F.lit("interactions").alias("name"), "n").unionByName(c.parts.agg(F.count("*").alias("n")).select(F.lit("releases").alias("name"), "n"))
         .unionByName(c.users.agg(F.count("*").alias("n")).select(F.lit("users").alias("name"), "n")).unionByName(c.artists.agg(F.count("*").alias("n")).select(F.lit("artists").alias("name"), "n")),
         "SELECT 'interactions' AS name, count(*) AS n FROM inter UNION ALL SELECT 'releases', count(*) FROM parts UNION ALL SELECT 'users', count(*) FROM usr UNION ALL SELECT 'artists', count(DISTINCT artist_id) FROM parts")

# Text functions, on the generic tables.
register("whitespace", lambda c: c.raw("conversations").select("conv_id", "turn", text.squeeze("text").alias("clean")), r"SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS clean FROM conversations")
register("truncate", lambda c: c.raw("documents").select("doc_id", text.shorten("text", 120).alias("short")), "SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 117) || '...' ELSE text END AS short FROM documents")
register("duration_parse", lambda c: text.durations(c.raw("lineitem")), """
    SELECT l_orderkey, l_linenumber, raw, CASE WHEN len(p) = 3 AND m < 60 AND s < 60 THEN h * 3600 + m * 60 + s WHEN len(p) = 2 AND m < 60 AND s < 60 THEN m * 60 + s END AS seconds FROM (
      SELECT *, CASE WHEN len(p) = 3 THEN try_cast(p[1] AS BIGINT) END AS h, try_cast(p[len(p) - 1] AS BIGINT) AS m, try_cast(p[len(p)] AS BIGINT) AS s FROM (
        SELECT *, string_split(raw, ':') AS p FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN (l_linenumber % 3) || ':' ELSE '' END || (l_partkey % 70) || ':' || lpad((l_quantity::BIGINT + 12)::VARCHAR, 2, '0') AS raw FROM lineitem)))""")
register("date_parse", lambda c: text.spoken_dates(c.raw("orders")), r"""
    SELECT o_orderkey, raw, make_date(yy + CASE WHEN yy > 30 THEN 1900 ELSE 2000 END, m, d) AS parsed FROM (
      SELECT o_orderkey, strftime(o_orderdate, '%B ') || d || CASE WHEN d IN (1, 21, 31) THEN 'st' WHEN d IN (2, 22) THEN 'nd' WHEN d IN (3, 23) THEN 'rd' ELSE 'th' END || strftime(o_orderdate, ' %y') AS raw, d, m, yy FROM (
        SELECT *, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) % 100 AS yy FROM orders))""")
register("error_class", lambda c: c.raw("conversations").select("conv_id", "turn", text.error_class("text").alias("kind")), """
    SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'unknown' WHEN contains(lower(text), '404') THEN 'not_found' WHEN contains(lower(text), '429') OR contains(lower(text), 'too many') THEN 'rate_limited'
      WHEN contains(lower(text), 'timeout') THEN 'timeout' WHEN contains(lower(text), 'incomplet') THEN 'incomplete_read'
      WHEN contains(lower(text), 'connection') OR contains(lower(text), 'reset') OR contains(lower(text), 'broken') THEN 'connection' ELSE 'other' END AS kind FROM conversations""")
register("url_norm", lambda c: c.raw("pages").select("page_id", text.plain_path("url").alias("path"), text.slug("url").alias("slug")),
         r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/+$', '') AS path, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
register("backoff_schedule", lambda c: c.users.select((F.col("id_user") % 12).alias("attempt")).groupBy("attempt").agg(F.count("*").alias("users")).select("attempt", "users", F.least(F.lit(30.0), 0.5 * F.pow(F.lit(2.0), F.col("attempt"))).alias("delay")),
         "SELECT id_user % 12 AS attempt, count(*) AS users, least(30.0, 0.5 * pow(2, id_user % 12))::DOUBLE AS delay FROM usr GROUP BY 1, 3")
register("page_titles", lambda c: c.raw("pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a [^>]*href=")).cast("long").alias("links")),
         "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href='))::BIGINT AS links FROM pages")
