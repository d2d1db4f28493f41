"""Queries of store differences and of closed samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.operators import health, stores
from tunegrid.plans.registry import register
from tunegrid.sources.adapter import Catalogue
from tunegrid.sources.staging import staged

LINKS: list[stores.Link] = [("interactions", "id_user", "users", "id_user"), ("interactions", "id_release", "releases", "id_release"), ("vectors", "id_release", "releases", "id_release"), ("releases", "artist_id", "artists", "id_artist")]


def changed_store(c: Catalogue) -> DataFrame:
    """The releases of a later store: some gone, some new, some with another title or year."""
    kept = c.parts.where("id_release % 89 <> 0").withColumns({"title": F.when(F.col("id_release") % 97 == 0, F.upper("title")).otherwise(F.col("title")), "release_year": F.when(F.col("id_release") % 194 == 0, None).otherwise(F.col("release_year"))})
    return kept.unionByName(c.parts.where("id_release % 101 = 0").withColumn("id_release", F.col("id_release") + 10_000_000))


def sampled(c: Catalogue) -> dict[str, DataFrame]:
    """6,000 interactions with the best releases and the vectors of 600, and all that they refer to."""
    c = c.settled()
    full = {"interactions": c.interactions, "users": c.users, "releases": c.releases.select("id_release", "title", "artist_id"), "artists": c.artists, "vectors": c.vectors.select("id_release", F.size("vector").alias("dim"))}
    chosen = {"interactions": health.sample_interactions(c.interactions, health.top_releases(c.releases, 800), 6_000), "vectors": full["vectors"].join(health.top_releases(c.releases, 600), "id_release", "left_semi")}
    return {name: staged(df, f"sample_{name}") for name, df in stores.closed_sample(full, chosen, LINKS).items()}


def sample_sizes(c: Catalogue) -> DataFrame:
    """(name, rows, orphans) of each table of the closed sample."""
    sample = sampled(c)
    sizes = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in sample.items()])
    lost = stores.orphans_of(sample, LINKS).groupBy(F.col("child").alias("name")).agg(F.sum("n").alias("orphans"))
    return sizes.join(lost, "name", "left").select("name", "rows", F.coalesce("orphans", F.lit(0)).alias("orphans"))


register("store_difference", lambda c: stores.difference(c.parts, changed_store(c), ["id_release"]), """
    SELECT id_release, CASE WHEN id_release % 89 = 0 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN id_release % 89 = 0 THEN '' WHEN id_release % 194 = 0 THEN 'title,release_year' ELSE 'title' END AS columns
    FROM parts WHERE id_release % 89 = 0 OR id_release % 97 = 0 UNION ALL SELECT id_release + 10000000, 'added', '' FROM parts WHERE id_release % 101 = 0""")
_POP = "ratings_count DESC NULLS LAST, avg_rating DESC NULLS LAST, id_release DESC"
register("sample_closed", sample_sizes, """
    SELECT 'interactions' AS name, count(*) AS rows, 0::BIGINT AS orphans FROM si UNION ALL SELECT 'users', count(DISTINCT id_user), 0 FROM si WHERE id_user IN (SELECT id_user FROM usr)
    UNION ALL SELECT 'vectors', count(*), 0 FROM sv UNION ALL SELECT 'releases', count(*), 0 FROM sr UNION ALL SELECT 'artists', count(DISTINCT artist_id), 0 FROM sr""",
    si=f"SELECT id_user, id_release FROM inter SEMI JOIN (SELECT id_release FROM rel ORDER BY {_POP} LIMIT 800) USING (id_release) ORDER BY rating DESC, rating_date DESC, id_user, id_release LIMIT 6000",
    sv=f"SELECT vec_id AS id_release FROM embeddings SEMI JOIN (SELECT id_release AS vec_id FROM rel ORDER BY {_POP} LIMIT 600) USING (vec_id)",
    sr="SELECT id_release, artist_id FROM parts WHERE id_release IN (SELECT id_release FROM si UNION SELECT id_release FROM sv)")
