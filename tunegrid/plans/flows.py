"""Queries of the expansion over rendered pages and of fixes to the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.operators import fixes, health
from tunegrid.operators.expansion import Follow, expand
from tunegrid.plans.registry import register
from tunegrid.plans.rendered import chart_pages, discography_pages, soundoff_pages, vote_pages
from tunegrid.plans.upkeep import _QUEUE, queue_of
from tunegrid.sources.adapter import Catalogue
from tunegrid.sources.staging import staged

ROUNDS = 3


def follows_of(c: Catalogue) -> list[Follow]:
    """A chart names releases, a release's page the users who rated it, a user's votes releases, an artist's discography releases.

    Pages of every seventh release and user were never stored.
    """
    c = c.settled()
    release_id, user_id = F.col("release_id"), F.regexp_extract("user_id", "([0-9]+)", 1)
    stored = lambda pages, name: staged(pages.where("page_id % 7 != 3"), name)
    return [
        Follow("chart", staged(chart_pages(c), "charts"), "chart", (("release", F.col("album_id")), ("artist", F.regexp_extract("artist_name", "([0-9]+)", 1)))),
        Follow("release", stored(soundoff_pages(c), "soundoffs"), "soundoffs", (("user", user_id),)),
        Follow("user", stored(vote_pages(c), "votes"), "votes", (("release", release_id),)),
        Follow("artist", staged(discography_pages(c), "discographies"), "discography", (("release", release_id),)),
    ]


def expanded(c: Catalogue) -> DataFrame:
    """What a crawl reaches from the first chart in ROUNDS rounds."""
    seeds = c.parts.agg(F.min("release_year").alias("id")).select(F.lit("chart").alias("kind"), "id")
    return expand(seeds, follows_of(c), ROUNDS)


_EDGES = """SELECT 'chart' AS kind, release_year AS id, 'release' AS kind2, id_release AS id2 FROM parts UNION ALL SELECT 'chart', release_year, 'artist', artist_id FROM parts
    UNION ALL SELECT 'artist', artist_id, 'release', id_release FROM parts UNION ALL SELECT 'release', id_release, 'user', id_user FROM inter WHERE rating > 0 AND id_release % 7 <> 3
    UNION ALL SELECT 'user', id_user, 'release', id_release FROM inter WHERE rating > 0 AND id_user % 7 <> 3"""
_LEVELS = {"d0": "SELECT 'chart' AS kind, min(release_year) AS id, 0::BIGINT AS depth FROM parts"}
for _k in range(1, ROUNDS + 1):
    _LEVELS[f"d{_k}"] = f"FROM d{_k - 1} UNION ALL SELECT DISTINCT kind2, id2, {_k}::BIGINT FROM edges SEMI JOIN (FROM d{_k - 1} WHERE depth = {_k - 1}) USING (kind, id) WHERE (kind2, id2) NOT IN (SELECT (kind, id) FROM d{_k - 1})"
register("expand_catalogue", expanded, f"""
    SELECT kind, id, depth, CASE WHEN depth = {ROUNDS} THEN 'pending' WHEN kind IN ('chart', 'artist') OR (id % 7 <> 3 AND EXISTS (SELECT 1 FROM edges e WHERE e.kind = d.kind AND e.id = d.id)) THEN 'done' ELSE 'error' END AS status FROM d{ROUNDS} d""",
    edges=_EDGES, **_LEVELS)

#: What is done about each kind of issue.
RULES = {"not_found": ("users", "delete"), "rate_limited": ("users", "reset"), "timeout": ("users", "reset"), "incomplete_read": ("users", "reset"), "connection": ("users", "reset"), "missing": ("users", "enqueue")}


def changes_of(c: Catalogue) -> tuple[DataFrame, DataFrame]:
    """The queue that lost every eleventh user, and the changes that its errors and gaps call for."""
    queue = queue_of(c).where("id % 11 != 5")
    missing = c.users.select(F.lit("missing").alias("category"), F.col("id_user").alias("id")).join(queue.select("id"), "id", "left_anti")
    issues = health.queue_issues(queue).select("category", "id").unionByName(missing.select("category", "id"))
    return queue, fixes.planned(issues, RULES)


def fixed(c: Catalogue) -> DataFrame:
    queue, changes = changes_of(c)
    return fixes.applied({"users": queue}, changes, 1_000)["users"]


_KIND = """CASE WHEN coalesce(last_error, '') = '' THEN 'unknown' WHEN contains(lower(last_error), '404') THEN 'not_found' WHEN contains(lower(last_error), '429') OR contains(lower(last_error), 'too many') THEN 'rate_limited'
    WHEN contains(lower(last_error), 'timeout') THEN 'timeout' WHEN contains(lower(last_error), 'incomplet') THEN 'incomplete_read' WHEN contains(lower(last_error), 'connection') OR contains(lower(last_error), 'reset') THEN 'connection' ELSE 'other' END"""
_ACTS = f"""SELECT id, CASE WHEN id % 11 = 5 THEN 'enqueue' WHEN status <> 'error' THEN NULL WHEN {_KIND} = 'not_found' THEN 'delete' WHEN {_KIND} IN ('rate_limited', 'timeout', 'incomplete_read', 'connection') THEN 'reset' END AS action FROM q"""
register("health_fixes_dry_run", lambda c: fixes.dry_run(dict(users=changes_of(c)[0]), changes_of(c)[1]), "SELECT 'users' AS target, action, count(*) AS n FROM acts WHERE action IS NOT NULL GROUP BY 2", q=_QUEUE, acts=_ACTS)
register("health_fixes", fixed, """
    SELECT id, CASE WHEN action IS NOT NULL THEN 'pending' ELSE status END AS status, CASE WHEN id % 11 = 5 THEN 0 ELSE priority END AS priority, CASE WHEN action IS NULL THEN last_error END AS last_error,
      CASE WHEN action IS NOT NULL THEN 0 ELSE attempts END AS attempts, CASE WHEN action IS NOT NULL THEN 1000 ELSE updated_at END AS updated_at FROM q JOIN acts USING (id) WHERE action IS NULL OR action <> 'delete'""", q=_QUEUE, acts=_ACTS)
