"""Queries of evaluation, statistics, profiling, neighbourhoods and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.operators import evaluation as ev
from tunegrid.operators import features, fusion, neighbours, stats
from tunegrid.plans import oracle as O
from tunegrid.plans.recommend import content_of, pairs_of, rounded
from tunegrid.plans.registry import register
from tunegrid.sources.adapter import AS_OF, Catalogue
from tunegrid.sources.staging import staged

STRATEGIES = ["pairs", "content"]


def split_of(c: Catalogue) -> DataFrame:
    return ev.holdout_split(c.interactions.where("rating > 0"))


def whole(c: Catalogue) -> Catalogue:
    """The catalogue whose interactions carry their part of the split, computed once: all steps of an evaluation read that table."""
    if "_whole" not in c.__dict__:
        c._whole = Catalogue(c.spark, c.sf_dir)
        c._whole.interactions = staged(ev.with_parts(c.by_user()), "parted")
        c._whole._settled = c._whole
    return c._whole


def trained(c: Catalogue) -> Catalogue:
    """The catalogue without the holdout, so that pairs and profiles are free of leaks; settled, as its rows are stored."""
    if "_trained" not in c.__dict__:
        t = c._trained = Catalogue(c.spark, c.sf_dir)
        t.interactions = whole(c).interactions.where("part is null or part = 'train'").drop("part")
        t.releases = staged(t.releases, "releases")
        t._settled = t
    return c._trained


def lists_of(c: Catalogue, limit: int = 9) -> DataFrame:
    t = trained(c)
    return pairs_of(t, limit).select("id_user", F.lit("pairs").alias("strategy"), "rank", "id_release").unionByName(content_of(t, limit).select("id_user", F.lit("content").alias("strategy"), "rank", "id_release"))


def relevant_of(c: Catalogue) -> DataFrame:
    return whole(c).interactions.where("part = 'test'").select("id_user", "id_release")


def metrics_of(c: Catalogue) -> DataFrame:
    return ev.metrics_long(lists_of(c), relevant_of(c), whole(c).releases, c.release_genres)


def scores_of(c: Catalogue) -> DataFrame:
    """(id_user, pairs, content, size): ndcg per strategy, 0 without a list, and the holdout's size; staged, as statistics read it several times."""
    rows = ev.ndcg_by_user(lists_of(c), relevant_of(c), STRATEGIES)
    return staged(rows.select("id_user", *[F.round(s, 9).alias(s) for s in STRATEGIES], "size"), "scores")


# The oracle evaluates over a training copy: `full` keeps all interactions, `inter` loses the holdout.
_HASH = "(id_user * 2654435761 + id_release * 40503 + 9409) % 1000003"
SPLIT = f"""SELECT id_user, id_release, CASE WHEN row_number() OVER (PARTITION BY id_user ORDER BY {_HASH}, id_release) <= greatest(1, floor(count(*) OVER (PARTITION BY id_user) * (1 - 0.2::DOUBLE) + 1e-9)) THEN 'train' ELSE 'test' END AS part
    FROM full_ WHERE rating > 0"""
TRAIN = {"full_": O.CTES["inter"], "split": SPLIT, "inter": "SELECT * FROM full_ ANTI JOIN (FROM split WHERE part = 'test') USING (id_user, id_release)",
         "relevant": "SELECT id_user, id_release FROM split WHERE part = 'test'",
         "lists": f"SELECT id_user, 'pairs' AS strategy, rank, id_release FROM ({O.rec_pairs(9)}) UNION ALL SELECT id_user, 'content', rank, id_release FROM ({O.rec_content(9)})",
         "relf": "SELECT parts.id_release, artist_id, count(f.rating) AS ratings_count FROM parts LEFT JOIN (FROM full_ WHERE rating > 0) f USING (id_release) GROUP BY 1, 2",
         "hits": "SELECT lists.*, (relevant.id_release IS NOT NULL)::INT AS hit FROM lists LEFT JOIN relevant USING (id_user, id_release)",
         "gsets": "SELECT id_user, strategy, count(DISTINCT id_genre) AS n_genres FROM lists JOIN rg USING (id_release) GROUP BY 1, 2",
         "per": """SELECT id_user, strategy, count(*) AS n, sum(hit) AS hits, sum(hit / log2(rank + 1)) AS dcg, min(CASE WHEN hit = 1 THEN rank END) AS first, count(DISTINCT artist_id) FILTER (artist_id > 0) AS n_artists,
             avg(-log2(greatest(1, ratings_count)::DOUBLE / (SELECT greatest(1, max(ratings_count)) FROM relf))) AS novelty FROM hits JOIN relf USING (id_release) GROUP BY 1, 2""",
         "wide": """SELECT per.*, n_genres, n_rel, list_sum(list_transform(range(1, hits::BIGINT + 1), lambda j: 1.0::DOUBLE / log2(j + 1))) AS ideal, hits / n AS p, hits / n_rel AS r
             FROM per JOIN (SELECT id_user, count(*) AS n_rel FROM relevant GROUP BY 1) USING (id_user) LEFT JOIN gsets USING (id_user, strategy)""",
         "ndcgs": "SELECT id_user, strategy, round(coalesce(dcg / nullif(ideal, 0), 0), 9) AS v FROM wide",
         "scores": """SELECT id_user, coalesce(max(v) FILTER (strategy = 'pairs'), 0) AS pairs, coalesce(max(v) FILTER (strategy = 'content'), 0) AS content, any_value(n_rel) AS size FROM ndcgs JOIN (SELECT id_user, count(*) AS n_rel FROM relevant GROUP BY 1) USING (id_user) GROUP BY 1"""}
_METRICS = " UNION ALL ".join(f"SELECT id_user, strategy, '{m}' AS metric, round({v}, 6)::DOUBLE AS value FROM wide" for m, v in {
    "ndcg": "coalesce(dcg / nullif(ideal, 0), 0)", "precision": "p", "recall": "r", "f1": "coalesce(2 * p * r / nullif(p + r, 0), 0)", "mrr": "coalesce(1.0::DOUBLE / first, 0)", "hit_rate": "(hits > 0)::INT",
    "genre_diversity": "coalesce(n_genres, 0) / n", "artist_diversity": "n_artists / n", "novelty": "novelty"}.items())

register("pick_users", lambda c: ev.pick_users(c.interactions.where("rating > 0").groupBy("id_user").agg(F.count("*").alias("n")), 30, 200), f"""
    SELECT id_user FROM (SELECT id_user, count(*) AS n FROM inter WHERE rating > 0 GROUP BY 1) WHERE n >= 30 ORDER BY (id_user * 2654435761 + {97 * 11}) % 1000003, id_user LIMIT 200""")
register("holdout_split", split_of, "SELECT * FROM split", **TRAIN)


def candidate_pools(c: Catalogue, size: int = 500) -> DataFrame:
    """Every user's pool: `size` rated releases that they have not interacted with, drawn by hash; users meet size + history of them, not all."""
    c = c.settled()
    return fusion.random_unseen(c.interactions.select("id_user").distinct(), c.interactions, c.releases.where("ratings_count > 0"), size, seed=13).select("id_user", "id_release")


register("candidate_pool_eval", candidate_pools, f"""
    SELECT id_user, id_release FROM (SELECT * FROM (SELECT DISTINCT id_user FROM inter), (SELECT id_release FROM rel WHERE ratings_count > 0)) ANTI JOIN inter USING (id_user, id_release)
    QUALIFY row_number() OVER (PARTITION BY id_user ORDER BY (id_user * 2654435761 + id_release * 40503 + {97 * 13}) % 1000003, id_release) <= 500""")
register("metrics_long", lambda c: rounded(metrics_of(c), "value"), _METRICS, **TRAIN)
register("metric_averages", lambda c: rounded(metrics_of(c).groupBy("strategy", "metric").agg(F.avg("value").alias("mean")), "mean", places=4), f"SELECT strategy, metric, round(avg(value), 4) AS mean FROM ({_METRICS.replace('round(', '(').replace(', 6)::DOUBLE', ')::DOUBLE')}) GROUP BY 1, 2", **TRAIN)
register("coverage", lambda c: lists_of(c).groupBy("strategy").agg(F.count_distinct("id_release").alias("n")).crossJoin(F.broadcast(c.parts.agg(F.count("*").alias("total")))).select("strategy", F.round(F.col("n") / F.col("total"), 6).alias("coverage")),
         "SELECT strategy, round(count(DISTINCT id_release)::DOUBLE / (SELECT count(*) FROM parts), 6) AS coverage FROM lists GROUP BY 1", **TRAIN)
KS = [1, 5, 10, 20, 40, 60, 100]
_GRID = f"""SELECT k, id_user, id_release, row_number() OVER (PARTITION BY k, id_user ORDER BY s DESC, id_release) AS rank FROM (
    SELECT k, id_user, id_release, round(sum(1.0::DOUBLE / (k + rank)), 9) AS s FROM l27, (SELECT unnest({KS}) AS k) GROUP BY k, id_user, id_release) QUALIFY rank <= 9"""
_KSQL = f"""SELECT k::BIGINT AS k, id_user, sum(hit)::BIGINT AS hits, coalesce(sum(hit / log2(rank + 1)) / nullif(list_sum(list_transform(range(1, sum(hit)::BIGINT + 1), lambda j: 1.0::DOUBLE / log2(j + 1))), 0), 0) AS ndcg
    FROM (SELECT g.*, (relevant.id_release IS NOT NULL)::INT AS hit FROM grid g LEFT JOIN relevant USING (id_user, id_release)) GROUP BY 1, 2"""
_SEARCH = TRAIN | {"l27": TRAIN["lists"].replace(O.rec_pairs(9), O.rec_pairs(27)).replace(O.rec_content(9), O.rec_content(27)), "grid": _GRID, "ksearch": _KSQL}
register("rrf_k_search", lambda c: rounded(ev.rrf_k_search(lists_of(c, 27), relevant_of(c), KS), "ndcg"), "SELECT k, id_user, hits, round(ndcg, 6) AS ndcg FROM ksearch", **_SEARCH)
register("best_k", lambda c: ev.rrf_k_search(lists_of(c, 27), relevant_of(c), KS).groupBy("k").agg(F.round(F.avg("ndcg"), 6).alias("ndcg")).agg(F.max(F.struct("ndcg", (-F.col("k")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("k"), "m.ndcg"),
         "SELECT k, round(avg(ndcg), 6) AS ndcg FROM ksearch GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", **_SEARCH)

# Statistics over per-user ndcg.
register("head_to_head", lambda c: rounded(stats.head_to_head(scores_of(c), *STRATEGIES), "a_wins", "b_wins", "ties", "median_diff"), """
    SELECT round(avg((pairs > content)::INT), 6) AS a_wins, round(avg((content > pairs)::INT), 6) AS b_wins, round(avg((pairs = content)::INT), 6) AS ties, round(median(pairs - content), 6) AS median_diff FROM scores""", **TRAIN)
_T = "SELECT count(*) AS n, avg(pairs - content) AS m, stddev_samp(pairs - content) AS sd FROM scores"
register("paired_t", lambda c: rounded(stats.paired_t(scores_of(c), *STRATEGIES), "mean", "low", "high", "t", "d", places=5), f"""
    SELECT n, round(m, 5) AS mean, round(m - 1.96 * sd / sqrt(n), 5) AS low, round(m + 1.96 * sd / sqrt(n), 5) AS high, round(m / (sd / sqrt(n)), 5) AS t, round(m / sd, 5) AS d FROM ({_T})""", **TRAIN)
register("wilcoxon", lambda c: rounded(stats.wilcoxon(scores_of(c), *STRATEGIES), "w_plus", "w_minus", "z", places=4), """
    SELECT n, round(wp, 4) AS w_plus, round(wm, 4) AS w_minus, round((least(wp, wm) - (n * (n + 1.0) - z * (z + 1.0)) / 4) / sqrt((n * (n + 1.0) * (2 * n + 1) - z * (z + 1.0) * (2 * z + 1) - ties / 2) / 24), 4) AS z FROM (
      SELECT sum(c)::BIGINT AS n, sum(CASE WHEN m = 0 THEN c ELSE 0 END)::DOUBLE AS z, sum(up * r)::DOUBLE AS wp, sum(down * r)::DOUBLE AS wm, sum(CASE WHEN m > 0 THEN c * c * c - c ELSE 0 END)::DOUBLE AS ties FROM (
        SELECT *, sum(c) OVER (ORDER BY m) - (c - 1) / 2 AS r FROM (SELECT abs(round(pairs - content, 9)) AS m, count(*)::DOUBLE AS c, count(*) FILTER (round(pairs - content, 9) > 0) AS up, count(*) FILTER (round(pairs - content, 9) < 0) AS down FROM scores GROUP BY 1)))""", **TRAIN)
register("strategy_summary", lambda c: rounded(metrics_of(c).where("metric = 'ndcg'").groupBy("strategy").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most")), "mean", "std", "least", "most", places=5),
         "SELECT strategy, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(min(v), 5) AS least, round(max(v), 5) AS most FROM ndcgs GROUP BY 1", **TRAIN)
register("strategy_correlation", lambda c: stats.correlation(scores_of(c), *STRATEGIES), "SELECT round(corr(pairs, content), 5) AS correlation FROM scores", **TRAIN)
_SEG = "CASE WHEN size <= 20 THEN '<=20' WHEN size <= 50 THEN '21-50' WHEN size <= 100 THEN '51-100' WHEN size <= 200 THEN '101-200' ELSE '>200' END"
register("segment_means", lambda c: rounded(stats.segments(scores_of(c), "size", STRATEGIES), *STRATEGIES, places=5),
         f"SELECT {_SEG} AS segment, count(*) AS users, round(avg(pairs), 5) AS pairs, round(avg(content), 5) AS content, CASE WHEN avg(pairs) >= avg(content) THEN 'pairs' ELSE 'content' END AS best FROM scores GROUP BY 1", **TRAIN)
register("best_strategy", lambda c: stats.best_strategy(scores_of(c), STRATEGIES), "SELECT CASE WHEN pairs >= content THEN 'pairs' ELSE 'content' END AS strategy, count(*) AS users FROM scores GROUP BY 1", **TRAIN)
_GOOD = "list_filter([CASE WHEN pairs >= (SELECT quantile_cont(pairs, 0.75) FROM scores) AND pairs > 0 THEN 'pairs' END, CASE WHEN content >= (SELECT quantile_cont(content, 0.75) FROM scores) AND content > 0 THEN 'content' END], lambda x: x IS NOT NULL)"
register("combo_counts", lambda c: stats.combo_counts(scores_of(c), STRATEGIES), f"SELECT array_to_string(g, '+') AS combination, len(g)::BIGINT AS strategies, count(*) AS users FROM (SELECT {_GOOD} AS g FROM scores) GROUP BY g", **TRAIN)
register("consensus", lambda c: stats.consensus(scores_of(c), STRATEGIES), """
    SELECT id_user, round(s, 6) AS spread, s <= (SELECT quantile_cont(round(abs(pairs - content) / 2, 9), 0.33) FROM scores) AS agree FROM (SELECT id_user, round(abs(pairs - content) / 2, 9) AS s FROM scores)""", **TRAIN)
register("poor_performers", lambda c: stats.poor_performers(scores_of(c).where("pairs > 0 or content > 0").withColumn("best", F.greatest(*STRATEGIES)), STRATEGIES, "best"), """
    SELECT id_user FROM scores WHERE (pairs > 0 OR content > 0) AND greatest(pairs, content) < (SELECT quantile_cont(greatest(pairs, content), 0.25) FROM scores WHERE pairs > 0 OR content > 0)""", **TRAIN)
register("ensemble_sim", lambda c: rounded(stats.ensemble_sim(scores_of(c), STRATEGIES, [0.6, 0.4]), "mean", "gain", places=5), " UNION ALL ".join(
    f"SELECT '{k}' AS ensemble, round(avg({v}), 5) AS mean, round(avg({v}) - greatest(avg(pairs), avg(content)), 5) AS gain FROM scores" for k, v in {"average": "(pairs + content) / 2", "maximum": "greatest(pairs, content)", "weighted": "(0.6::DOUBLE * pairs + 0.4::DOUBLE * content)"}.items()), **TRAIN)

# Profiling.
register("rating_histogram", lambda c: c.interactions.groupBy("rating").agg(F.count("*").alias("n")), "SELECT rating, count(*) AS n FROM inter GROUP BY 1")
register("votes_per_month", lambda c: c.interactions.groupBy(F.date_format("rating_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")), "SELECT strftime(rating_date, '%Y-%m') AS month, count(*) AS n FROM inter GROUP BY 1")
register("density", lambda c: c.interactions.where("rating > 0").agg((F.count("*") / (F.count_distinct("id_user") * F.count_distinct("id_release"))).alias("d")).select(F.round("d", 9).alias("density")),
         "SELECT round(count(*)::DOUBLE / (count(DISTINCT id_user) * count(DISTINCT id_release)), 9) AS density FROM inter WHERE rating > 0")
register("support_coverage", lambda c: c.releases.select("ratings_count", F.explode(F.array(*[F.lit(x) for x in (1, 5, 10, 20, 30, 50, 100)])).alias("t")).groupBy(F.col("t").cast("long").alias("threshold")).agg(F.round(F.avg((F.col("ratings_count") <= F.col("t")).cast("double")), 6).alias("share")),
         "SELECT t::BIGINT AS threshold, round(avg((ratings_count <= t)::INT), 6) AS share FROM rel, (SELECT unnest([1, 5, 10, 20, 30, 50, 100]) AS t) GROUP BY 1")
register("support_percentiles", lambda c: c.releases.agg(*[F.round(F.percentile("ratings_count", p), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)], F.round(F.avg("ratings_count"), 6).alias("mean"), F.round(F.stddev_samp("ratings_count"), 6).alias("std"), F.min("ratings_count").alias("least"), F.max("ratings_count").alias("most")),
         "SELECT " + ", ".join(f"round(quantile_cont(ratings_count, {p}), 6) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", round(avg(ratings_count), 6) AS mean, round(stddev_samp(ratings_count), 6) AS std, min(ratings_count) AS least, max(ratings_count) AS most FROM rel")
register("genre_stats", lambda c: c.interactions.where("rating > 0").join(c.release_genres, "id_release").join(c.genres, "id_genre").groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean")).where("n >= 100").orderBy(F.desc("n"), "name").limit(20),
         "SELECT name, count(*) AS n, round(avg(rating), 6) AS mean FROM inter JOIN rg USING (id_release) JOIN gen USING (id_genre) WHERE rating > 0 GROUP BY 1 HAVING count(*) >= 100 ORDER BY n DESC, name LIMIT 20")
register("top_user_item_pivot", lambda c: _top_block(c), """
    SELECT id_user, id_release, round(avg(rating), 6) AS rating FROM inter SEMI JOIN (SELECT id_user FROM inter GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50) USING (id_user)
    SEMI JOIN (SELECT id_release FROM inter GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 50) USING (id_release) GROUP BY 1, 2""")
register("role_counts", lambda c: c.users.groupBy(F.coalesce("role", F.lit("unknown")).alias("role")).agg(F.count("*").alias("n")), "SELECT coalesce(role, 'unknown') AS role, count(*) AS n FROM usr GROUP BY 1")
register("releases_per_year", lambda c: c.parts.groupBy("release_year", "release_type").agg(F.count("*").alias("n")), "SELECT release_year, release_type, count(*) AS n FROM parts GROUP BY 1, 2")
register("dashboard", lambda c: c.interactions.agg(F.count("*").alias("ratings"), F.count_distinct("id_user").alias("users"), F.count_distinct("id_release").alias("releases"), F.round(F.avg("rating"), 6).alias("mean"), F.max("rating_date").alias("last")),
         "SELECT count(*) AS ratings, count(DISTINCT id_user) AS users, count(DISTINCT id_release) AS releases, round(avg(rating), 6) AS mean, max(rating_date) AS last FROM inter")


def _top_block(c: Catalogue) -> DataFrame:
    users = c.interactions.groupBy("id_user").count().orderBy(F.desc("count"), "id_user").limit(50).select("id_user")
    items = c.interactions.groupBy("id_release").count().orderBy(F.desc("count"), "id_release").limit(50).select("id_release")
    return c.interactions.join(users, "id_user", "left_semi").join(items, "id_release", "left_semi").groupBy("id_user", "id_release").agg(F.round(F.avg("rating"), 6).alias("rating"))


def _near_sql(item: str, over: str, mi: int, mo: int) -> str:
    return f"""SELECT {item}, neighbour, sim AS similarity, rank FROM (SELECT u AS {item}, v AS neighbour, sim, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS rank FROM (
        SELECT a.{item} AS u, b.{item} AS v, round(sum(a.x * b.x) / (any_value(a.norm) * any_value(b.norm)), 9) AS sim FROM cen a JOIN cen b ON a.{over} = b.{over} AND a.{item} <> b.{item} GROUP BY 1, 2)) WHERE rank <= 30"""


def _centred(item: str, over: str, mi: int, mo: int) -> str:
    return f"""SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {item})) AS norm FROM (SELECT id_user, id_release, rating - avg(rating) OVER (PARTITION BY id_user) AS x FROM inter WHERE rating > 0)
        SEMI JOIN (SELECT {item} FROM inter WHERE rating > 0 GROUP BY 1 HAVING count(*) >= {mi}) USING ({item}) SEMI JOIN (SELECT {over} FROM inter WHERE rating > 0 GROUP BY 1 HAVING count(*) >= {mo}) USING ({over}) QUALIFY norm > 0"""


register("item_neighbours", lambda c: neighbours.neighbours(c.interactions.where("rating > 0"), "id_release", "id_user", 20, 5), _near_sql("id_release", "id_user", 20, 5), cen=_centred("id_release", "id_user", 20, 5))
register("user_neighbours", lambda c: neighbours.neighbours(c.interactions.where("rating > 0"), "id_user", "id_release", 5, 20), _near_sql("id_user", "id_release", 5, 20), cen=_centred("id_user", "id_release", 5, 20))


def _types(c: Catalogue) -> DataFrame:
    return c.parts.agg(F.array_sort(F.collect_set("release_type")).alias("t")).select(F.posexplode("t").alias("type_idx", "release_type")).withColumn("type_idx", F.col("type_idx") + 1)


def _roles(c: Catalogue) -> DataFrame:
    return c.users.agg(F.array_sort(F.collect_set("role")).alias("t")).select(F.posexplode("t").alias("role_idx", "role")).withColumn("role_idx", F.col("role_idx") + 1)


def _activity(c: Catalogue) -> DataFrame:
    return c.interactions.groupBy("id_user").agg(F.count("*").alias("n"), F.date_diff(F.lit(AS_OF).cast("date"), F.min("rating_date")).alias("days"))


# Learning.
register("eligible_matrix", lambda c: features.eligible_matrix(c.interactions.where("rating > 0"), 15, 10), """
    SELECT dense_rank() OVER (ORDER BY id_user) - 1 AS u, dense_rank() OVER (ORDER BY id_release) - 1 AS i, rating FROM inter SEMI JOIN (SELECT id_user FROM inter WHERE rating > 0 GROUP BY 1 HAVING count(*) >= 15) USING (id_user)
    SEMI JOIN (SELECT id_release FROM inter WHERE rating > 0 GROUP BY 1 HAVING count(*) >= 10) USING (id_release) WHERE rating > 0""")
register("item_features", lambda c: features.item_features(c.releases, c.release_genres, _types(c)), """
    SELECT id_release, artist_id, dense_rank() OVER (ORDER BY release_type) AS type_idx, coalesce(g, '') AS genres, round((release_year - 1900) / 200.0::DOUBLE, 6) AS year, round(coalesce(avg_rating / 5, 0), 6) AS avg, round(ln(1 + ratings_count), 6) AS popularity
    FROM rel LEFT JOIN (SELECT id_release, string_agg(id_genre, ',' ORDER BY id_genre) AS g FROM rg GROUP BY 1) USING (id_release)""")
register("user_features", lambda c: features.user_features(c.users, _activity(c), _roles(c)), """
    SELECT id_user, dense_rank() OVER (ORDER BY role) AS role_idx, round(objectivity_score / 100, 6) AS objectivity, round(ln(1 + coalesce(n, 0)), 6) AS ratings, round(least(1.0::DOUBLE, coalesce(days, 0) / 7300.0::DOUBLE), 6) AS age
    FROM usr LEFT JOIN (SELECT id_user, count(*) AS n, date_diff('day', min(rating_date), DATE '2001-09-01') AS days FROM inter GROUP BY 1) USING (id_user)""")
register("negative_samples", lambda c: features.negative_samples(c.positives, c.parts), f"""
    SELECT id_user, id_release AS positive, n, negative FROM (
      SELECT id_user, id_release, k.n, (place + 1 + (((id_user * 2654435761 + id_release * 40503 + {97 * 5}) % 1000003) * 31 + k.n * 7907) % ((SELECT count(*) FROM parts) - 1)) % (SELECT count(*) FROM parts) AS drawn
      FROM pos JOIN placed USING (id_release), (SELECT unnest([1, 2, 3])::BIGINT AS n) k)
    JOIN (SELECT id_release AS negative, place AS drawn FROM placed) USING (drawn)""", placed="SELECT id_release, row_number() OVER (ORDER BY id_release) - 1 AS place FROM parts")
register("als_factors", lambda c: features.als_factors(c.positives))
register("rf_best_strategy", lambda c: features.forest_best_strategy(_labelled(c), ["size", "n"], "best"))


def _labelled(c: Catalogue) -> DataFrame:
    return scores_of(c).join(_activity(whole(c)).select("id_user", "n"), "id_user").withColumn("best", F.when(F.col("pairs") >= F.col("content"), "pairs").otherwise("content"))
