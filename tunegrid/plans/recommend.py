"""Queries of the recommenders: pairs, content, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.operators import content, fusion, pairs, vectors
from tunegrid.plans import oracle as O
from tunegrid.plans.registry import register
from tunegrid.sources.adapter import POSITIVE, Catalogue
from tunegrid.sources.staging import staged

LIMIT = 9


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def pair_table(c: Catalogue) -> DataFrame:
    """The pair table, computed once from the stored ratings."""
    c = c.settled()
    if "_pairs" not in c.__dict__:
        c._pairs = staged(pairs.release_pairs(c.positives), "pairs")
    return c._pairs


def pairs_of(c: Catalogue, limit: int) -> DataFrame:
    c = c.settled()
    return pairs.recommend_pairs(c.positives, c.interactions, pair_table(c), limit)


def content_of(c: Catalogue, limit: int) -> DataFrame:
    c = c.settled()
    return content.recommend_content(c.interactions, c.releases, c.release_genres, limit)


def _cut_or_made(c: Catalogue, name: str, limit: int, make) -> DataFrame:
    """Ranked lists of a settled catalogue are made once; shorter ones are their beginnings."""
    if c.__dict__.get("_settled") is not c:
        return make(limit)
    longest, lists = c.__dict__.get(f"_{name}_lists", (0, None))
    if longest < limit:
        lists = make(limit)
        c.__dict__[f"_{name}_lists"] = limit, lists
    return lists.where(F.col("rank") <= limit)


def vectors_of(c: Catalogue, limit: int) -> DataFrame:
    return _cut_or_made(c, "vectors", limit, lambda n: vectors.recommend_vectors(vectors.user_vectors(c.positives, c.vectors, 20), c.vectors, c.interactions, n))


def towers_of(c: Catalogue, limit: int) -> DataFrame:
    return _cut_or_made(c, "towers", limit, lambda n: vectors.recommend_vectors(vectors.user_vectors(c.positives, c.towers, 30), c.towers, c.interactions, n, dim=32, metric="dot"))


def rankings_of(c: Catalogue, limit: int = 4 * LIMIT) -> DataFrame:
    """The four lists, computed once: fusion and the search for users without any both read them."""
    c = c.settled()
    lists = {"pairs": pairs_of(c, limit), "content": content_of(c, limit), "nmf": vectors_of(c, limit), "two_towers": towers_of(c, limit)}
    return staged(fusion.strategy_rankings(lists, c.signals), "rankings")


def advanced_of(c: Catalogue, limit: int = LIMIT) -> DataFrame:
    return fusion.recommend_advanced(c.signals, vectors_of(c, 3 * limit), towers_of(c, 3 * limit), limit)


def links_of(c: Catalogue) -> DataFrame:
    """Direct recommendations stand in as each release's five strongest pairs."""
    from tunegrid.operators.ranking import top_per_user

    rows = pair_table(c).select(F.col("id_release_1").alias("id_release"), F.col("id_release_2").alias("candidate"), "pair_count")
    return top_per_user(rows, 5, F.desc("pair_count"), F.asc("candidate"), by=("id_release",)).select("id_release", "candidate")


def contexts_of(c: Catalogue) -> DataFrame:
    """Each user on the page of the release they rated last."""
    last = c.interactions.groupBy("id_user").agg(F.max(F.struct("rating_date", "id_release")).alias("m"))
    return last.select("id_user", "m.id_release")


register("release_pairs", lambda c: rounded(pair_table(c), "jaccard", "lift"), "SELECT id_release_1, id_release_2, pair_count, round(jaccard, 6) AS jaccard, round(lift, 6) AS lift FROM prs")
register("pair_scores", lambda c: rounded(pairs.pair_scores(c.settled().positives, pair_table(c), 27), "score"), f"SELECT id_user, id_release, round(score, 6) AS score, rank FROM ({O.pair_scores(27)})")
register("recommend_pairs", lambda c: rounded(pairs_of(c, LIMIT), "score"), f"SELECT id_user, id_release, round(score, 6) AS score, rank FROM ({O.rec_pairs(LIMIT)})")
register("profile_genres", lambda c: rounded(content.profile_genres(c.positives, c.release_genres), "weight"), "SELECT id_user, id_genre, round(weight, 6) AS weight FROM ug")
register("profile_artists", lambda c: rounded(content.profile_artists(c.positives, c.releases), "weight"), "SELECT id_user, artist_id, round(weight, 6) AS weight FROM ua")
register("candidate_pool", lambda c: content.candidate_pool(c.interactions, c.releases, c.release_genres), O.pool(LIMIT))
register("recommend_content", lambda c: rounded(content_of(c, LIMIT), "score"), f"SELECT id_user, id_release, round(score, 6) AS score, rank FROM ({O.rec_content(LIMIT)})")
register(
    "user_vectors", lambda c: vectors.user_vectors(c.positives, c.vectors).select("id_user", F.posexplode("vector").alias("d", "v")).select("id_user", (F.col("d") + 1).cast("long").alias("d"), F.round("v", 6).alias("v")),
    "SELECT id_user, d::BIGINT AS d, round(v, 6) AS v FROM uv",
)
register("recommend_cosine", lambda c: rounded(vectors_of(c, LIMIT), "score"), f"SELECT id_user, id_release, round(score, 6) AS score, rank FROM ({O.rec_vectors(LIMIT)})")
register("recommend_dot", lambda c: rounded(towers_of(c, LIMIT), "score"), f"SELECT id_user, id_release, round(score, 6) AS score, rank FROM ({O.rec_towers(LIMIT)})")
register("vector_validity", lambda c: vectors.vector_validity(c.vectors), "SELECT vec_id AS id_release, coalesce(len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0, false) AS valid FROM embeddings")
register("popular_unseen", lambda c: fusion.popular_unseen(c.users, c.interactions, c.releases), O.popular(LIMIT))
register(
    "random_unseen", lambda c: fusion.random_unseen(c.users, c.interactions, c.releases).select("id_user", "rank", "id_release"),
    f"""SELECT id_user, row_number() OVER (PARTITION BY id_user ORDER BY (id_user * 2654435761 + id_release * 40503 + {97 * 97}) % 1000003, id_release) AS rank, id_release
        FROM (SELECT * FROM usr, parts) ANTI JOIN inter USING (id_user, id_release) QUALIFY rank <= {LIMIT}""",
)
register("linear_rank_scores", lambda c: rounded(fusion.linear_scores(pairs_of(c, LIMIT)), "rank_score").select("id_user", "id_release", "rank", "rank_score"), f"SELECT id_user, id_release, rank, round(rank_score, 6) AS rank_score FROM ({O.linear(O.rec_pairs(LIMIT))})")
register("recommend_advanced", lambda c: rounded(advanced_of(c), "score"), f"SELECT id_user, id_release, round(score, 6) AS score, rank FROM ({O.advanced(LIMIT)})")
register("rrf_rankings", rankings_of, O.rankings(4 * LIMIT))
register("explanations", lambda c: fusion.explanations(rankings_of(c)), """
    SELECT id_user, n::BIGINT AS n_strategies, CASE WHEN n >= 4 THEN 'Mejores recomendaciones combinando ' || n || ' algoritmos (RRF)' WHEN n = 3 THEN 'Recomendaciones combinando 3 algoritmos (RRF)'
      ELSE 'Recomendaciones basadas en ' || names END AS explanation
    FROM (SELECT id_user, count(*) AS n, string_agg(CASE strategy WHEN 'pairs' THEN 'co-ocurrencia' WHEN 'content' THEN 'contenido' WHEN 'nmf' THEN 'patrones latentes' ELSE 'aprendizaje profundo' END, ' y '
      ORDER BY list_position(['pairs', 'content', 'nmf', 'two_towers'], strategy)) AS names FROM (SELECT DISTINCT id_user, strategy FROM rankings) GROUP BY 1)""", rankings=O.rankings(4 * LIMIT))
_RRF = f"""SELECT id_user, place AS rank, id_release, round(score, 6) AS score FROM ({O.diversified(O.fused(LIMIT), LIMIT, ', score')})
    UNION ALL SELECT id_user, rank, id_release, NULL::DOUBLE FROM ({O.popular(LIMIT, 'SELECT id_user FROM usr ANTI JOIN rankings USING (id_user)')})"""
register("recommend_rrf", lambda c: fusion.recommend_rrf(rankings_of(c), c.settled().releases, c.users, c.settled().interactions), _RRF, rankings=O.rankings(4 * LIMIT))
register("diversify", lambda c: diversified_pairs(c), f"SELECT id_user, place AS rank, id_release FROM ({O.diversified(O.rec_pairs(36), LIMIT)})")


def diversified_pairs(c: Catalogue) -> DataFrame:
    from tunegrid.operators.ranking import diversify

    return diversify(pairs_of(c, 36), c.releases, LIMIT).select("id_user", "rank", "id_release")


def _max_lists(c: Catalogue) -> list[tuple[str, DataFrame]]:
    c = c.settled()
    some = c.signals.where("n_pos > 0").select("id_user")
    return [("pairs", pairs_of(c, 54).join(some, "id_user", "left_semi")), ("content", content_of(c, 27)), ("advanced", advanced_of(c, 18))]


_BEST = " UNION ALL ".join(
    f"SELECT id_user, id_release, {score} AS score, {k} AS p, '{name}' AS strategy FROM ({sql})"
    for k, (name, sql, score) in enumerate((("pairs", O.rec_pairs(54), "round(1.0::DOUBLE - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY id_user), 9)"), ("content", O.rec_content(27), "round(1.0::DOUBLE - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY id_user), 9)"), ("advanced", O.advanced(18), "score")))
)
_MAXED = "SELECT *, row_number() OVER (PARTITION BY id_user ORDER BY score DESC, id_release) AS rank FROM (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY id_user, id_release ORDER BY score DESC, p) = 1)"
register("recommend_max_ensemble", lambda c: fusion.recommend_max(_max_lists(c), c.settled().releases, c.users, c.settled().interactions), f"""
    SELECT id_user, place AS rank, id_release, round(score, 6) AS score, strategy FROM ({O.diversified(_MAXED, LIMIT, ', score, strategy')})
    UNION ALL SELECT id_user, rank, id_release, NULL::DOUBLE, 'popular' FROM ({O.popular(LIMIT, 'SELECT id_user FROM usr ANTI JOIN best USING (id_user)')})""", best=_BEST)

HYBRID_PARTS = {
    "tiers": "SELECT id_user, coalesce(n_pos, 0) AS n, id_user IN (SELECT id_user FROM adv) AS has FROM usr LEFT JOIN sig USING (id_user)",
    "picked": f"""SELECT id_user, id_release, rank, 0 AS source FROM ({O.rec_pairs(LIMIT)}) SEMI JOIN (FROM tiers WHERE n BETWEEN 1 AND 8) USING (id_user)
      UNION ALL SELECT id_user, id_release, rank, 0 FROM adv SEMI JOIN (FROM tiers WHERE n >= 20 AND has) USING (id_user)
      UNION ALL SELECT id_user, id_release, rank, 0 FROM ({O.rec_content(LIMIT)}) SEMI JOIN (FROM tiers WHERE n >= 9 AND NOT (n >= 20 AND has)) USING (id_user)"""
}


def hybrid_of(c: Catalogue) -> DataFrame:
    """Each list is made for the users that it is picked for, and stored: fusion reads the lists several times."""
    c = c.settled()
    advanced = staged(advanced_of(c), "advanced")
    picks = staged(fusion.hybrid_picks(c.users, c.signals, advanced), "picks")
    of = lambda rows, name: rows.join(picks.where(F.col("pick") == name).select("id_user"), "id_user", "left_semi")
    rows = of(c.interactions, "pairs")
    from_pairs = pairs.recommend_pairs(rows.where(F.col("rating") >= POSITIVE), rows, pair_table(c), LIMIT)
    from_content = content.recommend_content(staged(of(c.interactions, "content"), "of_content"), c.releases, c.release_genres, LIMIT)
    main = staged(fusion.picked_lists(picks, {"pairs": from_pairs, "content": from_content, "advanced": advanced}), "picked")
    short = staged(fusion.short_of(picks, main, LIMIT), "short")
    popular = fusion.popular_unseen(short, c.interactions.join(short, "id_user", "left_semi"), c.releases)
    return fusion.topped_up(main, popular, c.releases)


register("recommend_hybrid", lambda c: hybrid_of(c.settled()), f"""
    SELECT id_user, place AS rank, id_release FROM ({O.diversified('''SELECT id_user, id_release, row_number() OVER (PARTITION BY id_user ORDER BY source, rank) AS rank FROM (
      SELECT * FROM (SELECT id_user, id_release, source, rank FROM picked
        UNION ALL SELECT id_user, id_release, 1, rank FROM pop ANTI JOIN (SELECT id_user FROM picked GROUP BY 1 HAVING count(*) >= 9) USING (id_user))
      QUALIFY row_number() OVER (PARTITION BY id_user, id_release ORDER BY source, rank) = 1)''', LIMIT)})""",
    adv=O.advanced(LIMIT), pop=O.popular(LIMIT), **HYBRID_PARTS)


def context_of(c: Catalogue) -> DataFrame:
    return fusion.recommend_context(contexts_of(c), links_of(c), pair_table(c), c.releases, c.interactions, fusion.popular_unseen(c.users, c.interactions, c.releases, 3))


register("recommend_context", lambda c: context_of(c.settled()), f"""
    SELECT id_user, id_release, row_number() OVER (PARTITION BY id_user, id_release ORDER BY source, r, candidate) AS rank, candidate FROM (
      SELECT id_user, id_release, candidate, source, r FROM (
        SELECT ctx.id_user, ctx.id_release, candidate, source, r FROM ctx JOIN cand ON cand.anchor = ctx.id_release
        WHERE candidate <> ctx.id_release AND NOT EXISTS (SELECT 1 FROM inter i WHERE i.id_user = ctx.id_user AND i.id_release = candidate)
        UNION ALL SELECT ctx.id_user, ctx.id_release, pop.id_release, 3, pop.rank FROM ctx JOIN pop USING (id_user) WHERE pop.id_release <> ctx.id_release)
      QUALIFY row_number() OVER (PARTITION BY id_user, id_release, candidate ORDER BY source, r) = 1)
    QUALIFY rank <= 3""",
    ctx="SELECT id_user, id_release FROM inter QUALIFY row_number() OVER (PARTITION BY id_user ORDER BY rating_date DESC, id_release DESC) = 1", pop=O.popular(3),
    lnk="SELECT id_release_1 AS anchor, id_release_2 AS candidate FROM prs QUALIFY row_number() OVER (PARTITION BY id_release_1 ORDER BY pair_count DESC, id_release_2) <= 5",
    d0="SELECT anchor, candidate, row_number() OVER (PARTITION BY anchor ORDER BY ratings_count DESC NULLS LAST, avg_rating DESC NULLS LAST, candidate) AS r FROM lnk JOIN rel ON rel.id_release = candidate QUALIFY r <= 6",
    d1="""SELECT id_release_1 AS anchor, id_release_2 AS candidate, row_number() OVER (PARTITION BY id_release_1 ORDER BY pair_count DESC, id_release_2) AS r FROM prs
      WHERE id_release_1 NOT IN (SELECT anchor FROM d0 GROUP BY 1 HAVING count(*) >= 3) QUALIFY r <= 15""",
    d2="""SELECT a.id_release AS anchor, b.id_release AS candidate, row_number() OVER (PARTITION BY a.id_release ORDER BY b.release_year DESC NULLS LAST, b.id_release) AS r
      FROM parts a JOIN parts b ON a.artist_id = b.artist_id AND a.id_release <> b.id_release
      WHERE a.artist_id > 0 AND a.id_release NOT IN (SELECT anchor FROM (SELECT anchor FROM d0 UNION ALL SELECT anchor FROM d1) GROUP BY 1 HAVING count(*) >= 3) QUALIFY r <= 6""",
    cand="SELECT anchor, candidate, 0 AS source, r FROM d0 UNION ALL SELECT anchor, candidate, 1, r FROM d1 UNION ALL SELECT anchor, candidate, 2, r FROM d2")
