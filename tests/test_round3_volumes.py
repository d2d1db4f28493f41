"""Exchanges of the steps that the third round's findings name."""

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tunegrid.operators import evaluation, pairs
from tunegrid.plans import registry  # noqa: F401  fills the queries before its parts are named
from tunegrid.plans import analysis, extra  # noqa: E402, I001
from tunegrid.sources.adapter import Catalogue

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_travel_as_lists_and_hot_releases_come_last(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LEAST_HOT", 2, raising=False)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 3, raising=False)
    likes = {1: [5, 2, 9], 2: [5, 2], 3: [5, 9, 7], 4: [5], 5: [9, 2, 5, 7]}
    rows = [(u, r) for u, of in likes.items() for r in of] + [(None, 5), (None, 2), (1, 5)]
    found = pairs.release_pairs(spark.createDataFrame(rows, "id_user long, id_release long"), 1)
    want = Counter(p for of in likes.values() for a, b in combinations(of, 2) for p in ((a, b), (b, a)))
    assert {(r.id_release_1, r.id_release_2): r.pair_count for r in found.collect()} == want
    # A release is sent with those after it, as one row.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan


def test_recommended_pairs_meet_histories_by_user(spark):
    positives = spark.createDataFrame([(1, 5, 4.0, None), (2, 7, 5.0, None)], "id_user long, id_release long, rating double, rating_date date")
    table = spark.createDataFrame([(5, 7, 3, 0.5, 0.5), (5, 9, 2, 0.5, 0.5), (7, 5, 3, 0.5, 0.5)], "id_release_1 long, id_release_2 long, pair_count long, jaccard double, lift double")
    found = pairs.recommend_pairs(positives, positives.unionByName(positives.withColumn("id_release", F.lit(9).cast("long")).where("id_user = 1")), table)
    assert sorted((r.id_user, r.id_release, r["rank"]) for r in found.collect()) == [(1, 7, 1), (2, 5, 1)]
    exchanged = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert not any("id_user" in line and "id_release" in line for line in exchanged)


def test_scores_need_no_facts_of_releases_and_equal_the_metrics(spark):
    c = Catalogue(spark, SF)
    lists, relevant = analysis.lists_of(c), analysis.relevant_of(c)
    found = evaluation.ndcg_by_user(lists, relevant, analysis.STRATEGIES)
    long = evaluation.metrics_long(lists, relevant, analysis.whole(c).releases, c.release_genres).where("metric = 'ndcg'")
    want = {(r.id_user, r.strategy): round(r.value, 9) for r in long.collect()}
    got = {(r.id_user, s): round(r[s], 9) for r in found.collect() for s in analysis.STRATEGIES}
    assert want and all(got[k] == v for k, v in want.items()) and all(v == 0 for k, v in got.items() if k not in want)


def test_stored_ratings_are_exchanged_by_user_only(spark):
    c = Catalogue(spark, SF)
    assert "hashpartitioning(id_user" in _plan(evaluation.with_parts(c.by_user())) and _plan(evaluation.with_parts(c.by_user())).count("Exchange hashpartitioning(id_user") == 1
    assert "lineitem" not in "".join(extra._two_lists(c).inputFiles())


def test_hybrid_makes_each_list_for_the_users_that_get_it(spark, monkeypatch):
    from tunegrid.operators import content, fusion
    from tunegrid.plans import recommend

    c, met = Catalogue(spark, SF), {}

    def spy(module, name, at):
        real = getattr(module, name)

        def run(*args, **kwargs):
            met[name] = {r.id_user for r in args[at].select("id_user").distinct().collect()}
            return real(*args, **kwargs)

        monkeypatch.setattr(module, name, run)

    spy(pairs, "recommend_pairs", 1), spy(content, "recommend_content", 0), spy(fusion, "popular_unseen", 0)
    found = recommend.hybrid_of(c.settled())
    signals = {r.id_user: r.n_pos for r in c.settled().signals.collect()}
    assert found.count() and met["recommend_pairs"] == {u for u, n in signals.items() if 1 <= n <= 8}
    assert not any(signals.get(u, 0) <= 8 for u in met["recommend_content"]) and len(met["popular_unseen"]) < c.users.count()


def test_diversified_lists_are_exchanged_by_user_once(spark):
    from tunegrid.operators.ranking import diversify

    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 7)], "id_user long, rank long, id_release long")
    releases = spark.createDataFrame([(5, 1), (6, 1), (7, 2)], "id_release long, artist_id long")
    found = diversify(ranked, releases, 2)
    assert [(r.id_release, r["rank"]) for r in found.orderBy("rank").collect()] == [(5, 1), (7, 2)]
    assert _plan(diversify(ranked, releases, 2)).count("Exchange hashpartitioning(id_user") == 1
