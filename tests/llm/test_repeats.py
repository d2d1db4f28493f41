"""Ids that repeat with other texts, and groups around one hub."""

import itertools
import random

import pytest

from tunegrid.llm import components, near_dup

SCHEMA = "doc_id long, text string"


def near(text, word):
    return text.replace("w7 ", f"{word} ", 1)


A = " ".join(f"w{k}" for k in range(40))
B = " ".join(f"v{k}" for k in range(40)) + " w7 end"


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::5])
def test_id_with_several_texts_links_their_groups(spark, order):
    rows = [(1, A), (1, B), (5, near(B, "x")), (9, near(A, "y"))]
    got = near_dup.near_duplicates(spark.createDataFrame([rows[k] for k in order], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (5, 1, False), (9, 1, False)]


def test_wordless_text_of_an_id_with_another_text(spark):
    got = near_dup.near_duplicates(spark.createDataFrame([(1, A), (4, A), (4, None), (6, None), (None, A)], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == [(1, 36, 1, True), (4, 0, 1, False), (4, 36, 1, False), (6, 0, 6, True), (None, 36, None, False)]


@pytest.mark.parametrize("turn", [False, True])
def test_row_that_stays_of_a_repeated_id(spark, turn):
    rows = [(1, B, 3), (1, A, 2), (1, A, 1), (2, near(A, "x"), 0), (3, "other words altogether here now", 5)]
    left = near_dup.drop_near_duplicates(spark.createDataFrame(rows[::-1] if turn else rows, f"{SCHEMA}, extra int"))
    assert sorted(tuple(r) for r in left.collect()) == [(1, B, 3), (3, "other words altogether here now", 5)]


@pytest.mark.parametrize("held", [1, 2_000_000])
def test_components_of_stars_chains_and_random_edges(spark, monkeypatch, held):
    from tunegrid.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(components, "FOREST_NODES", held)
    if held == 1:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    rng = random.Random(1)
    edges = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000)]
    sets = components.UnionFind()
    for u, v in edges:
        sets.union(u, v)
    try:
        got = components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(16)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.node: r.component for r in got} == {x: sets.find(x) for x in {n for e in edges for n in e} if sets.find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
