"""Exact top products where most scores are equal."""

import numpy as np
import pytest

from tunegrid.operators import inner_product


@pytest.mark.parametrize("kind", ["zeros", "equal", "few values"])
def test_ties_close_later_groups_and_stay_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(inner_product, "GROUP_BYTES", 1)
    rng = np.random.default_rng(4)
    users = rng.integers(0, 3, (30, 2)).astype(float)
    items = {"zeros": np.zeros((120, 2)), "equal": np.tile([1.0, 2.0], (120, 1)), "few values": rng.integers(0, 2, (120, 2)).astype(float)}[kind]
    ids = rng.permutation(120).tolist()
    seen = {(u, i) for u in range(30) for i in rng.choice(120, 5, replace=False).tolist()} | {(3, i) for i in range(118)}
    frames = [spark.createDataFrame([(k, v) for k, v in zip(keys, rows.tolist(), strict=True)], f"{name} long, vector array<double>") for keys, rows, name in ((range(30), users, "id_user"), (ids, items, "id_release"))]
    visits = []
    found = inner_product.top_inner_products(*frames, spark.createDataFrame(sorted(seen), "id_user long, id_release long"), 4, block=20, visits=visits)
    got = sorted((r.id_user, r["rank"], r.id_release, r.score) for r in found.collect())
    want = []
    for u in range(30):
        listed = sorted((-round(float(users[u] @ v), 9), i) for i, v in zip(ids, items, strict=True) if (u, i) not in seen)[:4]
        want += [(u, k, i, -s) for k, (s, i) in enumerate(listed, 1)]
    assert got == sorted(want)
    if kind == "zeros":
        # Only the user who has seen nearly all is still open after the first group.
        assert visits[0] == 30 and all(v <= 3 for v in visits[1:])


def test_a_block_of_ties_gives_a_few_only():
    scores = np.zeros((5, 1000))
    scores[0, 7], scores[1, 3] = 1.0, -np.inf
    row, col = inner_product._entering(scores, np.full(5, -1.0), 3)
    assert [col[row == k].tolist() for k in range(5)] == [[0, 1, 2, 7], [0, 1, 2], [0, 1, 2], [0, 1, 2], [0, 1, 2]]
