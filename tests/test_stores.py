"""Differences of stores and closed samples on small tables."""

import pytest

from tunegrid.operators import stores


def test_difference_finds_every_change_and_reads_only_differing_buckets(spark):
    schema = "k long, name string, n long"
    old = spark.createDataFrame([(k, f"r{k}", k) for k in range(300)] + [(None, "x", None)], schema)
    rows = {k: (k, f"r{k}", k) for k in range(300)}
    rows[5], rows[6], rows[300] = (5, None, 5), (6, "r6", None), (300, "new", 1)
    del rows[7]
    new = spark.createDataFrame([*rows.values(), (None, "x", 4)], schema)
    got = {(r.k, r.change, r.columns) for r in stores.difference(old, new, ["k"]).collect()}
    assert got == {(5, "changed", "name"), (6, "changed", "n"), (7, "removed", ""), (300, "added", ""), (None, "changed", "n")}
    assert 1 <= stores.differing_buckets(old, new, ["k"], 256).count() <= 5
    assert stores.difference(old, old, ["k"]).collect() == [] and stores.differing_buckets(old, old.repartition(3), ["k"]).collect() == []
    swapped = spark.createDataFrame([(1, None, 2), (2, "a", None)], schema)
    assert stores.difference(swapped, swapped.limit(0), ["k"]).count() == 2


def test_closed_sample_has_no_orphans_and_no_more_than_needed(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    full = {
        "rating": frame([(1, 10), (2, 11), (3, 12), (9, 99)], "user long, item long"), "user": frame([(1, 100), (2, None), (3, 100)], "id long, city long"),
        "item": frame([(10,), (11,), (12,)], "id long"), "city": frame([(100,), (101,)], "id long"),
    }
    links = [("rating", "user", "user", "id"), ("rating", "item", "item", "id"), ("user", "city", "city", "id")]
    sample = stores.closed_sample(full, {"rating": full["rating"].where("user <> 3"), "item": full["item"].where("id = 12")}, links)
    got = {name: sorted(map(tuple, df.collect())) for name, df in sample.items()}
    assert got == {"rating": [(1, 10), (2, 11), (9, 99)], "user": [(1, 100), (2, None)], "item": [(10,), (11,), (12,)], "city": [(100,)]}
    assert {(r.child, r.column): r.n for r in stores.orphans_of(sample, links).collect()} == {("rating", "user"): 1, ("rating", "item"): 1, ("user", "city"): 0}
    with pytest.raises(ValueError):
        stores.closed_sample(full, {}, [*links, ("city", "id", "rating", "user")])
