"""Decontamination finds changed items of every length: the masks by enumeration, the operator at the shortest lengths."""

import itertools

import pytest

from tunegrid.llm import decontaminate as d


@pytest.mark.parametrize("n", range(8, 26))
def test_masks_find_almost_all_ways_to_change_an_item(n):
    masks = d.SHORT_MASKS if n < d.SHORT else d.MASKS
    seeds = [sum(1 << (at + k) for k, bit in enumerate(m) if bit == "1") for m in masks for at in range(n - len(m) + 1)]
    ways = [sum(1 << k for k in some) for some in itertools.combinations(range(n), n - -(-n * 4 // 5))]
    assert sum(any(not seed & way for seed in seeds) for way in ways) >= 0.95 * len(ways)


@pytest.mark.parametrize("n,least", [(8, 1.0), (9, 1.0), (10, 0.95), (12, 1.0), (15, 0.97)])
def test_recall_on_documents(spark, n, least):
    item = [f"w{k}" for k in range(n)]
    ways = list(itertools.combinations(range(n), n - -(-n * 4 // 5)))
    text = lambda some: " ".join(["some", "words", "before"] + [f"x{k}" if k in some else w for k, w in enumerate(item)] + ["and", "after", "it"])
    docs = spark.createDataFrame([(k, text(some)) for k, some in enumerate(ways)], "doc_id long, text string")
    found = d.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).select("doc_id").distinct().count()
    assert found >= least * len(ways)
    too_far = spark.createDataFrame([(0, text(range(n - -(-n * 4 // 5) + 1)))], "doc_id long, text string")
    assert d.contaminated(too_far, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).count() == 0
