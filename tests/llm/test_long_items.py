"""Benchmark items of any length, and null ids on either side."""

import random

from tunegrid.llm import decontaminate

SCHEMA = "doc_id long, text string"
ITEMS = "item_id long, text string"


def test_long_items_and_long_documents(spark):
    rng = random.Random(9)
    words = lambda n, start: [f"{start}{rng.randrange(5000)}" for _ in range(n)]
    long = words(40_000, "a")
    other = words(20_000, "b")
    near = long[31_000:31_080]
    for k in range(0, 80, 9):
        near[k] = "changed"
    docs = [
        (1, " ".join(words(20_000, "c"))),
        (2, " ".join(words(300, "c") + long[700:740] + words(300, "c"))),
        (3, " ".join(words(9_000, "c") + near + words(9_000, "c"))),
        (4, " ".join(other)),
        (5, " ".join(long[5:15] + words(30, "c"))),
        (6, " ".join(words(50, "c") + ["q"] * 3_000)),
    ]
    items = [(10, " ".join(long)), (11, " ".join(other)), (12, " ".join(["q"] * 2_000))]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()}
    assert set(got) == {(2, 10), (3, 10), (4, 11), (6, 12)}
    assert got[2, 10].matched == 40 and got[2, 10].start_word == 300 - 700 and got[2, 10].item_words == 40_000
    assert got[3, 10].start_word == 9_000 - 31_000 and got[4, 11].start_word == 0 and got[4, 11].matched > 128


def test_equal_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    item = " ".join(f"t{k}" for k in range(40))
    items = [(k, item) for k in range(20)] + [(50, item + " and more")]
    got = decontaminate.contaminated(spark.createDataFrame([(1, "x " + item), (2, "y")], SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id, r.matched, r.start_word) for r in got) == [(1, k, 40, 1) for k in [*range(20), 50]]


def test_null_ids_of_items_and_documents(spark):
    item = " ".join(f"t{k}" for k in range(20))
    docs = spark.createDataFrame([(1, item), (None, "a b " + item), (None, "nothing of it"), (None, None), (2, "else")], SCHEMA)
    items = spark.createDataFrame([(None, item), (None, "words of another item altogether")], ITEMS)
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id, r.matched) for r in got), key=str) == [(1, None, 20), (None, None, 20)]
    left = decontaminate.drop_contaminated(docs, items).collect()
    assert sorted(tuple(r) for r in left if r.doc_id) == [(2, "else")] and len(left) == 3
