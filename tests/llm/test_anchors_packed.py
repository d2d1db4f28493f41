"""Anchors travel as packed rows, and suffixes are sorted in bounded parts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tunegrid.llm import repeats


def _texts(count, seed=3):
    rng = random.Random(seed)
    common = "".join(rng.choices("abcd ", k=400))
    return [(k, "".join(rng.choices("abcd ", k=300)) + common[: 100 + k]) for k in range(count)]


@pytest.mark.parametrize("buckets,held", [(1, 10**9), (8, 10**9), (8, 50)])
def test_anchors_are_a_row_for_each_bucket_and_keep_both_documents(monkeypatch, buckets, held):
    monkeypatch.setattr(repeats, "HELD_ANCHORS", held)
    monkeypatch.setattr(repeats, "SLICE", 900)
    rows = _texts(20)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t.encode() for _, t in rows])], names=["id", "text"])
    met = {}
    for k, text in rows:
        buffer = np.frombuffer(text.encode(), np.uint8)
        for h in repeats.cut(buffer, np.array([0]), np.array([len(buffer)]), 50, 24)[2].tolist():
            met.setdefault(h, set()).add(k)
    sent = list(repeats._anchors(50, 24, buckets)(iter([batch])))
    if held > 50:
        assert sum(b.num_rows for b in sent) <= buckets < len(met)
    table = pa.Table.from_batches(sent).sort_by("bucket")
    found = [h for b in repeats._shared(iter(table.to_batches(3))) for h in b.column("anchor").to_pylist()]
    assert sorted(found) == sorted(h for h, ids in met.items() if len(ids) > 1)


def test_suffixes_of_one_batch_are_sorted_in_parts_of_whole_anchors(monkeypatch):
    sizes, real = [], repeats.least_sources
    monkeypatch.setattr(repeats, "least_sources", lambda texts, *rest: sizes.append(len(texts)) or real(texts, *rest))
    texts = [t.encode()[-60:] for _, t in _texts(60)]
    anchors = sorted([0] * 12 + [k for k in range(1, 17) for _ in range(3)])
    columns = [pa.array(anchors), pa.array(range(60)), pa.array(range(60)), pa.array(texts, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["anchor", "piece", "least", "text"])
    found = pa.Table.from_batches(list(repeats._runs(50, 5)(iter(batch.slice(lo, 25) for lo in range(0, 60, 25)))))
    assert found.column("piece").to_pylist() == list(range(60)) and max(sizes) <= 12
    assert all(f == min(s) for f, s in zip(found.column("first").to_pylist(), found.column("source").to_pylist(), strict=True))


def test_small_parts_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(_texts(40), "doc_id long, text string").repartition(3)
    want = sorted((r.doc_id, r.starts, r.ends) for r in repeats.remove_repeats(docs).collect())
    monkeypatch.setattr(repeats, "SORTED_PIECES", 4)
    monkeypatch.setattr(repeats, "HELD_ANCHORS", 60)
    assert sorted((r.doc_id, r.starts, r.ends) for r in repeats.remove_repeats(docs).collect()) == want and any(s for _, s, _ in want)
