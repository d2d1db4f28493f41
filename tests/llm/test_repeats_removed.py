"""Removal of repeated strings against a dictionary of all strings, and the suffix array against sorting."""

import random

import numpy as np
import pytest

from tunegrid.llm import repeats

SCHEMA = "doc_id long, text string, anchor long, piece long, at long, kept binary"


@pytest.mark.parametrize("n,top,seed", [(0, 2, 0), (1, 2, 0), (3, 2, 1), *[(n, top, n) for n in (4, 5, 6, 7, 50, 300, 301, 302) for top in (1, 2, 4, 200_000, 3_000_000)]])
def test_suffix_array_is_the_sorted_order(n, top, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, top + 1, n)
    got = repeats.suffix_array(x, 10**9)
    assert got.tolist() == sorted(range(n), key=lambda k: x[k:].tolist())
    bounded = repeats.suffix_array(x, 5)
    assert sorted(bounded.tolist()) == list(range(n))
    heads = [x[k : k + 5].tolist() for k in bounded.tolist()]
    assert heads == sorted(heads)


def brute(rows, length):
    least = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1) if doc_id is not None else ():
            least[data[k : k + length]] = min(doc_id, least.get(data[k : k + length], doc_id))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = [False] * (len(data) + 1)
        for k in range(len(data) - length + 1) if doc_id is not None else ():
            if least[data[k : k + length]] < doc_id:
                gone[k : k + length] = [True] * length
        spans = sum(gone[k] and not gone[k + 1] for k in range(len(data)))
        out.append((doc_id, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=False) if not g)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    text = lambda n, letters="abcdeé \n": "".join(rng.choices(letters, k=n))
    passages = [text(n) for n in (49, 50, 51, 90, 300)]
    found = []
    for k in range(120):
        parts = [text(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            passage = rng.choice(passages)
            if rng.random() < 0.4:
                at = rng.randrange(len(passage))
                passage = passage[:at] + rng.choice("xyz") + passage[at + 1 :]
            parts += [passage, text(rng.randrange(40))]
        found.append((k, "".join(parts)))
    found += [(200 + k, found[5][1]) for k in range(30)] + [(300, "a" * 400), (301, "a" * 120 + "b"), (302, "ab" * 90), (303, text(30, "ab") + "a" * 55)]
    found += [(7, found[7][1]), (7, found[8][1]), (400, None), (401, ""), (402, "short"), (None, found[5][1]), (None, None), (403, "".join(passages) * 20), (-4, passages[4])]
    rng.shuffle(found)
    return found


@pytest.mark.parametrize("case", ["plain", "small", "hot", "no filter"])
def test_equals_dictionary_of_strings(spark, rows, monkeypatch, case):
    if case == "small":
        monkeypatch.setattr(repeats, "SLICE", 700)
        monkeypatch.setattr(repeats, "BUCKET_PIECES", 15)
    if case == "hot":
        monkeypatch.setattr(repeats, "HOT_PIECES", 3)
    if case == "no filter":
        monkeypatch.setattr(repeats, "FILTER_BITS", 64)
    docs = spark.createDataFrame([(*r, 1, 2, 3, b"x") for r in rows], SCHEMA).repartition(4)
    got = repeats.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, 50)


def test_other_lengths_and_empty_table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(docs, length=20, anchor=9).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, 20)
    assert repeats.remove_repeats(docs.limit(0)).collect() == []
