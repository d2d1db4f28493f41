"""Importance resampling against a plain computation of its rule."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tunegrid.llm import common, resampling

SCHEMA = "doc_id long, text string, row long, feature string, weight long, bucket int, n_words int"


def words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def features(text, n):
    w = words(text)
    return Counter(" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1))


def brute(docs, target, n, buckets, least, percent):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    for texts, into in (([d[1] for d in docs], s), (target, t)):
        for text in texts:
            for f, k in features(text, n).items():
                into[bucket(f)] += k
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc_id, text in docs:
        f = features(text, n)
        weight = sum(gain(bucket(x)) * k for x, k in f.items())
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((r[:5] for r in out), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pool = ["the", "The", "river", "x1", "é", "Éa", "don't", "42", "zebra\x00q", "été,nord"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choices(pool, k=rng.randrange(60)))) for k in range(150)]
    return docs + [(7, docs[7][1]), (None, docs[9][1]), (None, None), (501, ""), (502, None), (503, "?! "), (504, "the " * 40_000), (505, "z" * 70_000)]


@pytest.mark.parametrize("n,percent", [(1, 10), (2, 37)])
def test_equals_brute_force(spark, rows, monkeypatch, n, percent):
    monkeypatch.setattr(common, "LEAST_HOT", 5)  # frequent words by broadcast, rare ones by exchange
    monkeypatch.setattr(resampling, "FLUSH", 500)
    monkeypatch.setattr(resampling, "ROWS_PER_RANGE", 40)
    target = ["the river zebra w1 w2", None, "", "w3 w3 w4"]
    docs = spark.createDataFrame([(*r, 1, "f", 2, 3, 4) for r in rows], SCHEMA)
    got = resampling.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()), key=str) == brute(rows, target, n, 97, 20, percent)


def test_empty_tables(spark, rows):
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_resample(none, docs).collect() == []
    assert resampling.importance_resample(docs, none).count() == len(rows)
    assert resampling.importance_resample(none, none).collect() == []
