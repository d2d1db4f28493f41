"""Texts with thousands of secrets, tight clusters of vectors, and the key of the pseudonyms."""

import random
import time

import numpy as np

from tunegrid.llm import embedding_join, queries, secrets


def test_redaction_of_many_and_nested_spans_equals_a_walk(spark):
    rng = random.Random(6)
    some = lambda: rng.choice(["é ", "x\n", "😀", f"password={rng.choice(['abc', 'dead' * 9, 'AKIA' + 'Q' * 20, 'a.' + 'be' * 14 + '.' + 'ca' * 14])} ", "ab" * 13 + " ", "word "])
    texts = ["".join(some() for _ in range(n)) for n in (0, 1, 2, 30, 63, 64, 65, 700, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.secrets for r in secrets.find_secrets(docs).collect()}
    for r in secrets.redact_secrets(docs).collect():
        at, out = 0, []
        for s in sorted(spans[r.doc_id], key=lambda s: s["start"]):
            if s["start"] >= at:
                out += [texts[r.doc_id][at : s["start"]], "<secret>"]
            at = max(at, s["end"])
        assert r.text == "".join(out) + texts[r.doc_id][at:]


def test_redaction_is_linear(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "password=hunter22 and " * n)], "doc_id long, text string")
        begun = time.perf_counter()
        assert secrets.redact_secrets(docs).first().text == "<secret> and " * n
        return time.perf_counter() - begun

    seconds(100)
    few, many = seconds(2_000), seconds(16_000)
    assert many < 8 * few + 5


def test_tight_cluster_is_no_slower_than_its_matrix(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=16)
    rows = [(k, (base + rng.normal(0, 0.001, 16)).tolist()) for k in range(3000)]
    begun = time.perf_counter()
    got = embedding_join.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.n_links == 2999 and r.component_id == 0 for r in got) and time.perf_counter() - begun < 60


def test_key_of_a_session_is_its_own(spark):
    drawn = queries.pii_key(spark)
    assert len(drawn) == 64 and queries.pii_key(spark) == drawn
    spark.conf.set(queries.PII_KEY, "given")
    assert queries.pii_key(spark) == "given"
    spark.conf.unset(queries.PII_KEY)
