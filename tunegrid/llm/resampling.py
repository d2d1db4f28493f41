"""Importance resampling towards a target distribution: hashed n-gram buckets through a dictionary of distinct features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrid.llm.common import hot_join, numbered, release, staged

#: Buckets, words that a document needs to be drawn, share of those drawn in percent, seed of the noise.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Distinct features of a task that leave Python in one batch, and rows that one task sorts.
FLUSH, ROWS_PER_RANGE = 200_000, 200_000
#: What is no part of a word: ASCII but digits and letters; A-Z are lower-cased. Bytes from 0x80 are parts of words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_NAMES = ["row", "id", "n_words", "n_features", "feature", "times"]


def _counter(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row, id, text as bytes) to one row each with the text's distinct runs of 1 to n words and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            features = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(words, pa.binary()))
            times = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(counts, pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0).slice(begun, at - begun), batch.column(1).slice(begun, at - begun), pa.array(lengths, pa.int64()), pa.array(sizes, pa.int64()), features, times], names=_NAMES)

        for batch in batches:
            begun, cuts, words, counts, lengths, sizes, at = 0, [0], [], [], [], [], 0
            for at, text in enumerate(batch.column(2), 1):
                tokens = (text.as_py() or b"").translate(_FOLD).split()
                found = Counter(tokens)
                for k in range(2, n + 1):
                    found.update(b" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
                words += found.keys()
                counts += found.values()
                cuts.append(len(words))
                lengths.append(len(tokens))
                sizes.append(sum(max(0, len(tokens) - k) for k in range(n)))
                if len(words) >= FLUSH:
                    yield out()
                    begun, cuts, words, counts, lengths, sizes = at, [0], [], [], [], []
            if begun < at:
                yield out()

    return run


def counted_features(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(row, id, n_words, n_features, feature array<binary>, times array<long>): each row's distinct features, where it lies."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_counter(n), f"row long, id {kind}, n_words long, n_features long, feature array<binary>, times array<long>")


def _flat(counted: DataFrame) -> DataFrame:
    return counted.select("row", F.explode(F.arrays_zip("feature", "times")).alias("f")).select("row", "f.feature", "f.times")


def dictionary(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(feature, n_rows, total, bucket): every distinct string once, its occurrences summed before the shuffle, hashed after it."""
    found = _flat(counted).groupBy("feature").agg(F.count("*").alias("n_rows"), F.sum("times").alias("total"))
    return found.withColumn("bucket", F.crc32("feature") % buckets)


def _by_bucket(words: DataFrame, name: str) -> DataFrame:
    return words.groupBy("bucket").agg(F.sum("total").alias(name))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the source dictionary's buckets: floor of 1000 times the log ratio of smoothed shares. At most `buckets` rows."""
    both = _by_bucket(source, "s").join(_by_bucket(target, "t"), "bucket", "left").fillna(0, ["t"])
    all_s, all_t = (x.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] for x in (source, target))
    up, down = [(F.col(x) + 1).cast("double") * F.lit(float(n + buckets)) for x, n in (("t", all_s), ("s", all_t))]
    return both.select("bucket", F.floor(1000 * F.log(up / down)).alias("gain"))


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(1000 * a Gumbel variate) drawn from the sha256 of `seed:key`; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank numbers the rows drawn from 1 and is null for others.

    Features are runs of 1 to n words. Their strings are counted over all of docs in one dictionary and hashed there,
    once each; buckets sum the dictionary's counts, and each string's gain goes back to the rows that hold it: frequent
    strings by a bounded broadcast, the others by an exchange. weight sums gain times occurrences, score adds noise by the
    id, and percent of the rows with least_words words are drawn by the highest scores (Gumbel top-k: sampling without
    replacement by weight), ties to the smaller id.

    A null or empty text has no features and weight 0. Rows are rows: repeated ids share their noise and are drawn each
    for itself, a null id draws as the empty string and loses ties. No target: gains follow docs alone. No rows: no rows.
    """
    counted = staged(counted_features(docs, id_col, text_col, n), "counted")
    words = staged(dictionary(counted, buckets), "dictionary")
    wanted = dictionary(counted_features(target.withColumn("__id", F.lit(0)), "__id", target_text, n), buckets)
    wanted = staged(_by_bucket(wanted, "total"), "target")
    gains = F.broadcast(bucket_gains(words, wanted, buckets))
    total = words.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    valued = words.join(gains, "bucket").select("feature", "n_rows", "gain")
    met = hot_join(_flat(counted), valued, "feature", "n_rows", total)
    weights = met.groupBy("row").agg(F.sum(F.col("gain") * F.col("times")).alias("weight"))
    rows = counted.select("row", "id", "n_words", "n_features").join(weights, "row", "left").fillna(0, ["weight"])
    rows = staged(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weighed")
    release(counted, words, wanted)
    fit = F.col("n_words") >= least_words
    count, able = rows.agg(F.count("*"), F.count_if(fit)).first()
    placed = numbered(rows, max(1, -(-count // ROWS_PER_RANGE)), F.desc(fit), F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    release(rows)
    drawn = F.col("number") <= percent * able // 100
    return placed.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.when(drawn, F.col("number")).alias("rank"))


def _crc32(bytes_: str) -> str:
    """DuckDB: the crc32 of a list of byte values, by the column `polynomial` of the joined row of CRC."""
    return f"xor(4294967295, list_reduce({bytes_}, lambda c, b: xor(c >> 8, polynomial[(xor(c & 255, b) + 1)::BIGINT]), 4294967295::BIGINT))"


#: DuckDB: table of the crc32 polynomial, from its rule.
CRC = """SELECT list(v ORDER BY i) AS polynomial FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(0, 256) r(i))"""


def crc32_sql(text: str) -> str:
    return _crc32(f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH crc AS MATERIALIZED ({CRC}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
f AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY 1, 2),
g AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY 1),
h AS MATERIALIZED (SELECT w, {crc32_sql('w')} % {BUCKETS} AS b FROM (SELECT w FROM f UNION SELECT w FROM g), crc),
s AS MATERIALIZED (SELECT b, sum(n)::DOUBLE AS s FROM f JOIN h USING (w) GROUP BY 1),
t AS MATERIALIZED (SELECT b, sum(n)::DOUBLE AS t FROM g JOIN h USING (w) GROUP BY 1),
gains AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b)),
x AS (SELECT r, sum(gain * n)::BIGINT AS weight FROM f JOIN h USING (w) JOIN gains USING (b) GROUP BY 1),
y AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN x USING (r)),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS p FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND p <= (SELECT count(*) FROM y WHERE n_features >= {LEAST_WORDS}) * {PERCENT} // 100 THEN p END AS rank FROM z"""
