"""Shared storage of intermediate tables and row handling for the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrid.sources.staging import numbered, release, shared_dir, staged

__all__ = ["by_unit", "hot_join", "numbered", "release", "shared_dir", "staged", "table"]

#: Keys that hot_join may broadcast, at most; a key with fewer rows than LEAST_HOT is never one.
HOT_KEYS, LEAST_HOT = 50_000, 500


def hot_join(many: DataFrame, one: DataFrame, key: str | list[str], rows_of: str, total: int) -> DataFrame:
    """Inner join of many with one, which has a row per key (a column or several) and, as rows_of, the number of the key's rows in many.

    Keys with more than total / HOT_KEYS rows, of which HOT_KEYS exist at most, are broadcast, so their rows stay
    where they are; the others are exchanged and put at most total / HOT_KEYS rows of a key into one task.
    """
    least = max(LEAST_HOT, -(-total // HOT_KEYS))
    hot, rest = one.where(F.col(rows_of) > least).drop(rows_of), one.where(F.col(rows_of) <= least).drop(rows_of)
    return many.join(F.broadcast(hot), key).unionByName(many.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(rest, key))


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(unit, kind, rows) of a stream sorted by its first two columns; a unit's rows may come in several parts."""
    for batch in batches:
        units, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.nonzero((np.diff(units) != 0) | (np.diff(kinds) != 0))[0] + 1), len(units)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                yield int(units[lo]), int(kinds[lo]), batch.slice(lo, hi - lo)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
