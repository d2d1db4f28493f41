"""Exact top items by inner product: items in blocks of falling norm, exchanged in groups of blocks to the users that a bound still leaves open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunegrid.operators.ranking import by_score
from tunegrid.sources.staging import numbered, release, staged

#: Items of a block, users of a chunk and of a slice, bytes of the vectors in a group of blocks; a task holds a chunk, a group and the product of a slice with a block.
BLOCK, CHUNK, SLICE, GROUP_BYTES = 4_096, 32_768, 512, 32 << 20
#: Chunks that the users are dealt to at least, if each has THIN of them.
LEAST_CHUNKS, THIN = 32, 1_024
_FOUND = "id_user long, id_release long, score double"
#: A product is at most the norms' product times this, whatever its rounding errors.
_SLACK = 1 + 1e-12


def _norm(vector: str):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([v for c in column.chunks for v in c.to_pylist()], float) if column.null_count else np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(float, copy=False).reshape(len(column), -1)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first limit entries of each row by score, ties by id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - starts < limit
    return rows[kept], ids[kept], scores[kept]


def _entering(scores: np.ndarray, floor: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores that reach their row's floor; where more than 2 * limit do, by ties, only those above the rounded score at the limit and the first limit equal to it."""
    over = scores >= floor[:, None]
    over &= scores > -np.inf
    crowded = np.nonzero(over.sum(1) > 2 * limit)[0]
    if len(crowded):
        values = np.round(scores[crowded], 9)
        last = np.partition(values, values.shape[1] - limit, axis=1)[:, values.shape[1] - limit][:, None]
        tied = values == last
        over[crowded] &= (values > last) | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= limit))
    return np.nonzero(over)


def _unit(limit: int):
    """A chunk of users and a group of blocks to each user's best items there, those that cannot enter the list left out."""

    def run(users: pa.Table, items: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(users) and len(items):
            block, ids, vectors = items["block"].to_numpy(), items["id_release"].to_numpy(), _matrix(items["vector"])
            order = np.lexsort((ids, block))
            block, ids, vectors = block[order], ids[order], vectors[order]
            edges = [*np.nonzero(np.diff(block, prepend=block[0] - 1))[0], len(block)]
            norms = np.sqrt((vectors * vectors).sum(1))
            lowest = [ids[a] for a in edges[:-1]]
            by_id = np.argsort(ids)
            for lo in range(0, len(users), SLICE):
                some = users.slice(lo, SLICE)
                people, matrix, least, least_id = some["id_user"].to_numpy(), _matrix(some["vector"]), np.array(some["kth"].to_numpy(), float), np.array(some["kth_id"].to_numpy())
                length, history = np.sqrt((matrix * matrix).sum(1)), some["seen"].combine_chunks()
                seen_by = np.repeat(np.arange(len(some)), pc.fill_null(pc.list_value_length(history), 0).to_numpy(zero_copy_only=False))
                seen = history.flatten().to_numpy(zero_copy_only=False)
                at = by_id[np.minimum(np.searchsorted(ids, seen, sorter=by_id), len(ids) - 1)]
                seen_by, at = seen_by[ids[at] == seen], at[ids[at] == seen]
                found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                for a, b, lowest_id in zip(edges, edges[1:], lowest, strict=False):
                    # Norms fall from block to block, so a user whose bound is too low is done with the group; a tie at best needs a lower id.
                    bound = length * np.nanmax(norms[a:b]) * _SLACK if not np.isnan(norms[a:b]).all() else np.full(len(length), -np.inf)
                    open_ = np.nonzero((bound > -np.inf) & (bound + 1e-9 >= least) & ((bound > least) | (lowest_id < least_id)))[0]
                    if not len(open_):
                        continue
                    scores = matrix[open_] @ vectors[a:b].T
                    place = np.full(len(some), -1)
                    place[open_] = np.arange(len(open_))
                    here = (at >= a) & (at < b) & (place[seen_by] >= 0)
                    scores[place[seen_by[here]], at[here] - a] = -np.inf
                    scores[np.isnan(scores)] = -np.inf
                    floor = least[open_] - 1e-9
                    if b - a > limit and np.isneginf(floor).any():
                        floor = np.maximum(floor, np.partition(scores, b - a - limit, axis=1)[:, b - a - limit] - 1e-9)
                    row, col = _entering(scores, floor, limit)
                    if len(row):
                        found = _best(np.concatenate([found[0], open_[row]]), np.concatenate([found[1], ids[a + col]]), np.concatenate([found[2], np.round(scores[row, col], 9)]), limit)
                        full = np.bincount(found[0], minlength=len(some)) >= limit
                        last = np.searchsorted(found[0], np.arange(len(some)), side="right") - 1
                        score, tie = found[2][last[full]], found[1][last[full]]
                        least_id[full] = np.where(score > least[full], tie, np.where(score == least[full], np.minimum(tie, least_id[full]), least_id[full]))
                        least[full] = np.maximum(least[full], score)
                kept = found[2] >= least[found[0]]
                for part, values in zip(out, (people[found[0]], found[1], found[2]), strict=True):
                    part.append(values[kept])
        return pa.table({"id_user": np.concatenate(out[0]), "id_release": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    return run


def top_inner_products(users: DataFrame, items: DataFrame, interactions: DataFrame, limit: int = 9, block: int | None = None, chunk: int | None = None, visits: list | None = None) -> DataFrame:
    """(id_user, id_release, score, rank): each user's items of greatest inner product, rounded to 9 places, without those interacted with.

    users and items have an id and a vector. Items are numbered by falling norm, so that the product with an item
    of a later block is at most the user's norm times the block's greatest: once a user's last score is above that, or equal with
    an id below all of the block's, no later block can matter, so ties (vectors of zeros, say) cost no more than other scores. Blocks lie in groups of GROUP_BYTES, met in rounds, each with three times as many as all before; in a round the
    chunks of users still open and their groups are exchanged and meet in tasks of at most chunk x group, which look at the
    bound again block by block, and the results are merged by user. So a user is sent once for a group, an item once for a chunk, and nothing but
    results is written. visits, if given, gets the number of (user, group) meetings of each round. Ties go to the lower id.
    """
    block = block or BLOCK
    count, dim = items.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    wide = max(1, GROUP_BYTES // (block * max(1, dim) * 8))
    parts = max(1, -(-count // (50 * block)))
    placed = numbered(items.select("id_release", "vector", _norm("vector").alias("norm")), parts, F.desc("norm"), F.asc("id_release")).withColumn("block", F.floor((F.col("number") - 1) / block)).drop("number")
    placed = staged(placed.withColumn("group", F.floor(F.col("block") / wide)), "placed")
    groups = max(1, -(-count // (block * wide)))
    # A row for each group of blocks.
    greatest = placed.groupBy("group").agg(F.max("norm").alias("greatest"), F.min("id_release").alias("lowest")).select(F.col("group").alias("_g"), "greatest", "lowest")
    seen = interactions.groupBy("id_user").agg(F.collect_set("id_release").alias("seen"))
    people = users.count()
    chunks = max(-(-people // (chunk or CHUNK)), 1 if chunk else min(LEAST_CHUNKS, people // THIN))
    rows = users.select("id_user", "vector").join(seen, "id_user", "left").withColumn("chunk", F.pmod(F.xxhash64("id_user"), F.lit(max(1, chunks))))
    rows = staged(rows.withColumn("norm", _norm("vector")), "people")
    found, done, upto = None, 0, 1
    while done < groups:
        upto = min(groups, upto)
        none = {"kth": F.lit(float("-inf")), "kth_id": F.lit((1 << 63) - 1)}
        open_ = rows.withColumns(none)
        if found is not None:
            kth = found.where(F.col("rank") == limit).select("id_user", F.col("score").alias("kth"), F.col("id_release").alias("kth_id"))
            open_ = rows.join(kth, "id_user", "left").withColumns({k: F.coalesce(k, v) for k, v in none.items()})
        # Each open user's groups are those whose bound its last score does not exceed.
        near = F.broadcast(greatest.where((F.col("_g") >= done) & (F.col("_g") < upto)))
        bound = F.col("norm") * F.col("greatest") * _SLACK
        reached = (bound + 1e-9 >= F.col("kth")) & ((bound > F.col("kth")) | (F.col("lowest") < F.col("kth_id")))
        met = open_.join(near, reached).select("chunk", F.col("_g").alias("group"), "id_user", "vector", "seen", "kth", "kth_id")
        units = staged(met.groupBy(F.col("chunk").alias("_chunk"), F.col("group").alias("_group")).agg(F.count("*").alias("n")), "units")
        if visits is not None:
            visits.append(units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        if units.isEmpty():
            release(units)
            break
        there = F.broadcast(units).join(placed, F.col("_group") == F.col("group")).select("_chunk", "_group", "block", "id_release", "vector")
        new = met.groupBy("chunk", "group").cogroup(there.groupBy("_chunk", "_group")).applyInArrow(_unit(limit), _FOUND)
        merged = new if found is None else new.unionByName(found.drop("rank"))
        found, before = staged(by_score(merged, limit), "found"), found
        release(units, *([before] if before is not None else []))
        done, upto = upto, 4 * upto
    if found is None:
        return rows.select("id_user", F.lit(None).cast("long").alias("id_release"), F.lit(None).cast("double").alias("score"), F.row_number().over(Window.partitionBy("id_user").orderBy("chunk")).cast("long").alias("rank")).where("false")
    return found.select("id_user", "id_release", "score", "rank")
