"""Exact cosine near-duplicates of vectors by a metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.llm.common import by_unit, staged
from tunegrid.llm.components import UnionFind, connected_components

#: Bytes of a block's members: the matrix that one task holds. Vectors meet each block in reach, so larger blocks mean less traffic.
BLOCK_BYTES = 32 << 20
#: Pivots at least, where there are vectors for them, and at most. Larger cells are cut into rings, so the latter bounds only what is broadcast.
MIN_PIVOTS, MAX_PIVOTS = 16, 4096
#: Vectors of a cell at least: fewer are not worth a pivot.
LEAST_CELL = 64
#: Covers the rounding of distances, which near a pivot is the square root of that of a cosine.
_SLACK = 1e-6


def _unit(rows: list) -> np.ndarray:
    """Rows scaled to length one in double precision; scaling by the maximum first avoids overflow."""
    m = np.asarray(rows, np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, unit vectors) of a batch with columns id, n, dim, vec."""
    dims, vecs = batch.column(2).to_numpy(), batch.column(3)
    for dim in np.unique(dims):
        rows = np.nonzero(dims == dim)[0]
        flat = vecs.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield int(dim), rows, _unit(flat.reshape(len(rows), dim))


def _own_cell(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            cell, dist = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows)
            for dim, rows, unit in _by_dim(batch):
                cos = unit @ pivots[dim].T
                best = cos.argmax(axis=1)
                cell[rows], dist[rows] = best, np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(rows)), best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], names=["id", "n", "dim", "vec", "cell", "dist"])

    return run


def _deal(shared, rings: dict[tuple[int, int], list[tuple[int, int, float, float]]], reach: float) -> Callable:
    """To each vector's own block as a member, and to every block that may hold a partner as a visitor.

    rings: (dim, cell) to the rings (first unit, blocks, least and largest distance from the pivot) of the cell. A partner
    y of x in a ring of cell j has |d(x, p_j) - d(y, p_j)| <= d(x, y) <= reach, so x visits the rings whose distances
    come that near to its own; and, y being nearer to p_j than to x's own pivot, d(x, p_j) - d(x, p_own) <= 2 reach; the
    distance of x to the plane between the two pivots, a lower bound of d(x, y), tightens the latter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            ids, weights, own, from_own = (batch.column(k).to_numpy() for k in (0, 1, 4, 5))
            for dim, rows, unit in _by_dim(batch.select(["id", "n", "dim", "vec"])):
                table = pivots[dim]
                cos = unit @ table.T
                dist = np.sqrt(np.maximum(0, 2 - 2 * cos))
                home = own[rows]
                near = from_own[rows]
                between = np.sqrt(np.maximum(0, 2 - 2 * (table @ table.T)))[home]
                open_ = (dist - near[:, None] <= 2 * reach + _SLACK) & (dist**2 - near[:, None] ** 2 <= 2 * between * reach + _SLACK)
                payload = np.array([r.tobytes() for r in unit.astype(np.float64)], object)
                for j in range(len(table)):
                    for first, blocks, least, most in rings.get((dim, j), ()):
                        member = np.nonzero((home == j) & (near >= least) & (near <= most))[0]
                        sent = [(first + ids[rows[member]].astype(np.uint64) % np.uint64(blocks) if len(member) else np.empty(0), member, 0)]
                        visitor = np.nonzero(open_[:, j] & (dist[:, j] >= least - reach - _SLACK) & (dist[:, j] <= most + reach + _SLACK))[0]
                        sent += [(np.full(len(visitor), first + b), visitor, 1) for b in range(blocks)]
                        for unit_no, take, kind in sent:
                            if len(take):
                                yield pa.RecordBatch.from_arrays(
                                    [
                                        pa.array(unit_no.astype(np.int32)), pa.array(np.full(len(take), kind, np.int32)), pa.array(ids[rows[take]]),
                                        pa.array(weights[rows[take]]), pa.array(dist[take, j]), pa.array(payload[take], pa.binary()),
                                    ],
                                    names=["unit", "kind", "id", "n", "dist", "vec"],
                                )

    return run


def _join_unit(threshold: float, reach: float) -> Callable:
    """Rows come sorted by (unit, kind): a block's members are held in order of their distance from the pivot, its visitors stream past.

    A piece of visitors, sorted alike, meets only the members whose distances differ from theirs by reach at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, ids, far, matrix, links, roots, sets = None, [], None, None, None, None, None, UnionFind()

        def out(kind: int, a: list, b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

        def close() -> Iterator[pa.RecordBatch]:
            if links is not None:
                yield out(0, ids.tolist(), links.tolist())
                nodes = list(sets.parent)
                yield out(1, nodes, [sets.find(x) for x in nodes])

        for unit_no, kind, part in by_unit(batches):
            if unit_no != unit:
                yield from close()
                unit, held, links, sets = unit_no, [], None, UnionFind()
            if kind == 0:
                held.append(part)
                continue
            if not held:
                continue
            if links is None:
                ids = np.concatenate([p.column(2).to_numpy() for p in held])
                far = np.concatenate([p.column(4).to_numpy() for p in held])
                order = np.argsort(far, kind="stable")
                ids, far = ids[order], far[order]
                matrix = np.stack([np.frombuffer(v.as_py()) for p in held for v in p.column(5)])[order]
                links, roots = np.zeros(len(ids), np.int64), ids.copy()
            part = part.take(pa.array(np.argsort(part.column(4).to_numpy(), kind="stable")))
            for k in range(0, part.num_rows, 512):
                some = part.slice(k, 512)
                who, n, away = some.column(2).to_numpy(), some.column(3).to_numpy(), some.column(4).to_numpy()
                lo, hi = np.searchsorted(far, away[0] - reach - _SLACK, "left"), np.searchsorted(far, away[-1] + reach + _SLACK, "right")
                hit = np.stack([np.frombuffer(v.as_py()) for v in some.column(5)]) @ matrix[lo:hi].T >= threshold
                row, col = np.nonzero(hit)
                col += lo
                other = who[row] != ids[col]
                row, col = row[other], col[other]
                np.add.at(links, col, n[row])
                # A row unites the different sets it meets, as far as they are known: in a cluster that is mostly one.
                for r, cols in zip(who[np.unique(row)].tolist(), np.split(col, np.nonzero(np.diff(row))[0] + 1), strict=True) if len(row) else ():
                    known = roots[cols]
                    for c in {int(known[0])} if (known == known[0]).all() else np.unique(known).tolist():
                        sets.union(r, c)
                    roots[cols] = sets.find(r)
        yield from close()

    return run


def _rings(own: DataFrame, held: dict[int, int], width: float) -> tuple[dict[tuple[int, int], list[tuple[int, int, float, float]]], int]:
    """Rings of each (dim, cell) as (first unit, blocks, least and largest distance), and the number of units.

    Distances are counted in steps of width, at most 2 / width rows a cell; steps are joined into a ring while its
    members are at most held[dim], and a step of more needs several blocks.
    """
    steps: dict[tuple[int, int], list] = {}
    counted = own.groupBy("dim", "cell", F.floor(F.col("dist") / width).alias("step")).agg(F.count("*").alias("members"), F.min("dist").alias("least"), F.max("dist").alias("most"))
    for r in counted.collect():
        steps.setdefault((r.dim, r.cell), []).append((r.step, r.members, r.least, r.most))
    rings, unit_no = {}, 0
    for key, found in sorted(steps.items()):
        joined: list[list] = []
        for _, members, least, most in sorted(found):
            if joined and joined[-1][0] + members <= held[key[0]]:
                joined[-1][0] += members
                joined[-1][2] = most
            else:
                joined.append([members, least, most])
        rings[key] = []
        for members, least, most in joined:
            blocks = math.ceil(members / held[key[0]])
            rings[key].append((unit_no, blocks, least, most))
            unit_no += blocks
    return rings, unit_no


def embedding_near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, block: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of df.

    Rows with cosine >= threshold (double precision) are linked; n_links counts the other rows
    linked, component_id is the smallest id reachable. Equal vectors form one weighted class, so
    a hot vector is joined once. Pivots are the vectors of least hash, one per block's worth;
    cells join independently, a cell of more than `block` members (BLOCK_BYTES' worth by default) in rings of
    near-equal numbers by distance from the pivot, and a ring of more at one distance in several blocks. Each block
    emits a spanning forest, never its pairs. The threshold must be positive.

    Null, empty or zero vectors and those with null or non-finite components link with nothing,
    nor do vectors of different lengths. A null id gets 0 links, a null component and is not
    kept, and takes no part. Rows repeating an id count as rows of their own and share its component.
    """
    vec = F.col(vec_col)
    sound = vec.isNotNull() & F.exists(vec, lambda x: x != 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, vec).alias("vec")).withColumns(
        {"h1": F.when(F.col("vec").isNotNull(), F.xxhash64("vec")), "h2": F.when(F.col("vec").isNotNull(), F.xxhash64(F.lit(7), F.reverse("vec")))}
    )
    usable = rows.where("vec is not null and vec_id is not null")
    classes = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    # One id may stand for several classes when ids repeat: each class gets an id of its own.
    classes = staged(classes.select("h1", "h2", "rep", F.monotonically_increasing_id().alias("id"), "n", F.size("vec").alias("dim"), "vec"), "classes")
    pivots, held = {}, {}
    for dim, count in sorted(map(tuple, classes.groupBy("dim").count().collect())):
        held[dim] = block or max(LEAST_CELL, BLOCK_BYTES // (8 * dim))
        wanted = max(math.ceil(count / held[dim]), min(MIN_PIVOTS, count // LEAST_CELL), 1)
        chosen = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("h1"), "h2").limit(min(MAX_PIVOTS, wanted)).select("vec").collect()
        pivots[dim] = _unit([r[0] for r in chosen])
    kind = dict(classes.dtypes)["vec"]
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    own = staged(classes.select("id", "n", "dim", "vec").mapInArrow(_own_cell(shared), f"id long, n long, dim int, vec {kind}, cell int, dist double"), "cells")
    reach = math.sqrt(2 - 2 * threshold)
    rings, unit_no = _rings(own, held, max(reach, 0.01) / 8)
    dealt = own.mapInArrow(_deal(shared, rings, reach), "unit int, kind int, id long, n long, dist double, vec binary")
    joined = dealt.repartition(max(1, 2 * unit_no), "unit").sortWithinPartitions("unit", "kind").mapInArrow(_join_unit(threshold, reach), "kind int, a long, b long")
    joined = staged(joined, "joined")
    groups = connected_components(joined.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    links = joined.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("others"))
    named = classes.select("h1", "h2", "id", "rep", "n").join(links, "id").join(groups, F.col("id") == F.col("node"), "left")
    named = named.withColumn("root", F.coalesce("component", "id")).drop("component", "node")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = staged(named.join(least, "root").select("h1", "h2", "component_id", (F.col("others") + F.col("n") - 1).alias("n_links")), "named")
    found = rows.join(named, ["h1", "h2"], "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
    )
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
