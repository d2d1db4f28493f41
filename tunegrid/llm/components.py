"""Connected components by union-find inside partitions and pointer jumping between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.llm.common import hot_join, release, staged


class UnionFind:
    """Disjoint sets of integers whose root is always the smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.parent[high] = low
        return True


#: Nodes whose forest a task holds at once.
FOREST_NODES = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) for the nodes of the edges read, in as many forests as FOREST_NODES asks for."""
    sets = UnionFind()

    def out() -> pa.RecordBatch:
        nodes = list(sets.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(u, v)
        if len(sets.parent) > FOREST_NODES:
            yield out()
            sets = UnionFind()
    yield out()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges dealt by u, which is larger than v: one pointer for each u dealt here, and edges (own false) between the other nodes."""
    sets, own = UnionFind(), set()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(u, v)
            own.add(u)
    nodes = list(sets.parent)
    roots, here = [sets.find(x) for x in nodes], [x in own for x in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64()), pa.array(here, pa.bool_())], names=["u", "v", "own"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u long, v long) but the components' own smallest.

    component is the smallest node reachable. Partitions first shrink to spanning forests, written
    and read again by as many tasks as their rows ask for while that shrinks them; where one task
    of FOREST_NODES suffices all is done then. Else edges are dealt by their larger node, of which no forest has more than one, and each task
    unites what it holds, until every node has one pointer to a smaller one. Last, pointers jump
    to their targets' targets; a hub's many pointers meet its target by broadcast, where they
    lie. No edges: no rows.
    """
    forest = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_forest, "u long, v long")
    now = staged(forest, "forest")
    rows = now.count()
    while True:
        tasks = max(1, -(-2 * rows // FOREST_NODES))
        smaller = staged(now.coalesce(tasks).mapInArrow(_forest, "u long, v long"), "forest")
        release(now)
        if tasks == 1:
            return smaller.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now, before, rows = smaller, rows, smaller.count()
        if rows > 0.9 * before:
            break
    while True:
        dealt = staged(now.repartition("u").mapInArrow(_settle, "u long, v long, own boolean"), "pointers")
        release(now)
        now = dealt
        if now.where("not own").isEmpty():
            break
    total = now.count()
    while True:
        counts = now.groupBy("v").agg(F.count("*").alias("n"))
        targets = staged(counts.join(now.select(F.col("u").alias("v"), F.col("v").alias("up")), "v", "left"), "targets")
        if targets.where("up is not null").isEmpty():
            release(targets)
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        jumped = staged(hot_join(now.select("u", "v"), targets, "v", "n", total).select("u", F.coalesce("up", "v").alias("v")), "pointers")
        release(now, targets)
        now = jumped
