"""Expansion over stored pages: parse what is known, enqueue what its pages name, until nothing is new."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrid.sources.pages import parse_pages
from tunegrid.sources.staging import release, staged


@dataclass(frozen=True)
class Follow:
    """Pages (page_id, url, html) of one kind of entity, how they are parsed, and what each parsed row names: kinds with ids."""

    kind: str
    pages: DataFrame
    parser: str
    names: tuple[tuple[str, Column], ...]


def _named(follow: Follow, frontier: DataFrame) -> DataFrame:
    """(kind, id) named by the pages of the frontier's entities."""
    mine = frontier.where(F.col("kind") == follow.kind).select(F.col("id").alias("page_id"))
    rows = parse_pages(follow.pages.join(mine, "page_id", "left_semi"), follow.parser)
    found = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), id_.cast("long").alias("id")) for kind, id_ in follow.names]))
    return rows.select(found.alias("f")).select("f.*").where("id is not null").distinct()


def expand(seeds: DataFrame, follows: list[Follow], rounds: int = 1_000) -> DataFrame:
    """(kind, id, depth, status) of all entities reached from seeds (kind, id): each once, at its least depth.

    In a round the pages of the frontier are parsed, what they name is merged and the part that was not met before is the next
    frontier; each round is written, so a lost executor costs a round, and the work of a round is its frontier's. It ends when
    nothing is new, or after `rounds`. status is done for an entity whose pages were read, error for one that has
    none, and pending for those left by the last round. Null ids are nothing.
    """
    frontier = staged(seeds.where("id is not null").select("kind", F.col("id").cast("long").alias("id")).distinct().withColumn("depth", F.lit(0).cast("long")), "frontier")
    met, depth = [frontier], 0
    while depth < rounds and not frontier.isEmpty():
        depth += 1
        named = reduce(DataFrame.unionByName, [_named(f, frontier) for f in follows]).distinct()
        for before in met:
            named = named.join(before.select("kind", "id"), ["kind", "id"], "left_anti")
        frontier = staged(named.withColumn("depth", F.lit(depth).cast("long")), "frontier")
        # What was met is kept as one table, so that a round looks at it once.
        whole = staged(reduce(DataFrame.unionByName, met), "met") if len(met) > 1 else met[0]
        if len(met) > 1:
            release(*met)
        met = [whole, frontier]
    every = reduce(DataFrame.unionByName, met)
    there = reduce(DataFrame.unionByName, [f.pages.select(F.lit(f.kind).alias("kind"), F.col("page_id").cast("long").alias("id")) for f in follows]).distinct().withColumn("_page", F.lit(True))
    known = every.join(there, ["kind", "id"], "left")
    status = F.when(F.col("depth") >= depth, "pending").when(F.col("_page"), "done").otherwise("error")
    ended = F.when(F.col("_page"), "done").otherwise("error")
    return known.select("kind", "id", "depth", (ended if frontier.isEmpty() else status).alias("status"))
