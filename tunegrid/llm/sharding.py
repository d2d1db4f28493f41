"""Histogram sort into shards of near-equal bytes, with DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrid.llm.common import staged

#: Bits that one counting round adds to the known prefix of a splitter: 2**DIGIT candidate boundaries each.
DIGIT = 10
#: A splitter stops once it is this share of a shard's bytes away from its target.
TOLERANCE = 0.001
#: Rows that one task sorts, near enough.
ROWS_PER_RANGE = 100_000
_BITS = 128
_LOW = -(1 << 63)


def _prefix(bits: int) -> tuple[Column, Column]:
    """The leading bits of the key (k1, k2), as a pair of longs whose second is 0 until k1 is used up."""
    if bits <= 64:
        return (F.shiftrightunsigned("k1", 64 - bits) if bits else F.lit(0).cast("long")), F.lit(0).cast("long")
    return F.col("k1"), F.shiftrightunsigned("k2", 128 - bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _as_pair(prefix: int, bits: int) -> tuple[int, int]:
    return (_signed(prefix), 0) if bits <= 64 else (_signed(prefix >> (bits - 64)), _signed(prefix & ((1 << (bits - 64)) - 1)))


def histogram_splitters(rows: DataFrame, targets: list[tuple[str, float, float]]) -> list[tuple[int, int, int]]:
    """For each target (measure, amount, tolerance) a boundary: (key, rows below, bytes below).

    rows has k1, k2 (a 128-bit unsigned key) and size; measure is `rows` or `bytes`. Each round
    counts exactly what lies below 2**DIGIT candidates inside each open splitter's interval, in
    one pass whose result has at most 2**DIGIT rows a splitter, and narrows the interval to one
    candidate's range. A boundary within tolerance, or one single key wide, closes its splitter.
    """
    found: list[tuple[int, int, int] | None] = [None] * len(targets)
    open_ = {k: (0, 0, 0) for k in range(len(targets))}  # to (prefix, rows below, bytes below)
    bits = 0
    while open_:
        step = min(DIGIT, (64 if bits < 64 else _BITS) - bits)
        lead, digit = _prefix(bits), _prefix(bits + step)
        wanted = sorted({p for p, _, _ in open_.values()})
        some = rows
        if bits:
            pairs = [_as_pair(p, bits) for p in wanted]
            some = rows.where(lead[0].isin([a for a, _ in pairs]) if bits <= 64 else F.struct(*lead).isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in pairs]))
        counted: dict[int, list[tuple[int, int, int]]] = {}
        for r in some.groupBy(digit[0].alias("a"), digit[1].alias("b")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect():
            a, b = r.a % (1 << 64), r.b % (1 << 64)
            whole = a if bits + step <= 64 else (a << (bits + step - 64)) | b
            counted.setdefault(whole >> step, []).append((whole, r.n, r.bytes))
        bits += step
        for k, (prefix, n, size) in list(open_.items()):
            measure, amount, tolerance = targets[k]
            cells = sorted(counted.get(prefix, []))
            for whole, cell_n, cell_size in cells:
                below, above = (n, n + cell_n) if measure == "rows" else (size, size + cell_size)
                if above > amount:
                    break
                n, size = n + cell_n, size + cell_size
            else:
                whole, cell_n, cell_size, below, above = (cells[-1][0] + 1 if cells else prefix << step), 0, 0, amount, amount
            if amount - below <= tolerance or bits == _BITS and amount - below <= above - amount:
                found[k] = (whole << (_BITS - bits), n, size)
            elif above - amount <= tolerance or bits == _BITS:
                found[k] = ((whole + 1) << (_BITS - bits), n + cell_n, size + cell_size)
            else:
                open_[k] = (whole, n, size)
                continue
            del open_[k]
    return found


def _at_or_above(key: int) -> Column:
    if key >> _BITS:
        return F.lit(False)
    a, b = _signed((key >> 64) ^ (1 << 63)), _signed((key & ((1 << 64) - 1)) ^ (1 << 63))
    flip = F.lit(_LOW).cast("long")
    high, low = F.col("k1").bitwiseXOR(flip), F.col("k2").bitwiseXOR(flip)
    return (high > a) | ((high == a) & (low >= b))


def _shard_of(bounds: list[int]) -> Column:
    """The number of the shards' bounds at or below the row's key, by binary search in nested conditions."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_at_or_above(bounds[mid]), between(mid + 1, hi)).otherwise(between(lo, mid))

    return between(0, len(bounds))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of docs once, under the law of near-equal bytes.

    size is the text's UTF-8 bytes (null: none) plus 1. Rows are ordered by (crc32 of the text,
    hash of the id, place in the input), so equal texts are neighbours, in one shard unless a
    splitter falls among them; a group of any size can be split. Shards are key ranges whose
    bytes differ from the mean by at most twice TOLERANCE of a shard or one row. The driver holds the
    shards' splitters only. slot runs from 0 in each shard: rows are exchanged once by shard and key, into
    as many sorted partitions as they need, and a partition's first slot is the number of the shard's rows before it.

    A null text has size 1 and a null crc; null and repeated ids are rows like others; an empty
    table gives no rows. With fewer rows than shards some shards are empty.
    """
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    spread = F.xxhash64("doc_id").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    keyed = keyed.withColumns({"k1": F.shiftleft(F.coalesce("text_crc32", F.lit(0).cast("long")), 32).bitwiseOR(spread), "k2": F.monotonically_increasing_id()})
    keyed = staged(keyed, "sizes")
    count, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    near = TOLERANCE * total / shards
    found = histogram_splitters(keyed, [("bytes", total * k / shards, near) for k in range(1, shards)]) if count else []
    placed = keyed.withColumns({"shard": _shard_of(sorted(f[0] for f in found)), "high": F.col("k1").bitwiseXOR(F.lit(_LOW).cast("long"))})
    parts = max(1, math.ceil(count / rows_per_range))
    dealt = placed.repartitionByRange(parts, "shard", "high", "k2").sortWithinPartitions("shard", "high", "k2")
    # The number of a row: its partition's in the upper bits, its place there in the lower 33.
    dealt = staged(dealt.select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("number")), "dealt")
    pieces = dealt.groupBy("shard", F.shiftright("number", 33).alias("part")).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    # One row for each partition and shard in it: at most parts + shards.
    pieces = pieces.select("shard", "part", (before - F.col("first")).alias("offset"))
    numbered = dealt.withColumn("part", F.shiftright("number", 33)).join(F.broadcast(pieces), ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("number") + F.col("offset")).alias("slot"))
