"""Conversation structure repair by a time-major dynamic programme over tensors of turns."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrid.llm.common import staged
from tunegrid.llm.resampling import CRC, crc32_sql

#: Costs of the edits; a truncated turn that stays adds the last one.
REROLE, DELETE, INSERT, STAYS_CUT = 3, 4, 3, 3
#: Rows and bytes of text that one piece of a conversation holds at most, and rows that one task sorts. A conversation
#: that exceeds a piece, or lies across tasks, is solved in pieces whose cost matrices are joined.
PIECE_ROWS, PIECE_BYTES, ROWS_PER_RANGE, BYTES_PER_RANGE = 20_000, 16_000_000, 100_000, 64_000_000
_SPACE = "\t\n\x0b\f\r "
_INF = 1 << 40
#: States: nothing yet, after system, after user, after assistant. What follows an inserted or reroled turn.
_NEXT = np.array([2, 2, 3, 2])
#: _KEEP[state, initial]: the state after a kept turn, -1 where its initial (0 other, 1 s, 2 u, 3 a) does not fit.
_KEEP = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
_OK, _CUT, _MUST_GO = 0, 1, 2
_FACTS = "blank long, duplicate long, truncated long, illegal long"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): turns damaged by crc32 of `conv_id:turn` modulo 20; nulls count as one space.

    0 drops the row (it stays here as gone, so that its conversation is known), 1 empties its text, 2 removes `.!?`,
    3 repeats it, 4 makes it a user's.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def _faults(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(_SPACE)), F.lit(1))
    return F.when(last == "", _MUST_GO).when(last.isin(".", "!", "?"), _OK).otherwise(_CUT)


_PIECE = "piece long, edge boolean, conv_id {kind}, turns array<long>, initials array<tinyint>, faults array<tinyint>, roles array<string>, texts array<string>, blank long, duplicate long"


def _cut_pieces(rows_max: int, bytes_max: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by conversation and turn to one row per conversation, or several where it exceeds a piece.

    edge marks those that may go on in another piece: a task's first and last conversation and those cut here.
    """

    def runs(rows: pa.Table) -> list[int]:
        keys = rows.column("conv_id").combine_chunks()
        a, b = keys.slice(1), keys.slice(0, max(0, len(keys) - 1))
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        return [0, *(np.nonzero(~same.to_numpy(zero_copy_only=False))[0] + 1).tolist(), len(keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        rest, cut, first = None, False, True

        def emit(rows: pa.Table, starts: list[int], edges: list[bool]) -> pa.RecordBatch:
            nonlocal number
            stays = ~rows.column("gone").to_numpy()
            bounds = np.concatenate([[0], np.cumsum(stays)])[starts].astype(np.int32)
            keys = rows.column("conv_id").combine_chunks().take(pa.array(starts[:-1]))
            kept = rows.filter(pa.array(stays)).combine_chunks()
            faults = kept.column("fault").to_numpy().astype(np.int8)
            roles, texts = (kept.column(c).to_pylist() for c in ("role", "text"))
            blanks, copies = [], []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                seen, n = set(), 0
                blanks.append(int((faults[lo:hi] == _MUST_GO).sum()))
                for k in range(lo, hi):
                    if (pair := (roles[k], texts[k])) in seen:
                        n += faults[k] != _MUST_GO
                        faults[k] = _MUST_GO
                    seen.add(pair)
                copies.append(int(n))
            offsets = pa.array(bounds, pa.int32())
            nested = lambda x: pa.ListArray.from_arrays(offsets, x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)
            columns = [pa.array(range(number, number + len(keys)), pa.int64()), pa.array(edges), keys, nested(kept.column("turn")), nested(kept.column("initial")), nested(pa.array(faults, pa.int8())), nested(kept.column("role")), nested(kept.column("text")), pa.array(blanks, pa.int64()), pa.array(copies, pa.int64())]
            number += len(keys)
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECE.split(", ")])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            starts = runs(rows)
            if len(starts) > 2:
                yield emit(rows.slice(0, starts[-2]), starts[:-1], [k == 0 and (first or cut) for k in range(len(starts) - 2)])
                rest, first, cut = rows.slice(starts[-2]).combine_chunks(), False, False
            else:
                rest = rows
            # What is left is one conversation so far; its pieces are as long as the rows and bytes allow.
            while rest.num_rows > rows_max or rest.num_rows > 1 and rest.nbytes > bytes_max:
                n = min(rows_max, max(1, rest.num_rows * bytes_max // max(1, rest.nbytes)), rest.num_rows)
                yield emit(rest.slice(0, n), [0, n], [True])
                rest, cut = rest.slice(n).combine_chunks(), True
                if not rest.num_rows:
                    break
            rest = rest if rest.num_rows else None
        if rest is not None:
            yield emit(rest, [0, rest.num_rows], [True])

    return run


def pieces_of(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text, gone) in order of turn, then role and text, gathered by conversation without a hot task."""
    base = turns.withColumns({"fault": _faults(F.col("text")), "initial": F.coalesce(F.element_at(F.create_map(F.lit("s"), F.lit(1), F.lit("u"), F.lit(2), F.lit("a"), F.lit(3)), F.left("role", F.lit(1))), F.lit(0))})
    base = base.withColumns({"fault": F.col("fault").cast("tinyint"), "initial": F.col("initial").cast("tinyint"), "turn": F.col("turn").cast("long"), "at": F.monotonically_increasing_id()})
    count, size = base.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # `at` lets a row that repeats any number of times be dealt to several tasks.
    order = ("conv_id", "turn", "role", "text", "at")
    dealt = base.repartitionByRange(max(1, -(-count // ROWS_PER_RANGE), -(-size // BYTES_PER_RANGE)), *order).sortWithinPartitions(*order)
    kind = turns.schema["conv_id"].dataType.simpleString()
    return dealt.drop("at").mapInArrow(_cut_pieces(PIECE_ROWS, PIECE_BYTES), _PIECE.format(kind=kind))


# --- The programme: cost to go by position and state, then the trace of the cheapest edits -------------------------


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs by state with turns inserted first where that is cheaper; in place."""
    u, a = costs[2].copy(), costs[3].copy()
    np.minimum(u, INSERT + a, out=costs[2])
    np.minimum(a, INSERT + u, out=costs[3])
    np.minimum(costs[0], INSERT + costs[2], out=costs[0])
    np.minimum(costs[1], INSERT + costs[2], out=costs[1])
    return costs


def costs_to_go(initials: np.ndarray, faults: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> np.ndarray:
    """[turns + 1, 4 states, conversations]: the least cost from each turn on, given the costs `after` the last turn."""
    steps, width = initials.shape
    costs = np.empty((steps + 1, 4, width), np.int64)
    costs[steps] = _closed(after.astype(np.int64).copy())
    for t in range(steps - 1, -1, -1):
        then, cut = costs[t + 1], STAYS_CUT * (faults[t] == _CUT)
        stays = np.where(faults[t] == _MUST_GO, _INF, cut)
        kept_in = _KEEP[:, initials[t]]
        kept = np.where(kept_in >= 0, np.take_along_axis(then, np.maximum(kept_in, 0), 0), _INF)
        now = np.minimum(DELETE + then, np.minimum(stays + kept, REROLE + stays + then[_NEXT]))
        costs[t] = np.where(t < lengths, np.minimum(_closed(now), _INF), then)
    return costs


def trace(costs: np.ndarray, initials: np.ndarray, faults: np.ndarray, lengths: np.ndarray, start: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edits, states, turns) as [steps, conversations], and the state at the end.

    Of the cheapest edits the ASCII-least is taken: D, I, K, R. states holds the state after each edit, turns the turn it
    is about; edits are 0 where a conversation does nothing. Only final ones may insert after their last turn.
    """
    steps, width = initials.shape
    state, every = start.copy(), np.arange(width)
    edits, states, turns = [], [], []
    for t in range(steps + 1):
        waits = (t < lengths) if t < steps else final.copy()
        for _ in range(3):
            if not waits.any():
                break
            cost, following = costs[t, state, every], _NEXT[state]
            inserts = waits & (INSERT + costs[t, following, every] == cost)
            edit, to = np.zeros(width, np.uint8), state.copy()
            if t < steps:
                then, cut = costs[t + 1], STAYS_CUT * (faults[t] == _CUT)
                deletes, fits = waits & (DELETE + then[state, every] == cost), _KEEP[state, initials[t]]
                keeps = waits & (faults[t] != _MUST_GO) & (fits >= 0) & (cut + then[np.maximum(fits, 0), every] == cost)
                edit[waits], to[waits] = ord("R"), following[waits]
                edit[keeps], to[keeps] = ord("K"), fits[keeps]
                edit[inserts], to[inserts] = ord("I"), following[inserts]
                edit[deletes], to[deletes] = ord("D"), state[deletes]
                waits = inserts & ~deletes
            else:
                edit[inserts], to[inserts] = ord("I"), following[inserts]
                waits = inserts
            state = to
            edits.append(edit)
            states.append(to.astype(np.int8))
            turns.append(np.full(width, t, np.int32))
    shape = (0, width)
    return np.array(edits, np.uint8).reshape(-1, width), np.array(states, np.int8).reshape(-1, width), np.array(turns, np.int32).reshape(-1, width) if turns else np.empty(shape, np.int32), state


def _tensors(initials: pa.ListArray, faults: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, lengths, initials [turns, conversations], faults): conversations of like length together, at most a quarter padded."""
    lengths = np.diff(initials.offsets.to_numpy())
    flat_i, flat_f, begin = initials.values.to_numpy(), faults.values.to_numpy(), initials.offsets.to_numpy()[:-1]
    buckets = defaultdict(list)
    for k, n in enumerate(lengths.tolist()):
        unit = 1 << max(0, n.bit_length() - 3)
        buckets[-(-n // unit) * unit].append(k)
    for size, places in sorted(buckets.items()):
        places = np.array(places)
        n = lengths[places]
        at = np.minimum(begin[places] + np.minimum(np.arange(size)[:, None], np.maximum(n - 1, 0)), max(0, len(flat_i) - 1))
        yield places, n, flat_i[at] if size else np.empty((0, len(places)), np.int8), flat_f[at] if size else np.empty((0, len(places)), np.int8)


def _gaps(turns: list[int]) -> tuple[int, int, int] | None:
    known = [t for t in turns if t is not None]
    return (min(known), max(known), len(set(known))) if known else None


_RESULT = f"conv_id {{kind}}, piece long, pieces long, gaps long, {_FACTS}, cost long, audit string, roles array<string>, texts array<string>"


def _repaired(batch: pa.RecordBatch, after: np.ndarray, start: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, list[str], list, list]:
    """(cost, audit, roles, texts) of each piece of the batch."""
    initials, faults = batch.column("initials"), batch.column("faults")
    roles, texts = batch.column("roles"), batch.column("texts")
    n = batch.num_rows
    cost, audits, out_roles, out_texts = np.zeros(n, np.int64), [""] * n, [None] * n, [None] * n
    for places, lengths, tensor, wrong in _tensors(initials, faults):
        costs = costs_to_go(tensor, wrong, lengths, after[:, places])
        cost[places] = costs[0, start[places], np.arange(len(places))]
        edits, states, turns, _ = trace(costs, tensor, wrong, lengths, start[places], final[places])
        for k, place in enumerate(places.tolist()):
            done = edits[:, k] > 0
            audits[place] = edits[done, k].tobytes().decode("ascii")
            stays = done & (edits[:, k] != ord("D"))
            own_roles, own_texts = roles[place].as_py(), texts[place].as_py()
            rows = list(zip(edits[stays, k].tolist(), states[stays, k].tolist(), turns[stays, k].tolist(), strict=True))
            out_roles[place] = [own_roles[t] if e == ord("K") else "user" if s == 2 else "assistant" for e, s, t in rows]
            out_texts[place] = ["" if e == ord("I") else own_texts[t] for e, s, t in rows]
    return cost, audits, out_roles, out_texts


_END = np.array([0, _INF, _INF, 0])


def _illegal(initials: np.ndarray) -> int:
    """Adjacent initials that are not su, ua or au."""
    a, b = initials[:-1].astype(int), initials[1:].astype(int)
    return int((~np.isin(a * 4 + b, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))).sum())


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        cost, audits, roles, texts = _repaired(batch, np.tile(_END[:, None], (1, n)), np.zeros(n, np.int64), np.ones(n, bool))
        found = [_gaps(x) for x in batch.column("turns").to_pylist()]
        initials, faults = batch.column("initials"), batch.column("faults")
        columns = [
            batch.column("conv_id"), batch.column("piece"), pa.array(np.ones(n, np.int64)), pa.array([g[1] - g[0] + 1 - g[2] if g else 0 for g in found], pa.int64()), batch.column("blank"), batch.column("duplicate"),
            pa.array([x.as_py().count(_CUT) for x in faults], pa.int64()), pa.array([_illegal(x.values.to_numpy()) for x in initials], pa.int64()), pa.array(cost), pa.array(audits), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])


# --- Conversations in several pieces ------------------------------------------------------------------------------


def _corrected(edges: DataFrame) -> DataFrame:
    """Edge pieces whose turns that repeat one of an earlier piece are marked as duplicates."""
    firsts = edges.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts", "faults")).alias("at", "x")).where(F.col("x.faults") != _MUST_GO)
    # One row of a piece for each pair of role and text at most: later ones are marked already.
    met = firsts.groupBy("conv_id", "x.roles", "x.texts").agg(F.collect_list(F.struct("piece", "at")).alias("places")).where(F.size("places") > 1)
    late = met.select(F.explode(F.filter("places", lambda p: p["piece"] > F.array_min("places")["piece"])).alias("p")).groupBy("p.piece").agg(F.collect_set("p.at").alias("late"))
    rows = edges.join(late, "piece", "left").withColumn("late", F.coalesce("late", F.array().cast("array<int>")))
    marked = F.transform("faults", lambda f, k: F.when(F.array_contains("late", k), F.lit(_MUST_GO).cast("tinyint")).otherwise(f))
    return rows.withColumns({"faults": marked, "duplicate": F.col("duplicate") + F.size("late")}).drop("late")


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece's costs by state at its start and state at its end, and what it tells its neighbours."""
    for batch in batches:
        n = batch.num_rows
        matrix = np.empty((n, 4, 4), np.int64)
        for places, lengths, tensor, wrong in _tensors(batch.column("initials"), batch.column("faults")):
            for end in range(4):
                after = np.full((4, len(places)), _INF, np.int64)
                after[end] = 0
                matrix[places, :, end] = costs_to_go(tensor, wrong, lengths, after)[0].T
        turns, initials = batch.column("turns").to_pylist(), [x.as_py() for x in batch.column("initials")]
        found = [_gaps(x) or (None, None, 0) for x in turns]
        columns = [
            batch.column("piece"), batch.column("conv_id"), pa.array(matrix.reshape(n, 16).tolist(), pa.list_(pa.int64())),
            *[pa.array([g[k] for g in found], pa.int64()) for k in range(3)], pa.array([x[0] if x else None for x in initials], pa.int64()), pa.array([x[-1] if x else None for x in initials], pa.int64()),
            pa.array([_illegal(np.array(x, np.int8)) for x in initials], pa.int64()), batch.column("blank"), batch.column("duplicate"), pa.array([x.as_py().count(_CUT) for x in batch.column("faults")], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["piece", "conv_id", "matrix", "least", "most", "n_turns", "first", "last", "illegal", "blank", "duplicate", "truncated"])


_JOINED = "piece long, after array<long>, last_piece boolean, pieces long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _join_pieces(rows: pd.DataFrame) -> pd.DataFrame:
    """For each piece of one conversation the costs after it, and the facts of the conversation. A row a piece, no turns."""
    rows = rows.sort_values("piece")
    after, v = [], _END.astype(np.int64)
    for matrix in reversed(rows["matrix"].tolist()):
        after.append(v)
        v = np.minimum((np.array(matrix, np.int64).reshape(4, 4) + v[None, :]).min(1), _INF)
    known = rows[rows["n_turns"] > 0]
    shared = int((known["most"].to_numpy()[:-1] == known["least"].to_numpy()[1:]).sum())
    gaps = int(known["most"].iloc[-1] - known["least"].iloc[0] + 1 - known["n_turns"].sum() + shared) if len(known) else 0
    full = rows[rows["first"].notna()]
    seams = sum(_illegal(np.array(p)) for p in zip(full["last"].astype(int)[:-1], full["first"].astype(int)[1:], strict=True))
    facts = {c: int(rows[c].sum()) for c in ("blank", "duplicate", "truncated")}
    last = np.arange(len(rows)) == len(rows) - 1
    return pd.DataFrame({"piece": rows["piece"].to_numpy(), "after": [x.tolist() for x in after[::-1]], "last_piece": last, "pieces": len(rows), "gaps": gaps, **facts, "illegal": int(rows["illegal"].sum()) + seams})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the cheapest edits leave a piece, for each state they may enter it in."""
    for batch in batches:
        n = batch.num_rows
        after, final = np.array(batch.column("after").to_pylist(), np.int64).reshape(n, 4).T, np.zeros(n, bool)
        ends = np.zeros((n, 4), np.int64)
        for places, lengths, tensor, wrong in _tensors(batch.column("initials"), batch.column("faults")):
            costs = costs_to_go(tensor, wrong, lengths, after[:, places])
            for s in range(4):
                ends[places, s] = trace(costs, tensor, wrong, lengths, np.full(len(places), s), final[places])[3]
        yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("conv_id"), pa.array(ends.tolist(), pa.list_(pa.int64()))], names=["piece", "conv_id", "ends"])


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("piece")
    start, state = [], 0
    for ends in rows["ends"]:
        start.append(state)
        state = int(ends[state])
    return pd.DataFrame({"piece": rows["piece"].to_numpy(), "start": start})


def _solve_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        after = np.array(batch.column("after").to_pylist(), np.int64).reshape(n, 4).T
        final = batch.column("last_piece").to_numpy(zero_copy_only=False)
        cost, audits, roles, texts = _repaired(batch, after, batch.column("start").to_numpy(), final)
        columns = [batch.column("conv_id"), batch.column("piece"), *[batch.column(c) for c in ("pieces", "gaps", "blank", "duplicate", "truncated", "illegal")], pa.array(cost), pa.array(audits), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])


def repair_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts): the cheapest repair of each conversation.

    turns has conv_id, turn, role, text and gone (a row that is not there but names its conversation). A conversation is
    one row, or `pieces` many whose piece numbers give their order: then audit, roles and texts are to be joined in that order,
    cost is that of the first piece, and the other facts are the whole conversation's in each.

    Rows are taken by turn (nulls first), then role and text; roles and texts must not be null. Edits and costs are stated at the
    top; the result's initials are `(s?(ua)+)?`. Conversations of like length form a tensor, turn by turn backwards for the
    costs and forwards for the edits. One that exceeds a piece or lies across tasks goes in pieces: each gives a
    matrix of costs between the states at its ends, a (min, +) product tells what follows each piece, and then each is traced
    by itself. A null conv_id is one conversation, repeated rows are duplicates of the first, no rows: none.
    """
    pieces = staged(pieces_of(turns), "pieces")
    kind = turns.schema["conv_id"].dataType.simpleString()
    result = _RESULT.format(kind=kind)
    whole = pieces.where("not edge").mapInArrow(_solve_whole, result)
    edges = staged(_corrected(pieces.where("edge")), "edges")
    light = edges.select("piece", "conv_id", "turns", "initials", "faults", "blank", "duplicate")
    told = light.mapInArrow(_matrix, f"piece long, conv_id {kind}, matrix array<long>, least long, most long, n_turns long, first long, last long, illegal long, blank long, duplicate long, truncated long")
    joined = staged(told.groupBy("conv_id").applyInPandas(_join_pieces, _JOINED), "joined")
    known = edges.drop("blank", "duplicate").join(joined, "piece")
    ends = known.select("piece", "conv_id", "initials", "faults", "after").mapInArrow(_ends, f"piece long, conv_id {kind}, ends array<long>")
    starts = ends.groupBy("conv_id").applyInPandas(_starts, "piece long, start long")
    return whole.unionByName(known.join(starts, "piece").mapInArrow(_solve_pieces, result))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and piece to a row per conversation; texts pass through the digest piece by piece."""
    facts, audits, digest, some, left = None, [], hashlib.sha256(), False, 0
    for batch in batches:
        for row in batch.to_pylist():
            if not left:
                facts, audits, digest, some, left = row, [], hashlib.sha256(), False, row["pieces"]
            audits.append(row["audit"])
            for role, text in zip(row["roles"], row["texts"], strict=True):
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
            left -= 1
            if not left:
                columns = [pa.array([facts["conv_id"]], batch.schema.field("conv_id").type), *[pa.array([facts[c]], pa.int64()) for c in _COUNTS], pa.array(["".join(audits)]), pa.array([digest.hexdigest()])]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])


def summaries(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conversation.

    The digest is of the repaired `role:text`, joined by newlines. A digest has one order, so the pieces of a long
    conversation stream through one task, which holds one of them and the audit at a time.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"]))
    whole = repaired.where("pieces = 1").select("conv_id", *_COUNTS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    long_ones = repaired.where("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(long_ones.mapInArrow(_streamed, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"))


def _oracle() -> str:
    """The same programme as a recursive query: a row a turn, the best (cost, audit, lines) of each state."""
    never = 1_000_000_000
    by = lambda x, cost, letter, line: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {x}.t || {line}}}"
    none = "[]::VARCHAR[]"
    kept = lambda x, initial: by(x, f"CASE WHEN f = 2 OR i <> '{initial}' THEN {never} WHEN f = 1 THEN {STAYS_CUT} ELSE 0 END", "K", "[role || ':' || text]")
    turned = lambda x, role: by(x, f"CASE f WHEN 2 THEN {never} WHEN 1 THEN {REROLE + STAYS_CUT} ELSE {REROLE} END", "R", f"['{role}:' || text]")
    gone = lambda x: by(x, DELETE, "D", none)
    more = lambda x, role: by(x, INSERT, "I", f"['{role}:']")
    before = [f"d.s{k}" for k in range(4)]
    step = [
        [gone(before[0])],
        [gone(before[1]), kept(before[0], "s")],
        [gone(before[2]), *[f(before[k], v) for k in (0, 1, 3) for f, v in ((kept, "u"), (turned, "user"))]],
        [gone(before[3]), kept(before[2], "a"), turned(before[2], "assistant")],
    ]
    own = [f"list_min([{', '.join(x)}])" for x in step]
    closed = lambda src: f"""SELECT conv_id, k, s0, s1, s2, list_min([s3, {more('s2', 'assistant')}]) AS s3 FROM (
        SELECT conv_id, k, s0, s1, list_min([s2, {', '.join(more(f's{j}', 'user') for j in (0, 1, 3))}]) AS s2, s3 FROM ({src}))"""  # noqa: E731
    first = lambda c: f"{{'c': {c}, 'a': '', 't': {none}}}"
    spaces = " || ".join(f"chr({ord(c)})" for c in _SPACE)
    return f"""WITH RECURSIVE crc AS MATERIALIZED ({CRC}),
raw AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
hurt AS MATERIALIZED (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM raw, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
ends AS (SELECT *, right(rtrim(text, {spaces}), 1) AS z, left(role, 1) AS i FROM hurt),
told AS MATERIALIZED (SELECT conv_id, turn, role, text, i, row_number() OVER w AS k, lag(i) OVER w AS before, z = '' AS blank, z
    FROM ends WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS MATERIALIZED (SELECT *, CASE WHEN blank OR copied THEN 2 WHEN z NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS f
    FROM (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS copied FROM told)),
d AS ({closed(f"SELECT conv_id, 0::BIGINT AS k, {first(0)} AS s0, {first(never)} AS s1, {first(never)} AS s2, {first(never)} AS s3 FROM (SELECT DISTINCT conv_id FROM raw)")}
    UNION ALL {closed(f"SELECT d.conv_id, j.k, {', '.join(f'{x} AS s{k}' for k, x in enumerate(own))} FROM d JOIN judged j ON j.conv_id IS NOT DISTINCT FROM d.conv_id AND j.k = d.k + 1")}),
best AS (SELECT conv_id, list_min([s0, s3]) AS b FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (copied) AS duplicate, count(*) FILTER (f = 1) AS truncated,
    count(*) FILTER (k > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT best.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.t, chr(10))) AS repaired_sha256 FROM best LEFT JOIN facts ON best.conv_id IS NOT DISTINCT FROM facts.conv_id"""


ORACLE = _oracle()
