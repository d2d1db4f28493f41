"""Removal of repeated strings by suffix arrays, sorted with a difference cover."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrid.llm.common import hot_join, release, staged

#: Bytes of a repeated string, and of the anchors inside it: a window of LENGTH bytes belongs to the anchor of least hash in it.
LENGTH, ANCHOR = 50, 24
#: Text bytes that Python cuts at once; pieces whose suffixes are sorted at once: beyond these, arrays no longer lie in the cache and each is mapped anew.
SLICE, SORTED_PIECES = 200_000, 4_000
#: Pieces that are dealt to one task, near enough; pieces of one anchor beyond which its windows are dealt one by one.
BUCKET_PIECES, HOT_PIECES = 20_000, 20_000
#: Anchors that a task holds before it sends them; buckets of anchors for each partition of the texts (of 128 MB, a bucket gets some 4 million anchors of 16 bytes).
HELD_ANCHORS, BUCKETS = 500_000, 4
#: Bits of the filter that tells shared anchors in the second reading (16 MB); with more than a quarter as many anchors it is left out.
FILTER_BITS = 1 << 27
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _C1
    return x ^ (x >> np.uint64(32))


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    padded = np.concatenate([buffer, np.zeros(16, np.uint8)])
    return np.ndarray((len(buffer) + 8,), "<u8", buffer=padded.data, strides=(1,))


def cut(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, windows, anchor hash, words): the pieces of the texts [starts, ends) of a buffer of under 64 MB.

    A piece is a run of windows with the same anchor: it has `windows` of them from `place` on and so windows + length - 1
    bytes. Each window is in one piece, and equal windows have equal anchors wherever they stand. Anchors have 8 to 24 bytes.
    """
    words, grams, width = _words(buffer), len(buffer) - anchor + 1, length - anchor + 1
    second, last = min(8, anchor - 8), anchor - 8
    hashed = _mix(words[:grams] * _C2 + _mix(words[second : second + grams] * _C3))
    hashed = _mix(hashed ^ words[last : last + grams] * _C2) if last > second else hashed
    low = np.uint64((1 << 26) - 1)
    least, span = (hashed & ~low) | np.arange(grams, dtype=np.uint64), 1
    spare = np.empty_like(least)
    while span < width:
        step = min(span, width - span)
        kept = len(least) - step
        np.minimum(least[:kept], least[step:], out=spare[:kept])
        least, spare, span = spare[:kept], least, span + step
    fits = ends - starts >= length
    inside = np.zeros(len(buffer) + 1, np.int8)
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - length + 1, -1)
    inside = np.cumsum(inside[: len(least)], dtype=np.int8) > 0
    begins = np.ones(len(least), bool)
    begins[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    begins[starts[fits]] = True
    place = np.nonzero(begins)[0]
    windows = np.diff(np.append(place, len(least)))
    place, windows = place[inside[place]], windows[inside[place]]
    return place, windows, hashed[(least[place] & low).astype(np.int64)].view(np.int64), words


def _digest(words: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit digest of the bytes [place, place + size) each."""
    found = _mix(size.astype(np.uint64) * _C1 + _C2)
    for k in range(0, int(size.max(initial=0)), 8):
        on = k < size
        found = np.where(on, _mix(found * _C2 ^ (words[np.minimum(place + k, place + size - 8)] * _C3 + np.uint64(k))), found)
    return found.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, rows, offsets in the row's text, buffer, starts, ends) of at most SLICE bytes; longer texts overlap so that no window is lost."""
    for batch in batches:
        texts = batch.column("text")
        rows, at, parts, size = [], [], [], 0

        def out(rows=rows, at=at, parts=parts, batch=batch):
            sizes = np.array([len(p) for p in parts])
            ends = np.cumsum(sizes)
            return batch, np.array(rows), np.array(at), np.frombuffer(b"".join(parts), np.uint8), ends - sizes, ends

        for k in range(len(texts)):
            data = texts[k].as_buffer() if texts[k].is_valid else None
            for begin in range(0, max(0, (data.size if data else 0) - length + 1), SLICE):
                part = data.slice(begin, min(SLICE + length - 1, data.size - begin)).to_pybytes()
                rows.append(k), at.append(begin), parts.append(part)
                size += len(part)
                if size >= SLICE:
                    yield out()
                    size = 0
                    rows.clear(), at.clear(), parts.clear()
        if rows:
            yield out()


def _anchors(length: int, anchor: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, anchors, ids): the smallest and the largest document of each anchor among HELD_ANCHORS, packed by bucket, as a row for each anchor costs more than its sorting."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashed, ids = np.concatenate([h for h, _ in held]), np.concatenate([i for _, i in held])
        # Anchors are least hashes, so only the lower bits deal them evenly.
        turned = hashed.view(np.uint64) << np.uint64(40) | hashed.view(np.uint64) >> np.uint64(24)
        order = np.argsort(turned)
        hashed, ids, turned = hashed[order], ids[order], turned[order]
        first = np.nonzero(np.append(True, hashed[1:] != hashed[:-1]))[0]
        least, most = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
        times = 1 + (least < most)
        places = np.cumsum(times)
        met, of = np.repeat(hashed[first], times), np.repeat(least, times)
        of[places - 1] = most
        bucket = np.repeat(turned[first] >> np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else np.zeros(len(first), np.uint64), times).astype(np.int32)
        cuts = [0, *(np.nonzero(np.diff(bucket))[0] + 1).tolist(), len(bucket)]
        rows = [[x[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)] for x in (met, of)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary())], names=["bucket", "anchors", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, rows, _, buffer, starts, ends in _slices(batches, length):
            place, _, hashed, _ = cut(buffer, starts, ends, length, anchor)
            held.append((hashed, batch.column("id").to_numpy()[rows[np.searchsorted(ends, place, side="right")]]))
            size += len(place)
            if size >= HELD_ANCHORS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor): the anchors of several documents, from packed rows sorted by bucket."""

    def solved(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        hashed, ids = (np.frombuffer(b"".join(x), np.int64) for x in zip(*held, strict=True))
        order = np.argsort(hashed)
        hashed, ids = hashed[order], ids[order]
        first = np.nonzero(np.append(True, hashed[1:] != hashed[:-1]))[0]
        return pa.RecordBatch.from_arrays([pa.array(hashed[first][np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)])], names=["anchor"])

    held, at = [], None
    for batch in batches:
        for bucket, anchors, ids in zip(batch.column("bucket").to_pylist(), batch.column("anchors").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if held and bucket != at:
                yield solved(held)
                held = []
            held.append((anchors, ids))
            at = bucket
    if held:
        yield solved(held)


def _within(hashed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    spot = hashed.view(np.uint64) % np.uint64(len(bits) * 8)
    return (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _pieces(length: int, anchor: int, shared, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pieces whose anchor passes the filter: where each stands (anchor, piece, id, print, at, windows); or, with texts,
    (anchor, piece, least, text) once for equal ones of a slice, with their smallest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        for batch, rows, begin, buffer, starts, ends in _slices(batches, length):
            place, windows, hashed, words = cut(buffer, starts, ends, length, anchor)
            if bits is not None:
                some = _within(hashed, bits)
                place, windows, hashed = place[some], windows[some], hashed[some]
            size = windows + length - 1
            piece, part = _digest(words, place, size), np.searchsorted(ends, place, side="right")
            ids = batch.column("id").to_numpy()[rows[part]]
            if texts:
                order = np.lexsort((ids, piece, hashed))
                order = order[np.append(True, (hashed[order][1:] != hashed[order][:-1]) | (piece[order][1:] != piece[order][:-1]))] if len(order) else order
                whole = buffer.tobytes()
                own = [whole[p : p + n] for p, n in zip(place[order].tolist(), size[order].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(hashed[order]), pa.array(piece[order]), pa.array(ids[order]), pa.array(own, pa.binary())], names=["anchor", "piece", "least", "text"])
            else:
                columns = [pa.array(hashed), pa.array(piece), pa.array(ids), pa.array(batch.column("print").to_numpy()[rows[part]]), pa.array(place - starts[part] + begin[part]), pa.array(windows.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "piece", "id", "print", "at", "windows"])

    return run


# --- Difference cover -----------------------------------------------------------------------------------------------


def _named(text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, names, distinct): the places sorted by their triples, and names from 1 in that order, equal for equal triples."""
    a, b, c = text[places], text[places + 1], text[places + 2]
    if text.max() < 1 << 21:
        key = (a << 42) | (b << 21) | c
        order = np.argsort(key)
        new = np.append(True, np.diff(key[order]) != 0)
    else:
        order = np.lexsort((c, b, a))
        new = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0))
    names = np.empty(len(places), np.int64)
    names[order] = np.cumsum(new)
    return order, names, int(new.sum())


def _pairs(text: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """Numbers in the order of the two symbols at each place, for several lists of places, below 2**31."""
    wide = [text[x] * (text.max() + 1) + text[x + 1] for x in places]
    if text.max() < 1 << 15:
        return wide
    _, names = np.unique(np.concatenate(wide), return_inverse=True)
    return np.split(names.astype(np.int64), np.cumsum([len(x) for x in places])[:-1])


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, told apart by `depth` symbols at least; symbols are from 1 up.

    The triples at the places that 3 does not divide are sorted and named. Names that leave places alike and do not
    yet stand for `depth` symbols are sorted in the same way, as a string of their own. The other
    suffixes follow from their first symbol and the rank of the next place, and are merged in by counting.
    """
    n = len(symbols)
    text = np.concatenate([np.asarray(symbols, np.int64), np.zeros(4, np.int64)])
    if n < 4:
        return np.array(sorted(range(n), key=lambda k: text[k : n + 1].tolist()), np.int64)
    # With one place over, the empty suffix joins the sample, so that the first half of the names ends below all others.
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    order, names, distinct = _named(text, sample)
    if distinct < len(sample) and depth > 3:
        order = suffix_array(names, -(-depth // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ranked = sample[order]
    ranked = ranked[ranked < n]
    rest = np.arange(0, n, 3)
    by_next = lambda x: (text[x] << 32) | rank[x + 1]
    rest = rest[np.argsort(by_next(rest))]
    ones, twos = ranked[ranked % 3 == 1], ranked[ranked % 3 == 2]
    pair_rest, pair_twos = _pairs(text, rest, twos)
    # Places that `depth` symbols do not tell apart have ranks in any order: among themselves the counts are made to rise.
    before = np.maximum.accumulate(np.searchsorted(by_next(ones), by_next(rest))) + np.maximum.accumulate(np.searchsorted((pair_twos << 32) | rank[twos + 2], (pair_rest << 32) | rank[rest + 2]))
    out, taken = np.empty(n, np.int64), np.zeros(n, bool)
    out[before + np.arange(len(rest))] = rest
    taken[before + np.arange(len(rest))] = True
    out[~taken] = ranked
    return out


def least_sources(texts: list[bytes], sources: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the smallest source of each of its strings of `length` bytes, over all the texts."""
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.int64) + 2
    symbols[begins + sizes] = 1
    places = suffix_array(symbols, length)
    owner = np.searchsorted(begins, places, side="right") - 1
    whole = places - begins[owner] + length <= sizes[owner]
    places, owner = places[whole], owner[whole]
    # Neighbours in the order are compared by their prefixes, eight bytes at a time.
    words = _words((symbols - 2).astype(np.uint8))
    same = np.ones(max(0, len(places) - 1), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        same &= words[places[1:] + k] == words[places[:-1] + k]
    first = np.nonzero(np.append(True, ~same))[0] if len(places) else np.empty(0, np.int64)
    least = np.repeat(np.minimum.reduceat(sources[owner], first), np.diff(np.append(first, len(places)))) if len(places) else np.empty(0, np.int64)
    found = np.empty(len(symbols), np.int64)
    found[places] = least
    return [found[b : b + n - length + 1] for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


_RUNS = "anchor long, piece long, first long, since array<int>, until array<int>, source array<long>"


def _runs(length: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (anchor, piece, least, text) sorted by anchor and piece, which may repeat, to runs of windows with the same smallest document, and the first of these."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        anchors, pieces, least = (rows.column(c).to_numpy() for c in ("anchor", "piece", "least"))
        first = np.nonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (pieces[1:] != pieces[:-1])))[0]
        texts = rows.column("text").take(pa.array(first)).to_pylist()
        since, until, source, earliest = [], [], [], []
        for own in least_sources(texts, np.minimum.reduceat(least, first), length):
            cuts = [0, *(np.nonzero(own[1:] != own[:-1])[0] + 1).tolist()]
            since.append(cuts), until.append([*cuts[1:], len(own)]), source.append(own[cuts].tolist()), earliest.append(int(own.min()))
        lists = [pa.array(since, pa.list_(pa.int32())), pa.array(until, pa.list_(pa.int32())), pa.array(source, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(anchors[first]), pa.array(pieces[first]), pa.array(earliest, pa.int64()), *lists], names=[c.split()[0] for c in _RUNS.split(", ")])

    def by_chunks(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole anchors, of which `starts` are the first rows and the end, with `chunk` rows at least until the last."""
        lo = 0
        while lo < starts[-1]:
            hi = int(starts[min(np.searchsorted(starts, lo + chunk), len(starts) - 1)])
            yield solved(rows.slice(lo, hi - lo))
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, chunk
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                rows = pa.Table.from_batches(held)
                anchors = rows.column("anchor").to_numpy()
                starts = np.append(0, np.nonzero(anchors[1:] != anchors[:-1])[0] + 1)
                yield from by_chunks(rows, starts)
                rows = rows.slice(int(starts[-1])).combine_chunks()
                held, size = rows.to_batches(), rows.num_rows
                most = max(chunk, 2 * size)
        if size:
            rows = pa.Table.from_batches(held)
            anchors = rows.column("anchor").to_numpy()
            yield from by_chunks(rows, np.concatenate([[0], np.nonzero(anchors[1:] != anchors[:-1])[0] + 1, [len(anchors)]]))

    return run


def _window_by_window(pieces: DataFrame, length: int) -> DataFrame:
    """The same for anchors with so many pieces that one task must not hold them: windows are summed up where they lie and dealt by themselves."""
    pieces = pieces.groupBy("anchor", "piece").agg(F.min("least").alias("least"), F.max("text").alias("text"))
    windows = pieces.select("anchor", "piece", "least", "text", F.explode(F.sequence(F.lit(0), F.length("text") - length)).alias("k"))
    windows = staged(windows.select("anchor", "piece", "least", "k", F.substring("text", F.col("k") + 1, F.lit(length)).alias("window")), "windows")
    sources = windows.groupBy("window").agg(F.min("least").alias("source"), F.count("*").alias("met"))
    told = hot_join(windows.drop("least"), sources, "window", "met", windows.count())
    runs = told.groupBy("anchor", "piece").agg(F.collect_list(F.struct("k", "source")).alias("r"))
    return runs.select("anchor", "piece", F.array_min(F.transform("r", lambda x: x["source"])).alias("first"), F.transform("r", lambda x: x["k"]).alias("since"), F.transform("r", lambda x: x["k"] + 1).alias("until"), F.transform("r", lambda x: x["source"]).alias("source"))


# --- Whole corpus ---------------------------------------------------------------------------------------------------


def _filter_of(anchors: DataFrame):
    """A broadcast bitmap of the anchors, None if there are too many: FILTER_BITS / 64 words at most reach the driver, whatever the corpus."""
    bits = FILTER_BITS
    if anchors.count() > bits // 4:
        return None
    spot = F.col("anchor").bitwiseAND(F.lit(bits - 1))  # bits are a power of two
    words = anchors.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return anchors.sparkSession.sparkContext.broadcast(found.view(np.uint8))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, n_removed, n_spans, kept, starts, ends): texts without the union of their spans."""
    for batch in batches:
        sizes, removed, spans, kept, lows, highs = [], [], [], [], [], []
        for text, low, high in zip(batch.column("text"), batch.column("low"), batch.column("high"), strict=True):
            data = text.as_py() or b""
            a = np.array(low.as_py() or [], np.int64)
            order = np.argsort(a, kind="stable")
            a, reach = a[order], np.maximum.accumulate(np.array(high.as_py() or [], np.int64)[order])
            new = np.append(True, a[1:] > reach[:-1]) if len(a) else np.empty(0, bool)
            starts, ends = a[new], reach[np.append(new[1:], True)] if len(a) else reach
            edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(data)]
            sizes.append(len(data)), removed.append(int((ends - starts).sum())), spans.append(len(starts))
            kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            lows.append(starts.tolist()), highs.append(ends.tolist())
        columns = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept, pa.binary()), pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "starts", "ends"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, starts, ends): each row's text without what earlier documents hold.

    A byte goes if a string of `length` bytes around it also starts in a document with a smaller id. Texts are taken as
    UTF-8 bytes and judged as given. kept is what remains, [starts, ends) are the removed runs.

    Texts are cut into pieces at anchors, so that equal strings lie in pieces of the same anchor. Anchors in one document
    only are left out; equal pieces count once, with their smallest document. The pieces of an anchor meet in
    one task, where a difference cover sorts their suffixes and neighbours of equal prefixes share their smallest document;
    an anchor with more than HOT_PIECES of them is dealt by its strings instead. No string is lost: hashes of anchors and the
    filter only bring together more than needed, and pieces are told apart by 128 bits, the anchor's and their own.

    Ids are long. A null text is empty, shorter texts stay whole. A null id is later than nothing and
    earlier than nothing: such rows stay whole. Rows with one id do not remove each other's strings. No rows: no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).cast("binary").alias("text"))
    named = source.where("id is not null and text is not null")
    buckets = 1 << (BUCKETS * named.rdd.getNumPartitions()).bit_length()
    anchors = named.select("id", "text").mapInArrow(_anchors(length, anchor, buckets), "bucket int, anchors binary, ids binary")
    shared = staged(anchors.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "anchor long"), "anchors")
    places, shown = "anchor long, piece long, id long, print long, at long, windows int", "anchor long, piece long, least long, text binary"
    bits = _filter_of(shared)
    found = named.mapInArrow(_pieces(length, anchor, bits, False), places)
    found = staged(found if bits else found.join(shared, "anchor", "left_semi"), "occurrences")
    release(shared)
    # An anchor with one piece needs no sorting: all its strings are that piece's, its smallest document is theirs.
    kinds = found.groupBy("anchor").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min("piece").alias("a"), F.max("piece").alias("b"))
    kinds = staged(kinds.where("n > 1").select("anchor", "least", "n", (F.col("a") == F.col("b")).alias("single")), "kinds")
    met = hot_join(found, kinds, "anchor", "n", found.count()).where("not single or least < id")
    met = staged(met.withColumn("piece", F.when(~F.col("single"), F.col("piece"))).drop("least"), "met")
    release(found)
    single = met.where("single").select("id", "print", F.array("at").alias("low"), F.array(F.col("at") + F.col("windows") + (length - 1)).alias("high"))
    mixed = met.where("not single").select("anchor", "piece", "id", "print", "at")
    groups = kinds.where("not single").select("anchor", "n")
    count, bits = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], _filter_of(groups.select("anchor"))
    pieces = named.select("id", "text").mapInArrow(_pieces(length, anchor, bits, True), shown)
    pieces = pieces if bits else pieces.join(groups.select("anchor"), "anchor", "left_semi")
    # At most 50,000 anchors are hot.
    hot = F.broadcast(groups.where(F.col("n") > max(HOT_PIECES, -(-count // 50_000))).select("anchor"))
    some_hot = not hot.isEmpty()
    dealt = pieces.join(hot, "anchor", "left_anti") if some_hot else pieces
    dealt = dealt.repartition(max(1, -(-count // BUCKET_PIECES)), "anchor").sortWithinPartitions("anchor", "piece")
    runs = dealt.mapInArrow(_runs(length, SORTED_PIECES), _RUNS)
    runs = runs.unionByName(_window_by_window(pieces.join(hot, "anchor", "left_semi"), length)) if some_hot else runs
    # Most pieces share their anchor only: where no string is from before the piece's last document, its rows are dropped before their runs are looked at.
    own = mixed.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    runs = staged(runs.join(own, ["anchor", "piece"]).where("first < last").drop("last"), "runs")
    release(kinds)
    parts = hot_join(mixed, runs, ["anchor", "piece"], "n", count).where("first < id")
    spans = F.filter(F.arrays_zip("since", "until", "source"), lambda r: r["source"] < F.col("id"))
    parts = parts.select("id", "print", "at", spans.alias("r")).where(F.size("r") > 0)
    low = F.transform("r", lambda r: F.col("at") + r["since"])
    high = F.transform("r", lambda r: F.col("at") + r["until"] + (length - 1))
    every = single.unionByName(parts.select("id", "print", low.alias("low"), high.alias("high")))
    per_text = every.groupBy("id", "print").agg(F.flatten(F.collect_list("low")).alias("low"), F.flatten(F.collect_list("high")).alias("high"))
    per_text = staged(per_text, "spans")
    release(met, runs)
    rows = source.join(per_text, ["id", "print"], "left").select(F.col("id").alias("doc_id"), "text", "low", "high")
    return rows.mapInArrow(_cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>")
