"""MinHash near-duplicate grouping with SuperMinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tunegrid.llm.common import by_unit, hot_join, release, staged
from tunegrid.llm.components import UnionFind, connected_components

WORDS = 5
SLOTS = 128
BANDS = 32
THRESHOLD = 75
#: Shingles of the documents that one task holds while others are compared with them.
UNIT_SHINGLES = 4_000_000
#: Partners that meet one copy of a hub's set when links with it are confirmed.
PARTNERS = 500
#: 64-bit words of the bitmap that bounds an intersection, and likely partners confirmed at once.
MAP_WORDS, TRIED = 64, 64
#: Shingles handled at once by a signature call: bounds the memory of a Python worker.
CHUNK = 1 << 17

_MUL = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    A-Z is lower-cased, words are runs of anything but ASCII white space. Fewer than five
    words make one shingle of the whole sequence; no words make an empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    span = min(WORDS, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        out = _mix(out * _MUL + hashed[k : len(words) - span + 1 + k])
    return np.unique(out)


def superminhash(items: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n x slots) of the sets whose elements are items, owner giving each one's set.

    Each element draws a permutation of the slots, one position per level, and offers the
    position's slot the value (level, random). All elements advance level by level; a set
    leaves once every slot has a value of the levels done, since later levels are higher.
    """
    sig = np.full(n * slots, _NONE, np.uint64)
    order, active = None, np.arange(len(items))
    for level in range(slots):
        if not len(active):
            break
        draw = _mix(items[active] + np.uint64((level + 1) * int(_MUL) & int(_NONE)))
        pick = level + (((draw >> np.uint64(40)) * np.uint64(slots - level)) >> np.uint64(24)).astype(np.int64)
        value = (np.uint64(level) << np.uint64(56)) | (_mix(draw ^ _A) >> np.uint64(8))
        if order is None:
            slot, first = pick, pick
        else:
            row = np.arange(len(active))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, level]
        np.minimum.at(sig, owner[active] * slots + slot, value)
        if level + 1 == slots:
            break
        done = (sig.reshape(n, slots).max(axis=1) >> np.uint64(56)) <= np.uint64(level)
        keep = ~done[owner[active]]
        active = active[keep]
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (len(active), 1))
            order[np.arange(len(active)), first[keep]] = 0
        else:
            order = order[keep]
    return sig.reshape(n, slots)


def signatures(text_sets: list[np.ndarray]) -> np.ndarray:
    """(sets x SLOTS) signatures of non-empty sets, a set larger than CHUNK in pieces."""
    sizes = np.array([len(s) for s in text_sets])
    if len(text_sets) == 1:
        pieces = [text_sets[0][k : k + CHUNK] for k in range(0, len(text_sets[0]), CHUNK)]
        return np.minimum.reduce([superminhash(p, np.zeros(len(p), np.int64), 1) for p in pieces])
    if sizes.sum() <= CHUNK:
        return superminhash(np.concatenate(text_sets), np.repeat(np.arange(len(text_sets)), sizes), len(text_sets))
    half = min(len(text_sets) - 1, max(1, int(np.searchsorted(np.cumsum(sizes), sizes.sum() / 2))))
    return np.concatenate([signatures(text_sets[:half]), signatures(text_sets[half:])])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets x BANDS) keys; a key also tells its band."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MUL, (len(sig), BANDS))
    for k in range(SLOTS // BANDS):
        keys = _mix(keys * _MUL + sig[:, k :: SLOTS // BANDS])
    return keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            sets = [shingle_hashes(t.as_py()) for t in batch.column(2)]
            full = [k for k, s in enumerate(sets) if len(s)]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys: list = [None] * len(sets)
            if full:
                for k, row in zip(full, band_keys(signatures([sets[k] for k in full])).view(np.int64), strict=True):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 64):
            batch = whole.slice(start, 64)
            sets = [shingle_hashes(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold; u may be a hub with any number of partners.

    A hub's set goes out once for each PARTNERS of its partners, so no task gets more of them.
    """
    spread = pairs.groupBy("u").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")).join(spread.drop("n"), "u")
    left = left.select("u", "su", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    parted = hot_join(pairs, spread, "u", "n", pairs.count())
    both = F.size(F.array_intersect("su", "sv"))
    return (
        parted.select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
        .join(right, "v")
        .join(left, ["u", "part"])
        .withColumn("common", both)
        .where(F.col("common") * 100 >= (F.size("su") + F.size("sv") - F.col("common")) * THRESHOLD)
        .select("u", "v")
    )


def _bitmap(items: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n x MAP_WORDS) bitmaps of the sets whose elements are items, each element setting the bit that its hash names."""
    bits = np.zeros((n, MAP_WORDS), np.uint64)
    np.bitwise_or.at(bits, (owner, (items >> np.uint64(6)).astype(np.int64) % MAP_WORDS), np.uint64(1) << (items & np.uint64(63)))
    return bits


class _Held:
    """A unit's documents, ready to be compared with any other of the unit's cluster."""

    def __init__(self, ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray]) -> None:
        self.ids, self.roots, self.sizes = ids, groups.copy(), np.array([len(s) for s in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        items = np.concatenate(sets)
        self.bits = _bitmap(items, np.repeat(np.arange(len(sets)), self.sizes), len(sets))
        self.known, self.flat = np.unique(items, return_inverse=True)
        keys = band_keys(signatures(sets)).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], order // BANDS
        self.mark = np.zeros(len(self.known), bool)
        self.shares = np.zeros(len(sets), bool)

    def join(self, low: int, high: int) -> None:
        """Group high has become part of group low."""
        self.roots[self.roots == high] = low

    def near(self, doc: int, root: int, own: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Members of smaller id and another group that share a band and may reach the threshold, the likeliest first.

        An element whose bit the other set lacks is not in it, which bounds the intersection from above.
        """
        keys = band_keys(sig[None])[0]
        for a, b in zip(np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right"), strict=True):
            self.shares[self.owner[a:b]] = True
        near = np.nonzero(self.shares)[0]
        self.shares[near] = False
        near = near[(self.ids[near] < doc) & (self.roots[near] != root)]
        bits, sizes = _bitmap(own, np.zeros(len(own), np.int64), 1), self.sizes[near]
        theirs = self.bits[near]
        most = np.minimum(sizes - np.bitwise_count(theirs & ~bits).sum(axis=1, dtype=np.int64), len(own) - np.bitwise_count(bits & ~theirs).sum(axis=1, dtype=np.int64))
        able = 100 * most >= THRESHOLD * (sizes + len(own) - most)
        return near[able][np.argsort(-most[able], kind="stable")]

    def partners(self, near: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Those of near whose whole sets reach the threshold."""
        at = np.searchsorted(self.known, own)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == own)]
        self.mark[at] = True
        sizes = self.sizes[near]
        cut = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        every = np.repeat(self.starts[near] - cut, sizes) + np.arange(sizes.sum())
        common = np.add.reduceat(self.mark[self.flat[every]], cut, dtype=np.int64)
        self.mark[at] = False
        return near[100 * common >= THRESHOLD * (sizes + len(own) - common)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, kind, id, group, shingles) sorted by unit and kind: members (0) are held, all documents of the cluster (1) stream past.

    Emits links between groups, a spanning forest of what each unit finds.
    """
    unit, waiting, held, joined = None, [], None, UnionFind()
    for unit_no, kind, part in by_unit(batches):
        if unit_no != unit:
            unit, waiting, held, joined = unit_no, [], None, UnionFind()
        ids, groups = part.column(2).to_numpy(), part.column(3).to_numpy()
        sets = [s.values.to_numpy().view(np.uint64) for s in part.column(4)]
        if kind == 0:
            waiting.append((ids, groups, [s.copy() for s in sets]))
            continue
        if held is None and waiting:
            held = _Held(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), [s for w in waiting for s in w[2]])
            waiting = []
        if held is None:
            continue
        u, v = [], []
        for k, sig in enumerate(signatures(sets)):
            root = joined.find(int(groups[k]))
            near = held.near(int(ids[k]), root, sets[k], sig)
            while len(near):
                some, near = near[:TRIED], near[TRIED:]
                for m in held.partners(some, sets[k]):
                    other = int(held.roots[m])
                    if joined.union(root, other):
                        u.append(int(ids[k]))
                        v.append(int(held.ids[m]))
                        held.join(min(root, other), max(root, other))
                        root = min(root, other)
                near = near[held.roots[near] != root]
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _links_between(bands: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links between documents that share a band but not yet a group.

    Bands that hold more than one group tie documents into clusters. Clusters are cut into
    units of UNIT_SHINGLES; a unit's task holds its documents' sets and every document sharing a
    band with one of them streams past, so that pairs are weighed where they meet, not emitted.
    """
    placed = bands.join(groups, bands.id == groups.node, "left").select("band", "id", F.coalesce("component", "id").alias("group"))
    placed = staged(placed, "placed")
    open_bands = placed.groupBy("band").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.min("id").alias("low"), F.count("*").alias("n")).where("a != b").select("band", "low", "n")
    rest = staged(hot_join(placed, open_bands, "band", "n", placed.count()), "open")
    release(placed)
    clusters = connected_components(rest.select(F.col("id").alias("u"), F.col("low").alias("v")))
    docs = rest.select("id", "group").distinct().join(sets.select("id", F.size("shingles").alias("n")), "id")
    docs = docs.join(clusters, docs.id == clusters.node, "left").select("id", "group", "n", F.coalesce("component", "id").alias("cluster"))
    docs = staged(docs, "clusters")
    parts = docs.groupBy("cluster").agg(F.ceil(F.sum("n") / UNIT_SHINGLES).alias("parts"), F.count("*").alias("docs"))
    unit = F.pmod(F.xxhash64("cluster", F.pmod(F.xxhash64("id"), F.col("parts"))), F.lit((1 << 31) - 1)).cast("int")
    units = staged(hot_join(docs, parts, "cluster", "docs", docs.count()).select("id", "group", unit.alias("unit")), "units")
    band_units = rest.join(units.select("id", "unit"), "id").select("band", "unit").distinct()
    visits = rest.select("band", "id").join(band_units, "band").select("id", "unit").distinct().join(units.select("id", "group"), "id")
    sent = units.select("id", "group", "unit", F.lit(0).alias("kind")).unionByName(visits.select("id", "group", "unit", F.lit(1).alias("kind")))
    sent = sent.join(sets, "id").select("unit", "kind", "id", "group", "shingles")
    return sent.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(_compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document.

    Equal shingle sets form a class with a number of its own, whatever ids its texts have; all
    that follows links classes. Classes that share a band are candidates: each with the smallest
    of the band, then, once the links found so have been grouped, every pair of a band whose
    groups differ. Every candidate pair is thus weighed on its full sets or already in one group,
    without emitting the pairs of a band. With 32 bands of 4 slots a pair at similarity 0.75
    escapes with probability 5e-6. Sets hold 64-bit hashes of shingles: in two texts of 10,000
    words some two different shingles share one with probability 1e-11.

    Null, empty or wordless texts have n_shingles 0 and stand alone, unless their id has another
    text too. A null id stands alone with a null component and is not kept. Rows repeating an id
    share its component, and an id with several texts links their classes, in whatever order they come.
    """
    from_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = from_docs.select("doc_id", "text_hash", "text").mapInArrow(_signatures, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>")
    rows = staged(rows, "signatures")
    known = rows.where("doc_id is not null and digest is not null")
    first = known.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"), F.count("*").alias("rows"))
    classes = staged(first.select("digest", F.monotonically_increasing_id().alias("id"), F.col("m.doc_id").alias("rep"), F.col("m.text_hash").alias("text_hash"), "rows"), "classes")
    total = rows.count()
    members = staged(hot_join(known.select("doc_id", "digest"), classes.select("digest", "id", "rows"), "digest", "rows", total).select("doc_id", "id"), "members")

    # One row of each class speaks for it: that of its least id, found by the text's hash where the id has others.
    speakers = known.select(F.col("doc_id").alias("rep"), "text_hash", "digest", "bands").join(classes.select("digest", "id", "rep", "text_hash"), ["digest", "rep", "text_hash"]).dropDuplicates(["id"])
    bands = staged(speakers.select("id", F.explode("bands").alias("band")), "bands")
    shared = bands.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low != high").select("band", "low", "n")
    open_ = staged(hot_join(bands, shared, "band", "n", bands.count()), "shared")
    release(bands)
    stars = staged(open_.where("id != low").select(F.col("low").alias("u"), F.col("id").alias("v")).distinct(), "first")
    needed = classes.join(open_.select("id").distinct(), "id", "left_semi").select("id", F.col("rep").alias("doc_id"), "text_hash")
    texts = from_docs.join(needed, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("id", "text")
    sets = staged(texts.mapInArrow(_sets, "id long, shingles array<long>"), "sets")
    links = staged(_verified(stars, sets), "links")
    release(stars)
    more = staged(_links_between(open_, connected_components(links), sets), "more")
    release(open_, sets)

    per_id = members.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low != high").select("doc_id", "low", "n")
    repeated = hot_join(members, per_id, "doc_id", "n", total).where("id != low").select(F.col("low").alias("u"), F.col("id").alias("v"))
    groups = connected_components(links.unionByName(more).unionByName(repeated))
    named = staged(classes.join(groups, classes.id == groups.node, "left").select("digest", "id", "rep", "rows", F.coalesce("component", "id").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    named = staged(hot_join(named, least, "component", "n", total).select("digest", "component_id", "rows"), "components")
    texts_of = hot_join(known.select("doc_id", "n_shingles", "digest"), named, "digest", "rows", total).select("doc_id", "n_shingles", "component_id")
    wordless = rows.where("doc_id is not null and digest is null").select("doc_id", "n_shingles")
    homes = texts_of.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    wordless = wordless.join(homes, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = rows.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return texts_of.unionByName(wordless).unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that near_duplicates does not keep; columns unchanged.

    Of rows repeating an id one stays, the least by text and then by its other columns' JSON;
    rows with a null id all stay.
    """
    found = staged(near_duplicates(docs, id_col, text_col).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "kept")
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone"))
    left = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    twice = found.where("kept and n > 1").select(F.col("doc_id").alias("_twice"))
    if twice.isEmpty():
        return left
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = left.join(twice, left[id_col] == twice["_twice"], "left_semi")
    one = again.groupBy(id_col).agg(F.min_by(every, F.struct(F.col(text_col), F.to_json(every))).alias("_row")).select("_row.*")
    return left.join(twice, left[id_col] == twice["_twice"], "left_anti").unionByName(one)
