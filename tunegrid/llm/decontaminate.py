"""Benchmark decontamination by spaced seeds, with DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrid.llm.common import staged

#: Seeds: positions marked 1 must agree, the others are ignored. Items under SHORT words have seeds of their own, whose masks
#: leave fewer ways to miss them; items under EXACT words are matched whole. Of all ways to change the words that SHARE
#: allows, the masks find 95 % at 10 words, 98 % at 15 and more at any other length.
MASKS, SHORT_MASKS = ("11101101", "11010111", "100011111"), ("111011", "11010011")
EXACT, SHORT = 8, 13
#: Words of benchmark items hashed and broadcast at once; more items are handled in further blocks.
BLOCK_WORDS = 500_000
#: Words on either side of a hit that are compared. Items of up to this length are compared whole.
REACH = 128
#: Positions of a document or item handled at once: a long text is cut into chunks that overlap by REACH, so that a row stays small.
CHUNK = 256
#: An aligned overlap counts if this share of the item's words agrees, or of some WINDOW words in a row. From five
#: windows' length on, an item with that share agreeing has such a window, so long items need only be compared near hits.
SHARE, WINDOW = 0.8, 25


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed(words: str, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(F.col(words), at + k) for k, bit in enumerate(mask) if bit == "1"])


def _chunks(rows: DataFrame, words: str, *keep: str) -> DataFrame:
    """keep and, per chunk, its first position `base`, the words before that as `lead`, and `words` with REACH more on either side."""
    past = REACH + max(map(len, MASKS))  # the longest
    cut = lambda b: F.struct(b.alias("base"), F.least(b, F.lit(REACH)).alias("lead"), F.slice(F.col(words), F.greatest(b - REACH, F.lit(0)) + 1, F.least(b, F.lit(REACH)) + CHUNK + past).alias("words"))
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(CHUNK))
    return rows.select(*keep, F.explode(F.transform(starts, cut)).alias("c")).select(*keep, "c.base", "c.lead", "c.words")


def _positions() -> Column:
    """The chunk's own positions as places in its words."""
    return F.explode(F.sequence(F.col("lead"), F.least(F.col("lead") + CHUNK, F.size("words")) - 1)).alias("at")


def _steady(words: str, at: Column, size: int) -> Column:
    """The position goes on with a word repeated since the one before: of such a run only the first position is hashed."""
    return reduce(Column.__and__, [F.coalesce(F.get(F.col(words), at + k - 1) == F.get(F.col(words), at + k), F.lit(False)) for k in range(size)])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, item_words, start_word): each benchmark item found in each document.

    Every position of every document is hashed under the masks and met with the items' hashes;
    a hit fixes an alignment, and the words around it are compared along it. It counts
    if SHARE of the item's words agree, or of any WINDOW consecutive ones, so substituted words
    are tolerated. matched is the most words that agree within REACH of a hit, start_word the
    first such alignment's (negative if the item's head lies before the document).

    Items of under EXACT words are matched whole and exactly. Items without words match
    nothing, nor do null, empty and wordless texts. A null id is an id like others, of documents
    and of items. Ids may repeat: a document's rows are taken together, and an item's. Items of any length
    are cut into chunks, which are broadcast in blocks of about BLOCK_WORDS words, each block meeting all
    documents; a hit is verified where it is found, so only verified rows are shuffled.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text)).alias("item")).where(F.size("item") > 0)
    items = items.select(F.monotonically_increasing_id().alias("row"), "item_id", "item", F.size("item").alias("n"))
    parts = staged(_chunks(items, "item", "row", "item_id", "n").withColumn("part", F.xxhash64("row", "base")), "items")
    sizes = parts.groupBy(F.least("n", F.lit(SHORT)).alias("n")).agg(F.sum(F.size("words")).alias("words")).collect()
    masks = [*MASKS] * any(r.n == SHORT for r in sizes) + [*SHORT_MASKS] * any(EXACT <= r.n < SHORT for r in sizes) + ["1" * r.n for r in sorted(sizes) if r.n < EXACT]
    blocks = max(1, -(-sum(r.words for r in sizes) // BLOCK_WORDS))
    found = [_hits(docs, parts.where(F.pmod("part", F.lit(blocks)) == b) if blocks > 1 else parts, masks or [MASKS[0]], id_col, text_col) for b in range(blocks)]
    best = F.max(F.struct("matched", (-F.col("start_word")).alias("back"), "item_words"))
    hits = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return hits.select("doc_id", "item_id", "b.matched", "b.item_words", (-F.col("b.back")).alias("start_word"))


def _hits(docs: DataFrame, parts: DataFrame, masks: list[str], id_col: str, text_col: str) -> DataFrame:
    longest = max(map(len, masks))
    spots = parts.select("part", "base", "lead", "n", "words", _positions()).where(~_steady("words", F.col("at"), longest))
    meant = lambda m: F.col("n") >= SHORT if m in MASKS else F.col("n").between(EXACT, SHORT - 1) if m in SHORT_MASKS else F.col("n") == len(m)
    fits = lambda m: meant(m) & (F.col("at") + len(m) <= F.size("words"))
    keyed = F.array(*[F.when(fits(m), F.struct(_seed("words", F.col("at"), m).alias("seed"), F.lit(k).alias("mask"))) for k, m in enumerate(masks)])
    seeds = spots.select("part", F.col("at").alias("item_at"), F.explode(F.array_compact(keyed)).alias("s")).select("part", "item_at", "s.seed", "s.mask")
    held = parts.select("part", "item_id", "n", (F.col("base") - F.col("lead")).alias("item_shift"), F.col("words").alias("item"))

    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    spread = _chunks(rows, "all", "doc_id").select("doc_id", (F.col("base") - F.col("lead")).alias("shift"), "words", _positions()).where(~_steady("words", F.col("at"), longest))
    looked = F.array(*[F.when(F.col("at") + len(m) <= F.size("words"), _seed("words", F.col("at"), m)) for m in masks])
    spread = spread.select("doc_id", "shift", "words", "at", F.explode(looked).alias("seed"))
    hits = spread.join(F.broadcast(seeds), "seed").join(F.broadcast(held), "part")

    # Of a run of hits along one alignment the first that was hashed is verified: it sees REACH words on, and what lies past them agrees.
    same_at = lambda k: F.get("words", F.col("at") + k) == F.get("item", F.col("item_at") + k)
    follows = F.lit(False)
    for number, m in enumerate(masks):
        before = reduce(Column.__and__, [F.coalesce(same_at(k - 1), F.lit(False)) for k, bit in enumerate(m) if bit == "1"])
        follows = follows | ((F.col("mask") == number) & before)
    hits = hits.where(~follows | _steady("words", F.col("at") - 1, longest) | _steady("item", F.col("item_at") - 1, longest))

    # The words compared: REACH on either side of the hit, as far as document and item go.
    ahead = F.least("at", "item_at", F.lit(REACH))
    size = ahead + REACH + max(map(len, MASKS))
    ours, theirs = F.slice("words", F.col("at") - ahead + 1, size), F.slice("item", F.col("item_at") - ahead + 1, size)
    start = F.col("at") + F.col("shift") - F.col("item_at") - F.col("item_shift")
    hits = hits.select("doc_id", "item_id", F.col("n").alias("item_words"), start.alias("start_word"), F.transform(F.arrays_zip(ours.alias("a"), theirs.alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)).cast("int")).alias("same"))
    hits = hits.withColumn("matched", F.aggregate("same", F.lit(0), lambda a, x: a + x)).where("matched > 0")
    wide = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("same") - WINDOW + 1)), lambda k: F.aggregate(F.slice(F.col("same"), k, F.lit(WINDOW)), F.lit(0), lambda a, x: a + x) >= SHARE * WINDOW)
    whole = F.col("matched") == F.col("item_words")
    enough = whole | ((F.col("matched") >= SHARE * F.col("item_words")) & (F.col("item_words") >= EXACT)) | ((F.col("matched") >= SHARE * WINDOW) & wide)
    return hits.where(enough).select("doc_id", "item_id", "matched", "item_words", "start_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; rows with a null id are judged each for itself."""
    keyed = docs.withColumn("__tg_hash", F.when(F.col(id_col).isNull(), F.xxhash64(text_col)))
    key = F.struct(F.col(id_col).alias("id"), F.col("__tg_hash").alias("hash"))
    rows = keyed.select(key.alias("__tg_key"), F.col(text_col).alias("__tg_text"))
    gone = contaminated(rows, benchmark, "__tg_key", "__tg_text").select(F.col("doc_id.id").alias("_gone"), F.col("doc_id.hash").alias("_hash")).distinct()
    return keyed.join(gone, keyed[id_col].eqNullSafe(gone["_gone"]) & keyed["__tg_hash"].eqNullSafe(gone["_hash"]), "left_anti").drop("__tg_hash")
