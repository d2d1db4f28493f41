"""Secret scans with DataFrame functions: fixed patterns, and a randomness test battery for other tokens.

A candidate token is scored against the hypothesis that its characters are independent and
uniform over the alphabet its encoding implies. Four tests (chi-squared of the character
counts, runs above and below the alphabet's middle, lag-one serial correlation, excess of
common letters) give normal scores; the largest of them gives a p-value, corrected for their seven tails.

The null hypothesis of a report is a natural token. Decoys stand for it: the candidate itself, its
letters replaced by running letters of its own document, in their case, so that length, encoding, digits
and marks are equal. Per length class and encoding the candidates that look as random as the chosen
bound are reported; the decoys that do so estimate how many of these are natural, and the bound is the
widest that keeps their share at FALSE_RATE, short of scores by which the battery rejects randomness outright.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrid.llm.common import staged

# Fixed values of the contract: kinds in order, pattern, group whose length counts, least length.
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: What a text must have for a kind's pattern to be worth splitting it.
HINTS = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: A whole run of the alphabet's characters; `=` belongs to it only as padding at its end.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
CANDIDATE_HINT = r"[A-Za-z0-9+/_-]{20}"
METHOD = "random"
#: Tokens of fewer than 20 characters or MIN_BITS under their alphabet are too short for the battery and are not judged.
MIN_BITS = 80.0
#: Share of natural tokens among those reported, by the decoys' estimate.
FALSE_RATE = 0.05
#: Bins of -log10(p) in hundredths from which the battery rejects a token as not random: such a token is never reported.
REJECTED = 300
#: Characters of decoys made for a token: short ones need many for a fine estimate, long ones are told apart by one.
DECOY_CHARS = 600
# Natural text for documents that have no letters besides their tokens.
NATURAL = "thequietrivercarriesleavesunderthestonebridgewhilechildrenplayandoldmentalkofyearsgonebydieleutegehenamabendzumflussundhorendemwasserzulesgensmarchentlelongdeleauquandlesoirtombe"
#: Bins of -log10(p) in hundredths, and classes of length in doublings: the size of the counted table.
BINS, CLASSES = 1600, 24
_ENCODINGS = [("^[0-9]+$", "0123456789"), ("^[0-9a-f]+$", "0123456789abcdef"), ("^[0-9A-F]+$", "0123456789ABCDEF"), ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"), ("^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("^[A-Za-z0-9]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), ("^[A-Za-z0-9+/]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"), ("^[A-Za-z0-9_-]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"), ("", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_")]
#: Letters that make up most of a natural word, and a quarter of a random token.
_COMMON = "etaoinsrETAOINSR"
_NO_SPANS = "array<struct<start:bigint,end:bigint,token:string,size:int>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, however often and deep then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _add(a: Column, x: Column) -> Column:
    return a + x


def _prefix_sums(sizes: Column) -> Column:
    """Sums of the elements before each one, in time n^1.5: blocks of about sqrt(n) are summed once."""
    zero = F.lit(0).cast("long")

    def placed(s: Column) -> Column:
        n, step = F.size(s["sizes"]), s["step"]
        starts = F.transform(F.sequence(F.lit(0), n - 1, step), lambda b: F.aggregate(F.slice(s["sizes"], F.lit(1), b), zero, _add))
        return let(
            starts,
            lambda before: F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.get(before, F.floor(i / step).cast("int")) + F.aggregate(F.slice(s["sizes"], i - i % step + 1, i % step), zero, _add),
            ),
        )

    return let(F.struct(sizes.alias("sizes"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes))).cast("int")).alias("step")), placed)


def _with_matches(df: DataFrame, text: str, name: str, pattern: str, hint: str, group: int, least: int) -> DataFrame:
    """Adds column name: spans (start, end, token, length of the group) in code points of the matches whose group is long enough."""
    found = df.withColumn("__tg_m", F.when(F.col(text).rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    found = found.withColumns(
        {
            "__tg_g": F.when(F.size("__tg_m") > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col("__tg_m"),
            "__tg_gap": F.when(F.size("__tg_m") > 0, F.slice(F.split(text, pattern, -1), 1, F.size("__tg_m"))),
        }
    )
    lengths = F.zip_with("__tg_gap", "__tg_m", lambda a, b: (F.length(a) + F.length(b)).cast("long"))
    found = found.withColumn("__tg_len", lengths).withColumn("__tg_before", F.when(F.size("__tg_m") > 0, _prefix_sums(F.col("__tg_len"))))
    # Zipped, so that no lambda refers to a column that the optimizer could move into it.
    spans = F.transform(
        F.arrays_zip("__tg_m", "__tg_g", "__tg_gap", "__tg_len", "__tg_before"),
        lambda x: F.struct(
            (x["__tg_before"] + F.length(x["__tg_gap"])).alias("start"), (x["__tg_before"] + x["__tg_len"]).alias("end"), x["__tg_m"].alias("token"), F.length(x["__tg_g"]).alias("size")
        ),
    )
    spans = F.filter(spans, lambda x: x["size"] >= least)
    return found.withColumn(name, F.coalesce(F.when(F.size("__tg_m") > 0, spans), F.array().cast(_NO_SPANS))).drop("__tg_m", "__tg_g", "__tg_gap", "__tg_len", "__tg_before")


def _normal_tail(z: Column) -> Column:
    """-log10 of P(Z > z) for z >= 0, by the bound exp(-z*z/2) / (z + sqrt(z*z + 8/pi)) * sqrt(2/pi), up to 5 % above the true one."""
    return (z * z / 2 + F.log(z + F.sqrt(z * z + F.lit(2.546479089470325))) + F.lit(0.2257913526447274)) / F.lit(2.302585092994046)


def _common(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, _COMMON, ""))


def _battery(token: Column) -> Column:
    """(bits, neglog) of a token: its information under its alphabet, and -log10 of its p-value."""
    body = F.regexp_replace(token, "=+$", "")
    alphabet = F.lit(None).cast("string")
    for pattern, letters in reversed(_ENCODINGS):
        alphabet = F.lit(letters) if not pattern else F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def tested(s: Column) -> Column:
        n, k, cells, cell = s["n"], s["k"], s["cells"], s["cell"]
        held = lambda c: F.ceil((c + 1) * k / cells) - F.ceil(c * k / cells)
        chi = F.aggregate(F.array_distinct(cell), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(cell, lambda x: x == c)).cast("double"), F.lit(2.0)) / held(c)) * k / n - n
        inverse = F.aggregate(F.sequence(F.lit(0), cells.cast("int") - 1), F.lit(0.0), lambda a, c: a + k / held(c))
        spread_chi = 2 * (cells - 1) * (n - 1) / n + (inverse - cells * cells) / n
        # Wilson-Hilferty for the gamma distribution of this mean and variance: the plain score's tail is too heavy.
        flat = spread_chi / (9 * (cells - 1) * (cells - 1))
        z_chi = F.abs(F.cbrt(chi / (cells - 1)) - (1 - flat)) / F.sqrt(flat)
        high = F.transform(s["at"], lambda v: (v >= k / 2).cast("int"))
        up = F.aggregate(high, F.lit(0), _add).cast("double")
        runs = 1 + F.aggregate(F.zip_with(F.slice(high, 2, F.size(high) - 1), F.slice(high, 1, F.size(high) - 1), lambda a, b: (a != b).cast("int")), F.lit(0), _add).cast("double")
        mean = 1 + 2 * up * (n - up) / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(spread > 0, F.abs(runs - mean) / F.sqrt(spread)).otherwise(F.sqrt(n))
        middle = (k - 1) / 2
        serial = F.aggregate(F.zip_with(F.slice(s["at"], 2, F.size(s["at"]) - 1), F.slice(s["at"], 1, F.size(s["at"]) - 1), lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), _add)
        z_serial = F.abs(serial) / (F.sqrt(n - 1) * (k * k - 1) / 12)
        z_common = F.when(s["share"] > 0, F.greatest(F.lit(0.0), (s["common"] - n * s["share"]) / F.sqrt(n * s["share"] * (1 - s["share"])))).otherwise(0.0)
        neglog = F.greatest(F.lit(0.0), _normal_tail(F.greatest(z_chi, z_runs, z_serial, z_common)) - F.lit(0.8450980400142568))
        return F.struct((n * F.log2(k)).alias("bits"), neglog.alias("neglog"))

    def counted(s: Column) -> Column:
        n, k = F.size(s["at"]).cast("double"), F.length(s["alphabet"]).cast("double")
        # Cells of some three characters each keep the chi-squared statistic usable on short tokens; they may differ by one symbol.
        cells = F.least(k, F.greatest(F.lit(4.0), F.floor(n / 3)))
        common, share = _common(s["body"]).cast("double"), _common(s["alphabet"]) / k
        return F.struct(s["at"].alias("at"), n.alias("n"), k.alias("k"), common.alias("common"), share.alias("share"), cells.alias("cells"), F.transform(s["at"], lambda v: F.floor(v * cells / k)).alias("cell"))

    spelled = let(
        F.struct(body.alias("body"), alphabet.alias("alphabet")),
        lambda s: F.struct(s["body"].alias("body"), s["alphabet"].alias("alphabet"), F.transform(F.split(s["body"], ""), lambda c: (F.instr(s["alphabet"], c) - 1).cast("double")).alias("at")),
    )
    return let(let(spelled, counted), tested)


def _encoding(token: Column) -> Column:
    """The number of the token's encoding."""
    return F.coalesce(*[F.when(token.rlike(pattern), F.lit(k)) for k, (pattern, _) in enumerate(_ENCODINGS)])


def _decoys(token: Column, letters: Column) -> Column:
    """The token with its letters replaced by runs of letters, as often as DECOY_CHARS allows."""
    size = F.length(token)
    times = F.greatest(F.lit(1), F.ceil(F.lit(DECOY_CHARS) / size).cast("int"))

    def made(s: Column) -> Column:
        room = F.greatest(F.lit(1), F.length(letters) - s["size"] + 1)
        start = lambda k: F.pmod(F.xxhash64(token, k), room).cast("int") + 1
        run = lambda k: F.rpad(F.substring(letters, start(k), s["size"]), s["size"], letters)
        cased = lambda c, x: F.when(c.rlike("[A-Z]"), F.upper(x)).when(c.rlike("[a-z]"), x).otherwise(c)
        return F.transform(F.sequence(F.lit(1), s["times"]), lambda k: F.array_join(F.zip_with(s["spelt"], F.split(run(k), ""), cased), ""))

    return let(F.struct(size.alias("size"), times.alias("times"), F.split(token, "").alias("spelt")), made)


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with columns __tg_assign, __tg_access, __tg_hex (spans) and __tg_cand: tested tokens outside them, with their decoys' scores."""
    out = docs.withColumn("__tg_scan", F.coalesce(F.col(text_col), F.lit("")))
    for name, pattern, group, least in KINDS:
        out = _with_matches(out, "__tg_scan", f"__tg_{name}", pattern, HINTS[name], group, least)
    out = _with_matches(out, "__tg_scan", "__tg_cand", CANDIDATE, CANDIDATE_HINT, 0, 20)
    known = F.concat("__tg_assign", "__tg_access", "__tg_hex")
    out = out.withColumn("__tg_cand", F.filter("__tg_cand", lambda x: ~F.exists(known, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))))
    letters = F.concat(F.regexp_replace(F.lower("__tg_scan"), "[a-z0-9+/_=-]{20,}+|[^a-z]++", ""), F.lit(NATURAL))
    out = out.withColumn("__tg_letters", F.when(F.size("__tg_cand") > 0, letters))
    binned = lambda t: F.least(F.lit(BINS), F.floor(t["neglog"] * 100)).cast("int")

    def judged(x: Column) -> Column:
        tests = F.transform(F.concat(F.array(x["token"]), _decoys(x["token"], F.col("__tg_letters"))), _battery)
        kind = F.least(F.lit(CLASSES - 1), F.floor(F.log2((x["end"] - x["start"]).cast("double") / 5))).cast("int") * len(_ENCODINGS) + _encoding(x["token"])
        return let(
            tests,
            lambda t: F.struct(
                x["start"].alias("start"), x["end"].alias("end"), kind.alias("class"), F.get(t, F.lit(0))["bits"].alias("bits"), binned(F.get(t, F.lit(0))).alias("bin"),
                F.transform(F.slice(t, F.lit(2), F.size(t)), binned).alias("decoys"),
            ),
        )

    return out.withColumn("__tg_cand", F.when(F.size("__tg_cand") > 0, F.filter(F.transform("__tg_cand", judged), lambda x: x["bits"] >= MIN_BITS))).drop("__tg_scan", "__tg_letters")


def report_bins(counts: list[tuple[int, int, float, float]], rate: float = FALSE_RATE) -> dict[int, int]:
    """Per class over (class, bin, candidates, decoys in candidates' worth): the bin below which candidates are reported.

    The natural share of a class is what its candidates beyond the decoys' median bin say, one more counted for
    safety. The bound is the largest whose estimated natural tokens are at most rate of those reported.
    """
    bounds: dict[int, int] = {}
    for kind in {c for c, *_ in counts}:
        bins = sorted((b, n, d) for c, b, n, d in counts if c == kind)
        half, below = sum(d for *_, d in bins) / 2, 0.0
        for middle, _, d in bins:
            below += d
            if below >= half:
                break
        beyond = [sum(x) for x in zip(*((n, d) for b, n, d in bins if b >= middle), strict=True)]
        natural = min(1.0, (beyond[0] + 1) / beyond[1]) if beyond[1] else 1.0
        reported = false = 0.0
        for b, n, d in bins:
            reported, false = reported + n, false + natural * d
            if reported and false <= rate * reported:
                bounds[kind] = min(b + 1, REJECTED)
    return bounds


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all by default) with column `into`: array of (kind, start, end) by start and kind's place, in code points.

    Fixed kinds come first; METHOD adds tokens that overlap none of them. Texts are scanned once: spans, scores and kept
    columns are written to the shared folder, then counts by class and bin (at most CLASSES * encodings * (BINS + 1)) give
    the bounds. Null and empty texts have no spans; rows are otherwise
    independent, so repeated rows, null ids and other columns are passed through; a column
    already named `into` is replaced.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c != into]
    kinds = [f"__tg_{name}" for name, *_ in KINDS]
    scanned = staged(_scanned(docs, text_col).select(*[F.col(f"`{c}`") for c in columns], *kinds, "__tg_cand"), "scanned")
    tested = scanned.where(F.size("__tg_cand") > 0).select(F.explode("__tg_cand").alias("c"))
    scores = F.explode(F.concat(F.array(F.struct(F.col("c.bin").alias("bin"), F.lit(1.0).alias("n"), F.lit(0.0).alias("d"))), F.transform("c.decoys", lambda b: F.struct(b.alias("bin"), F.lit(0.0).alias("n"), (1 / F.size("c.decoys")).alias("d")))))
    counted = tested.select(F.col("c.class").alias("class"), scores.alias("s")).groupBy("class", "s.bin").agg(F.sum("s.n"), F.sum("s.d")).collect()
    bounds = report_bins([tuple(r) for r in counted])
    pick = lambda c: F.coalesce(*[F.when(c == k, F.lit(b)) for k, b in sorted(bounds.items())], F.lit(0))

    def placed(column: Column | str, place: int) -> Column:
        return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end")))

    spans = [placed(name, k) for k, name in enumerate(kinds)]
    reported = F.filter("__tg_cand", lambda x: x["bin"] < pick(x["class"]))
    spans.append(F.coalesce(placed(reported, len(KINDS)), F.array().cast("array<struct<start:bigint,place:int,end:bigint>>")))
    names = F.array(*[F.lit(n) for n, *_ in KINDS], F.lit(METHOD))
    secrets = F.transform(F.array_sort(F.concat(*spans)), lambda x: F.struct(F.get(names, x["place"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return scanned.withColumn(into, secrets).drop("__tg_cand", *kinds)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


#: Spans whose ends are looked through at once, and code points of a block of text that pieces are cut from.
GROUP, BLOCK = 64, 1_024


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs with each secret span of the text replaced by mark; overlapping spans become one mark. Other columns stay.

    The work grows with the spans and the text, not with their product.
    """
    found = find_secrets(docs, text_col, "__tg_secrets")
    text = F.col(text_col)
    none = F.lit(0).cast("long")
    ends = lambda spans, at, n: F.coalesce(F.array_max(F.transform(F.slice(spans, at, n), lambda x: x["end"])), none)

    def grouped(spans: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / GROUP).cast("int")), lambda g: ends(spans, g * GROUP + 1, F.lit(GROUP)))
        return let(groups, lambda found: F.struct(spans.alias("spans"), found.alias("groups"), F.transform(found, lambda _, g: F.when(g > 0, F.array_max(F.slice(found, F.lit(1), F.greatest(g, F.lit(1))))).otherwise(none)).alias("earlier")))

    def gaps(s: Column) -> Column:
        """From the farthest end before a span, of the whole groups before it and of those before it in its own, to its start."""
        before = lambda i: F.greatest(F.get(s["earlier"], F.floor(i / GROUP).cast("int")), ends(s["spans"], (i - i % GROUP + 1).cast("int"), (i % GROUP).cast("int")))
        inner = F.filter(F.transform(s["spans"], lambda x, i: F.struct(before(i).alias("low"), x["start"].alias("high"))), lambda g: g["low"] <= g["high"])
        return F.concat(inner, F.array(F.struct(F.array_max(s["groups"]).alias("low"), F.length(text).cast("long").alias("high"))))

    def piece(blocks: Column, g: Column) -> Column:
        """The text from code point low to high, from the blocks that it touches."""
        first, past = F.floor(g["low"] / BLOCK).cast("int"), F.floor(g["high"] / BLOCK).cast("int")
        cut = lambda k, lo, hi: F.coalesce(F.substring(F.get(blocks, k), (lo + 1).cast("int"), (hi - lo).cast("int")), F.lit(""))
        low, high = g["low"] % BLOCK, g["high"] % BLOCK
        between = F.array_join(F.slice(blocks, first + 2, F.greatest(past - first - 1, F.lit(0))), "")
        return F.when(first == past, cut(first, low, high)).otherwise(F.concat(cut(first, low, F.lit(BLOCK)), between, cut(past, F.lit(0), high)))

    # Each value is bound once: an expression within a function would be computed for every element.
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    clean = let(F.col("__tg_secrets"), lambda spans: let(grouped(spans), lambda s: let(F.struct(gaps(s).alias("gaps"), blocks.alias("blocks")), lambda b: F.array_join(F.transform(b["gaps"], lambda g: piece(b["blocks"], g)), mark))))
    return found.withColumn(text_col, F.when(F.size("__tg_secrets") > 0, clean).otherwise(text)).drop("__tg_secrets")
