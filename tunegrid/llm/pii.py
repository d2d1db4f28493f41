"""Personal data replaced by format-preserving Feistel pseudonyms, with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrid.llm.secrets import let

ROUNDS = 8
# Kinds, tried in this order at each place, and their patterns. Repeated groups are possessive, so the
# matcher iterates over long texts instead of recursing; an address begins where a run of its characters does.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9-]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}(?![0-9])){3,}+|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])",
}
#: The patterns as one, the phone's back reference counted from the first group.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = r"@[A-Za-z0-9]|[0-9][0-9.\- ()]{6}"
FIRST_DAY, DAYS = "1800-01-01", 27 * 5411  # 400 years
#: Symbols of an e-mail address that one digest moves in a round: four hexadecimal digits each.
_PER_DIGEST = 16
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def feistel(a: Column, b: Column, size_a: int, size_b: int | Column, key: str, kind: str, inverse: bool = False) -> Column:
    """(a, b) permuted over size_a x size_b by ROUNDS keyed rounds that add to each half in turn."""

    def keyed(i: Column, half: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    sign = -1 if inverse else 1
    sizes = [F.lit(size_a).cast("long"), (size_b if isinstance(size_b, Column) else F.lit(size_b)).cast("long")]

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + sign * F.pmod(keyed(i, s["b"]), sizes[0]), sizes[0])).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + sign * F.pmod(keyed(i, s["a"]), sizes[1]), sizes[1])).alias("b"),
        )

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def feistel_text(text: Column, key: str, kind: str, tweak: Column | None = None, inverse: bool = False) -> Column:
    """text (lower case) with its letters and digits permuted within its shape; other characters stay.

    The symbols are halved; a round adds keyed numbers drawn from one half to the other's symbols,
    modulo 26 for letters and 10 for digits, so texts of one shape never collide.
    """
    sign = -1 if inverse else 1

    def drawn(i: Column, half: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), F.lit("") if tweak is None else tweak, i.cast("string"), F.array_join(half["c"], ""))
        blocks = F.sequence(F.lit(0), F.floor(F.size(half) / _PER_DIGEST).cast("int"))
        return let(seed, lambda x: F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", x, b.cast("string")), 256)))

    def moved(half: Column, by: Column) -> Column:
        number = lambda k: F.conv(F.substring(F.get(by, F.floor(k / _PER_DIGEST).cast("int")), k % _PER_DIGEST * 4 + 1, F.lit(4)), 16, 10).cast("int")
        turned = lambda alphabet, c, k: F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + sign * number(k), F.lit(len(alphabet))) + 1, F.lit(1))
        return F.transform(half, lambda x, k: F.struct(x["at"].alias("at"), F.when(x["c"].rlike("[0-9]"), turned(_DIGITS, x["c"], k)).otherwise(turned(_LETTERS, x["c"], k)).alias("c")))

    def step(s: Column, i: Column) -> Column:
        left = F.struct(let(drawn(i, s["b"]), lambda by: moved(s["a"], by)).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), let(drawn(i, s["a"]), lambda by: moved(s["b"], by)).alias("b"))
        return F.when(i % 2 == 0, left).otherwise(right)

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def permuted(s: Column) -> Column:
        symbols, others = (F.filter(s, lambda x: x["c"].rlike("[a-z0-9]") == wanted) for wanted in (True, False))
        halves = let(symbols, lambda x: F.struct(F.slice(x, F.lit(1), F.floor(F.size(x) / 2).cast("int")).alias("a"), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.size(x)).alias("b")))
        done = let(halves, lambda h: F.aggregate(order, h, step))
        return let(done, lambda h: F.array_join(F.array_sort(F.concat(h["a"], h["b"], others))["c"], ""))

    return let(F.transform(F.split(text, ""), lambda c, k: F.struct(k.alias("at"), c.alias("c"))), permuted)


def _padded(x: Column, width: int | Column) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in order."""
    walked = F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + c.rlike("[0-9]").cast("int")).alias("k"),
        ),
    )
    return walked["out"]


def luhn_sum(digits: Column, skip: int) -> Column:
    """Sum of digits from the right, every second doubled; skip 1 leaves the place of a check digit."""
    at = F.sequence(F.lit(0), F.length(digits) - 1)
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + (i + skip) % 2)
    return F.aggregate(F.transform(at, lambda i: let(value(i), lambda v: F.when(v > 9, v - 9).otherwise(v))), F.lit(0), lambda a, x: a + x)


def _number(digits: Column, start: int, length: int) -> Column:
    return F.substring(digits, start, length).cast("long")


def pseudonym(found: Column, key: str, inverse: bool = False) -> Column:
    """(kind, value) for a match: value is null where validation fails and the match stays.

    Numbers and dates are permuted within their format: cards keep length, separators, first
    digit and a valid Luhn digit; phones keep the country code and valid area and exchange codes;
    addresses of four octets stay such; dates stay real days of the years 1800 to 2199; social
    security numbers stay assignable; e-mail addresses, in lower case, keep the shape of name and host and
    the last label, and equal hosts stay equal. All are permutations, so different values never
    get one pseudonym, and the inverse with the same key gives the value back. Equal digits
    give equal pseudonyms, whatever the separators.
    """
    digits = F.regexp_replace(found, "[^0-9]", "")

    def go(a: Column, b: Column, m: int, n: int | Column, kind: str) -> Column:
        return feistel(a, b, m, n, key, kind, inverse)

    def card(d: Column) -> Column:
        tail = F.length(d) - 9
        moved = go(_number(d, 2, 7), F.substring(d, F.lit(9), tail).cast("long"), 10**7, F.pow(F.lit(10.0), tail.cast("double")).cast("long"), "card")
        body = let(moved, lambda p: F.concat(F.substring(d, 1, 1), _padded(p["a"], 7), _padded(p["b"], tail)))
        return let(body, lambda x: F.concat(x, ((10 - luhn_sum(x, 1) % 10) % 10).cast("string")))

    def phone(d: Column) -> Column:
        local = F.substring(d, -10, 10)
        moved = go(_number(local, 1, 3) - 200, (_number(local, 4, 3) - 200) * 10_000 + _number(local, 7, 4), 800, 8_000_000, "phone")
        return let(moved, lambda p: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), (p["a"] + 200).cast("string"), (F.floor(p["b"] / 10_000) + 200).cast("string"), _padded(p["b"] % 10_000, 4)))

    def address(text: Column) -> Column:
        o = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
        return let(o, lambda v: let(go(v[0] * 256 + v[1], v[2] * 256 + v[3], 65_536, 65_536, "ip"), lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)])))

    def day(text: Column) -> Column:
        n = F.date_diff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")
        return let(n, lambda x: let(go(F.floor(x / 5411), x % 5411, 27, 5411, "date"), lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * 5411 + p["b"]).cast("int")), "yyyy-MM-dd")))

    def social(d: Column) -> Column:
        area = _number(d, 1, 3)
        moved = go(area - 1 - (area > 666).cast("int"), (_number(d, 4, 2) - 1) * 9999 + _number(d, 6, 4) - 1, 898, 99 * 9999, "ssn")
        return let(moved, lambda p: F.concat(_padded(p["a"] + 1 + (p["a"] >= 665).cast("int"), 3), _padded(F.floor(p["b"] / 9999) + 1, 2), _padded(p["b"] % 9999 + 1, 4)))

    def mail(text: Column) -> Column:
        parts = F.regexp_replace(text, r"\.[^.]*$", "")
        ending = F.regexp_extract(text, r"(\.[^.]*)$", 1)
        host = feistel_text(F.substring_index(parts, "@", -1), key, "host", None, inverse)
        # The name's permutation depends on the plain host, which the inverse knows once it has turned the host back.
        plain = host if inverse else F.substring_index(parts, "@", -1)
        return F.concat(feistel_text(F.substring_index(parts, "@", 1), key, "email", plain, inverse), F.lit("@"), host, ending)

    whole = lambda name: found.rlike(f"^(?:{PATTERNS[name]})$")
    octets = F.forall(F.split(found, r"\."), lambda x: x.cast("int") < 256)
    date = F.try_to_date(found, "yyyy-MM-dd")
    real_day = date.isNotNull() & date.between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date"))
    local = F.substring(digits, -10, 10)
    nanp = (F.length(digits) >= 10) & local.rlike("^[2-9][0-9]{2}[2-9]")
    assignable = digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    luhn = F.length(digits).between(13, 19) & digits.rlike("^[2-6]") & (luhn_sum(digits, 0) % 10 == 0)
    rest = lambda kind, ok, value: F.struct(F.when(ok, F.lit(kind)).alias("kind"), F.when(ok, value).alias("value"))
    return (
        F.when(found.contains("@"), rest("email", F.lit(True), mail(F.lower(found))))
        .when(whole("ip"), rest("ip", octets, address(found)))
        .when(whole("date"), rest("date", real_day, day(found)))
        .when(whole("ssn"), rest("ssn", assignable, _refill(found, social(digits))))
        .when(whole("phone"), rest("phone", nanp, _refill(found, phone(digits))))
        .otherwise(rest("card", luhn, _refill(found, card(digits))))
    )


def _cards(run: Column) -> Column:
    """The pieces (original, card) of a run of four-digit groups: the leftmost valid sixteen digits, and what lies between."""
    check = lambda groups: lambda k: let(F.array_join(F.slice(groups, k + 1, F.lit(4)), ""), lambda d: d.rlike("^[3-6]") & (luhn_sum(d, 0) % 10 == 0))
    valid = let(F.split(run, "[ -]"), lambda groups: F.filter(F.sequence(F.lit(0), F.size(groups) - 4), check(groups)))
    starts = F.aggregate(valid, F.array().cast("array<int>"), lambda a, k: F.when((F.size(a) == 0) | (k >= F.element_at(a, -1) + 4), F.concat(a, F.array(k))).otherwise(a))

    def cut(at: Column) -> Column:
        ends = lambda i: F.when(i < 0, 0).otherwise(F.get(at, i) * 5 + 19)
        piece = lambda text, card: F.struct(text.alias("original"), F.lit(card).alias("card"))
        pairs = F.transform(at, lambda k, i: F.array(piece(F.substring(run, ends(i - 1) + 1, k * 5 - ends(i - 1)), False), piece(F.substring(run, k * 5 + 1, F.lit(19)), True)))
        return F.concat(F.flatten(pairs), F.array(piece(F.substring(run, ends(F.size(at) - 1) + 1, F.length(run)), False)))

    return let(starts, cut)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_only: bool = False) -> DataFrame:
    """docs with text_col rewritten and a column pii: array of (kind, original, pseudonym) in order.

    Every row is handled alone, so equal values stay linked across documents by the key and
    nothing is shuffled. A card may stand among other groups of four digits, or before an expiry
    date or check number. Null texts stay null, texts without personal data stay as they are,
    with an empty pii; found_only leaves those rows out. Other columns pass through; one
    named pii is replaced.
    """
    text = F.col(text_col)
    rows = docs.where(text.rlike(HINT) & text.rlike(ANY)) if found_only else docs
    rows = rows.withColumn("__tg_m", F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    run = r"^[0-9]{4}(?:[ -][0-9]{4}){3,}+$"
    alone = lambda m: F.array(F.struct(m.alias("original"), F.lit(True).alias("card")))
    rows = rows.withColumn("__tg_q", F.transform("__tg_m", lambda m: F.when(m.rlike(run), _cards(m)).otherwise(alone(m))))
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"))
    named = lambda q: F.struct(q["original"].alias("original"), F.when(q["card"], pseudonym(q["original"], key)).otherwise(none).alias("p"))
    rows = rows.withColumn("__tg_p", F.transform("__tg_q", lambda qs: F.transform(qs, named)))
    rows = rows.withColumn("__tg_gaps", F.when(F.size("__tg_m") > 0, F.split(text, ANY, -1)))
    rewritten = lambda ps: F.array_join(F.transform(ps, lambda x: F.coalesce(x["p"]["value"], x["original"])), "")
    pieces = F.transform(F.arrays_zip("__tg_gaps", "__tg_p"), lambda x: F.concat(x["__tg_gaps"], F.coalesce(rewritten(x["__tg_p"]), F.lit(""))))
    pii = F.transform(F.filter(F.flatten("__tg_p"), lambda x: x["p"]["value"].isNotNull()), lambda x: F.struct(x["p"]["kind"].alias("kind"), x["original"].alias("original"), x["p"]["value"].alias("pseudonym")))
    empty = F.array().cast("array<struct<kind:string,original:string,pseudonym:string>>")
    out = rows.withColumns({text_col: F.when(F.size("__tg_m") > 0, F.array_join(pieces, "")).otherwise(text), "pii": F.coalesce(pii, empty)}).drop("__tg_m", "__tg_q", "__tg_p", "__tg_gaps")
    return out.where(F.size("pii") > 0) if found_only else out
