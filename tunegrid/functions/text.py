"""Column functions for scraped text: white space, dates, durations, slugs, error classes, numbers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Month names in order, and category labels with their release type.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Two-digit years up to this count as 2000s, later ones as 1900s.
PIVOT = 30


def squeeze(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\n\r\f\u000b]+", " "))


def shorten(text: str, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(F.col(text), F.lit(size - 3)), F.lit("..."))).otherwise(F.col(text))


def error_class(text: str) -> Column:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return (
        F.when(low == "", "unknown").when(low.contains("404"), "not_found").when(low.contains("429") | low.contains("too many"), "rate_limited")
        .when(low.contains("timeout"), "timeout").when(low.contains("incomplet"), "incomplete_read")
        .when(low.contains("connection") | low.contains("reset") | low.contains("broken"), "connection").otherwise("other")
    )


def duration_seconds(text: str | Column) -> Column:
    """[h:]mm:ss to seconds; null if minutes or seconds reach 60 or a part is no number."""
    p = F.split(text, ":")
    part = lambda k: F.try_element_at(p, F.lit(k)).try_cast("bigint")
    minutes, seconds = part(-2), part(-1)
    sane = (minutes < 60) & (seconds < 60)
    return F.when((F.size(p) == 3) & sane, part(1) * 3600 + minutes * 60 + seconds).when((F.size(p) == 2) & sane, minutes * 60 + seconds)


def full_year(two: Column) -> Column:
    return two + F.when(two > PIVOT, 1900).otherwise(2000)


def spoken_date(text: str | Column) -> Column:
    """'May 3rd 24' to a date, null if it is none."""
    col = F.col(text) if isinstance(text, str) else text
    pattern = r"^\s*([A-Za-z]+)\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{2})\s*$"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(col, pattern, 1)))
    day, two = F.regexp_extract(col, pattern, 2).try_cast("int"), F.regexp_extract(col, pattern, 3).try_cast("int")
    return F.try_to_date(F.concat_ws("-", full_year(two).cast("string"), month.cast("string"), day.cast("string")), "y-M-d")


def numeric_date(text: str | Column) -> Column:
    """'mm-dd-yy[ hh:mm am]' to a timestamp, null if it is none."""
    col = F.upper(F.col(text) if isinstance(text, str) else text)
    two = F.regexp_extract(col, r"^[0-9]{1,2}-[0-9]{1,2}-([0-9]{2})", 1).try_cast("int")
    whole = F.concat(F.regexp_extract(col, r"^([0-9]{1,2}-[0-9]{1,2}-)", 1), full_year(two).cast("string"), F.regexp_extract(col, r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}(.*)$", 1))
    return F.coalesce(F.try_to_timestamp(whole, F.lit("M-d-yyyy hh:mm a")), F.try_to_timestamp(whole, F.lit("M-d-yyyy")))


def votes(text: str | Column) -> Column:
    return F.regexp_extract(F.regexp_replace(text, "[,.]", ""), "([0-9]+)", 1).try_cast("bigint")


def rating(text: str | Column) -> Column:
    return F.regexp_extract(F.regexp_replace(text, ",", "."), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def plain_path(url: str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-z]+://[^/]*", "")
    return F.regexp_replace(bare, "/+$", "")


def slug(text: str) -> Column:
    """Lower case, other characters to single hyphens; for ASCII text. ascii_slug folds accents first."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.pandas_udf(StringType())
def ascii_fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without what is not ASCII; no built-in function decomposes."""
    for s in parts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ascii_slug(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def byte_size(n: Column) -> Column:
    """Bytes in the largest unit that keeps the number at 1 or more, one decimal."""
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", n / 1024**k)).otherwise(out)
    return out


def thousands(n: Column) -> Column:
    """Thousands separated by dots."""
    return F.translate(F.format_number(n, 0), ",", ".")


def durations(lines: DataFrame) -> DataFrame:
    """Durations spelt from the line items, and parsed back."""
    hours = F.when(F.col("l_linenumber") % 2 == 0, F.concat((F.col("l_linenumber") % 3).cast("string"), F.lit(":"))).otherwise("")
    raw = F.concat(hours, (F.col("l_partkey") % 70).cast("string"), F.lit(":"), F.lpad((F.col("l_quantity").cast("long") + 12).cast("string"), 2, "0"))
    return lines.select("l_orderkey", "l_linenumber", raw.alias("raw")).withColumn("seconds", duration_seconds("raw"))


def spoken_dates(orders: DataFrame) -> DataFrame:
    d = F.day("o_orderdate")
    ending = F.when(d.isin(1, 21, 31), "st").when(d.isin(2, 22), "nd").when(d.isin(3, 23), "rd").otherwise("th")
    raw = F.concat(F.date_format("o_orderdate", "MMMM "), d.cast("string"), ending, F.date_format("o_orderdate", " yy"))
    return orders.select("o_orderkey", raw.alias("raw")).withColumn("parsed", spoken_date("raw"))
