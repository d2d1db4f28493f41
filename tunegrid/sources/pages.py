"""Page parsers: one page of HTML to many rows, over token streams.

A page becomes a flat list of tokens (opening tag with attributes, closing tag, text), tolerant
of tag soup. Each parser is one pass over it with a little state. `parse_pages` runs a parser
over a frame of pages in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

# Heading labels of a discography and the release type each stands for.
TYPE_OF = {
    "lp": "LP", "lps": "LP", "full-length": "LP", "full length": "LP", "albums": "LP", "album": "LP", "live": "LP", "live albums": "LP", "split": "LP", "splits": "LP", "split albums": "LP", "demos": "LP", "demo": "LP",
    "eps": "EP", "ep": "EP", "mini albums": "EP",
    "singles": "Single", "single": "Single",
    "compilation": "Compilation", "compilations": "Compilation", "soundtracks": "Compilation", "soundtrack": "Compilation", "boxsets": "Compilation", "box sets": "Compilation", "box set": "Compilation", "best of": "Compilation", "misc": "Compilation", "miscellaneous": "Compilation",
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ALBUM = re.compile(r"/album/(\d+)(?:/|$|\?|')")


class Token(NamedTuple):
    kind: str  # open, close, text
    name: str
    attrs: dict


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[Token] = []
        self.muted = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.muted += tag in ("script", "style")
        self.tokens.append(Token("open", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        self.muted -= tag in ("script", "style") and self.muted > 0
        self.tokens.append(Token("close", tag, {}))

    def handle_data(self, data: str) -> None:
        if not self.muted and data.strip():
            self.tokens.append(Token("text", squeeze(data), {}))


#: A tag with the text behind it, and an attribute, of plain markup: quoted values, no references, comments, declarations or raw text.
_PLAIN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[A-Za-z][A-Za-z-]*=(?:\"[^\"<>&]*\"|'[^'<>&]*'))*)\s*>([^<&]*)")
_PAIR = re.compile(r"([A-Za-z][A-Za-z-]*)=(?:\"([^\"]*)\"|'([^']*)')")
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


@lru_cache(4096)
def _attributes(text: str) -> dict:
    return {m[1].lower(): m[2] or m[3] or "" for m in _PAIR.finditer(text)}


def _plain_tokens(html: str) -> list[Token] | None:
    """The tokens of a page that is plain markup from its first tag to its end; None for any other page."""
    out, at = [], 0
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at, name = m.end(), m[2].lower()
        if name in _RAW or m[1] and m[3]:
            return None
        out.append(Token("close", name, {}) if m[1] else Token("open", name, _attributes(m[3]) if m[3] else {}))
        if m[4] and not m[4].isspace():
            out.append(Token("text", squeeze(m[4]), {}))
    return out if at == len(html) else None


def tokens(html: str | None) -> list[Token]:
    """Plain markup is read by one expression, anything else by the tolerant reader."""
    plain = _plain_tokens(html or "")
    if plain is not None:
        return plain
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.tokens


def squeeze(text: str) -> str:
    return " ".join(text.split())


def classes(t: Token) -> list[str]:
    return t.attrs.get("class", "").split()


def text_of(part: list[Token]) -> str:
    return squeeze(" ".join(t.name for t in part if t.kind == "text"))


def element(part: list[Token], start: int) -> list[Token]:
    """The tokens inside the element that opens at start."""
    depth, name = 0, part[start].name
    for k in range(start, len(part)):
        if part[k].name == name and part[k].kind != "text":
            depth += 1 if part[k].kind == "open" else -1
            if depth == 0:
                return part[start + 1 : k]
    return part[start + 1 :]


def first(part: list[Token], want: Callable[[Token], bool]) -> list[Token] | None:
    for k, t in enumerate(part):
        if t.kind == "open" and want(t):
            return element(part, k)
    return None


def tagged(name: str, cls: str | None = None) -> Callable[[Token], bool]:
    return lambda t: t.name == name and (cls is None or cls in classes(t))


def full_year(two: int, now: int) -> int:
    """Two-digit years up to the current one plus five are of this century."""
    return two + (2000 if two <= now % 100 + 5 else 1900)


def spoken_date(text: str, now: int = 2025) -> str | None:
    """'May 3rd 24' to an ISO date."""
    m = re.search(r"([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}|\d{2})\b", text)
    if not m or m[1].lower() not in MONTHS:
        return None
    year = int(m[3]) if len(m[3]) == 4 else full_year(int(m[3]), now)
    try:
        return datetime(year, MONTHS.index(m[1].lower()) + 1, int(m[2])).date().isoformat()
    except ValueError:
        return None


def numeric_date(text: str, now: int = 2025) -> str | None:
    """'mm-dd-yy[ hh:mm am]' to ISO."""
    m = re.fullmatch(r"(\d{1,2})-(\d{1,2})-(\d{2})(?:\s+(\d{1,2}):(\d{2})\s*([ap]m)?)?", squeeze(text).lower())
    if not m:
        return None
    hour = int(m[4] or 0) % 12 + 12 * (m[6] == "pm") if m[6] else int(m[4] or 0)
    try:
        at = datetime(full_year(int(m[3]), now), int(m[1]), int(m[2]), hour, int(m[5] or 0))
    except ValueError:
        return None
    return at.isoformat() if m[4] else at.date().isoformat()


def number(text: str | None) -> int | None:
    m = re.search(r"\d+", re.sub(r"[,.]", "", text or ""))
    return int(m[0]) if m else None


def decimal(text: str | None) -> float | None:
    m = re.search(r"\d+(?:\.\d+)?", (text or "").replace(",", "."))
    return float(m[0]) if m else None


def absolute(base: str, link: str | None) -> str | None:
    """link against base, if that gives an http or https address with a host."""
    if not link:
        return None
    whole = urljoin(base, link)
    parts = urlsplit(whole)
    return whole if parts.scheme in ("http", "https") and parts.netloc else None


def album_path(part: list[Token], before: list[Token]) -> str | None:
    """From an onclick, a data attribute, a link, else the previous cell's link; without query, fragment and last slash."""
    for t in part:
        if t.kind == "open":
            m = re.search(r"/album/\d+[^'\"]*", t.attrs.get("onclick", ""))
            if m or t.attrs.get("data-album-path"):
                return re.split("[?#]", m[0] if m else t.attrs["data-album-path"])[0].rstrip("/")
    for t in [*part, *before]:
        if t.kind == "open" and t.name == "a" and ALBUM.search(t.attrs.get("href", "")):
            return re.split("[?#]", t.attrs["href"])[0].rstrip("/")
    return None


def image(part: list[Token]) -> str | None:
    for t in part:
        if t.kind == "open" and t.name == "img":
            return t.attrs.get("data-original") or t.attrs.get("data-src") or t.attrs.get("src")
    return None


def chart_rows(html: str, url: str) -> Iterator[dict]:
    """Ranked albums of a chart page, by rank; entries without album path or rank are skipped."""
    page, cells, k = tokens(html), [], 0
    while k < len(page):
        t = page[k]
        if t.kind == "open" and t.name == "td" and "blackbox" in classes(t):
            inside = element(page, k)
            cells.append([t, *inside])
            k += len(inside)
        k += 1
    found = []
    for before, cell in zip([[], *cells], cells, strict=False):
        title = first(cell, tagged("font", "darktext"))
        path = album_path(cell, before)
        rank = number(text_of(before))
        m = ALBUM.search(f"{path}/") if path else None
        if title is None or not m or rank is None:
            continue
        bold = first(cell, tagged("b")) or first(cell, tagged("a"))
        marks = [element(cell, i) for i, t in enumerate(cell) if t.kind == "open" and t.name == "table"]
        score = first(marks[0], tagged("b")) if marks else None
        votes = first(marks[0], tagged("font", "contrasttext")) if marks else None
        link = first(cell, tagged("a"))
        artist = text_of(link) if link is not None and not any(t.kind == "open" and t.name == "b" for t in cell[: cell.index(next(x for x in cell if x.kind == "open" and x.name == "font"))]) and not cell[0].attrs.get("onclick") else text_of(bold or [])
        year = re.search(r"(?:19|20)\d\d", url or "")
        found.append({
            "year": int(year[0]) if year else None, "rank": rank, "album_id": int(m[1]), "album_title": text_of(title), "artist_name": artist, "album_url": absolute(url, path), "art_url": absolute(url, image(before) or image(cell)),
            "rating": decimal(text_of(score)) if score else None, "votes": number(text_of(votes)) if votes else None,
        })
    yield from sorted(found, key=lambda r: r["rank"])


def soundoff_rows(html: str, url: str) -> Iterator[dict]:
    """Ratings with comments of an album page; those without rating, label or user are skipped."""
    page = tokens(html)
    box = first(page, lambda t: t.name == "table" and "border-top:8px solid" in t.attrs.get("style", ""))
    entry = lambda t: t.kind == "open" and t.name == "table" and "border-bottom:1px dotted" in t.attrs.get("style", "")
    box = box or []
    starts = [k for k, t in enumerate(box) if entry(t)]
    for k, end in zip(starts, [*starts[1:], len(box)], strict=False):
        head = element(box, k)
        rest = box[k + len(head) + 1 : end]
        score, label = first(head, tagged("font", "reviewheading")), first(head, tagged("font", "mediumtext"))
        link = next((i for i, t in enumerate(head) if t.kind == "open" and t.name == "a" and t.attrs.get("href", "").startswith("/user/")), None)
        try:
            value = float(text_of(score or []))
        except ValueError:
            continue
        if label is None or link is None:
            continue
        user = head[link].attrs["href"].strip("/").split("/")[1]
        said = first(rest, tagged("table"))
        role = first(head, tagged("font", "brighttext"))
        yield {
            "user_id": user, "user_display": text_of(element(head, link)) or user, "user_role": text_of(role) if role else None, "rating": value, "rating_label": text_of(label),
            "rating_date": spoken_date(text_of(head)), "soundoff_text": text_of(said) or None if said else None,
        }


TRACK = re.compile(r"^\s*(\d+)[.)]\s*(.+?)\s+((?:\d+:)?\d{1,2}:\d{2})?\s*$")


def seconds(text: str | None) -> int | None:
    parts = [int(p) for p in (text or "").split(":")] if text else []
    if len(parts) not in (2, 3) or parts[-1] >= 60 or parts[-2] >= 60:
        return None
    return (parts[0] * 3600 if len(parts) == 3 else 0) + parts[-2] * 60 + parts[-1]


def track_rows(html: str, url: str) -> Iterator[dict]:
    """Numbered lines of a track list; position 0 is no track."""
    lines = re.split(r"<br\s*/?>|\n|</?t[dr][^>]*>", html or "")
    for line in lines:
        m = TRACK.match(squeeze(re.sub("<[^>]*>", " ", line)) + " ")
        if m and int(m[1]) > 0:
            yield {"position": int(m[1]), "title": m[2], "duration_seconds": seconds(m[3])}


def profile_rows(html: str, url: str) -> Iterator[dict]:
    """The one row of a profile page."""
    page = tokens(html)
    big = first(page, lambda t: t.name == "font" and t.attrs.get("size") in ("6", "7"))
    title = first(page, tagged("title"))
    user = urlsplit(url or "").path.strip("/").split("/")[-1]
    labels = [k for k, t in enumerate(page) if t.kind == "open" and t.name == "font" and "category" in classes(t)]
    stats = {}
    for k in labels:
        label = element(page, k)
        value = first(page[k + len(label) + 1 :], tagged("font"))
        stats[text_of(label).lower()] = text_of(value) if value else None
    member = next((m[1] for t in page if t.kind == "open" and (m := re.search(r"memberid=(\w+)", t.attrs.get("href", "")))), None)
    badge = first(page, tagged("font", "brighttext"))
    objectivity = decimal((stats.get("objectivity") or "").rstrip("%"))
    yield {
        "user_id": user, "display_name": text_of(big or []) or (text_of(title).split("|")[0].strip() if title else "") or user, "role": text_of(badge) if badge else None, "join_date": numeric_date(stats.get("joined") or ""),
        "last_active": numeric_date(stats.get("last active") or ""), "soundoffs": number(stats.get("soundoffs")), "ratings_count": number(stats.get("album ratings")), "objectivity_score": objectivity, "member_id": member,
    }


def vote_rows(html: str, url: str) -> Iterator[dict]:
    """A user's votes; a header row's rating holds for the rows of class default and default2 after it. has_more tells of a next page."""
    page, rating = tokens(html), None
    here = int(m[1]) if (m := re.search(r"page=(\d+)", url or "")) else 1
    links = [(t.attrs.get("href", ""), text_of(element(page, k)).lower()) for k, t in enumerate(page) if t.kind == "open" and t.name == "a"]
    more = any(text in ("next", ">", "»") or (m := re.search(r"page=(\d+)", href)) and int(m[1]) >= here + 1 for href, text in links)
    for k, t in enumerate(page):
        if t.kind != "open" or t.name != "tr":
            continue
        row = element(page, k)
        if "profilebox" in classes(t):
            m = re.search(r"[0-5](?:\.5)?", text_of(row))
            rating = float(m[0]) if m else None
        elif {"default", "default2"} & set(classes(t)) and rating is not None:
            at = next((i for i, x in enumerate(row) if x.kind == "open" and x.name == "a" and ALBUM.search(x.attrs.get("href", ""))), None)
            if at is None:
                continue
            link = element(row, at)
            small = first(link, tagged("font", "smalloffset"))
            whole, title = text_of(link), text_of(small) if small else ""
            artist = whole[: -len(title)].strip(" -") if title and whole.endswith(title) else whole.split(" - ")[0]
            title = title or (whole.split(" - ", 1)[1] if " - " in whole else "")
            href = row[at].attrs["href"]
            yield {"release_id": int(ALBUM.search(href)[1]), "release_title": title or "Unknown Release", "artist_name": artist or "Unknown Artist", "rating": rating, "url": absolute(url, href), "has_more": bool(more)}


def discography_rows(html: str, url: str) -> Iterator[dict]:
    """An artist's releases under their category headings, and one row of genres (release_id null)."""
    page, kind, current, found = tokens(html), "LP", None, {}
    genres: dict[str, str] = {}
    for k, t in enumerate(page):
        if t.kind == "text":
            label = t.name.lower().strip(" :")
            if label in TYPE_OF:
                kind = TYPE_OF[label]
            elif current is not None:
                year = re.search(r"\b(?:19|20)\d\d\b", t.name)
                if year and current["release_year"] is None and not current["title"].endswith(t.name):
                    current["release_year"] = int(year[0])
                elif re.fullmatch(r"[0-5](?:\.\d)?", t.name) and current["avg_rating"] is None:
                    current["avg_rating"] = float(t.name)
                elif m := re.search(r"([\d,.]+)\s*(?:votes|ratings)", t.name, re.I):
                    current["ratings_count"] = number(m[1])
        elif t.kind == "open" and t.name == "a":
            href = t.attrs.get("href", "")
            if m := ALBUM.search(href):
                current = found.setdefault(int(m[1]), {"release_id": int(m[1]), "title": "", "release_type": kind, "release_year": None, "art_url": None, "avg_rating": None, "ratings_count": None})
                current["title"] = current["title"] or text_of(element(page, k))
                current["art_url"] = current["art_url"] or absolute(url, image(element(page, k)))
            elif "/genre/" in href and (name := text_of(element(page, k))):
                genres.setdefault(name.casefold(), name)
    for row in found.values():
        if row["title"]:
            yield row | {"genres": None}
    if genres:
        yield {"release_id": None, "genres": list(genres.values())}


# The columns of each parser's rows.
SCHEMAS = {
    "chart": (chart_rows, "year int, rank int, album_id bigint, album_title string, artist_name string, album_url string, art_url string, rating double, votes bigint"),
    "soundoffs": (soundoff_rows, "user_id string, user_display string, user_role string, rating double, rating_label string, rating_date string, soundoff_text string"),
    "tracklist": (track_rows, "position int, title string, duration_seconds int"),
    "profile": (profile_rows, "user_id string, display_name string, role string, join_date string, last_active string, soundoffs int, ratings_count int, objectivity_score double, member_id string"),
    "votes": (vote_rows, "release_id bigint, release_title string, artist_name string, rating double, url string, has_more boolean"),
    "discography": (discography_rows, "release_id bigint, title string, release_type string, release_year int, art_url string, avg_rating double, ratings_count int, genres array<string>"),
}
#: Rows of a batch that leaves a parser.
ROWS = 8_192
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def parse_pages(pages: DataFrame, kind: str) -> DataFrame:
    """(page_id, the parser's columns) for every row that parser `kind` finds in pages (page_id, url, html)."""
    parser, columns = SCHEMAS[kind]
    named = [c.split(" ") for c in columns.split(", ")]
    schema = pa.schema([("page_id", pa.int64()), *((n, _ARROW[t]) for n, t in named)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pages come one by one and rows leave in batches of some thousands, so a task holds few pages and rows, however many or long.
        columns = [[] for _ in names]
        for batch in batches:
            for at in range(batch.num_rows):
                page, url, html = (column[at].as_py() for column in batch.columns)
                for row in parser(html or "", url or ""):
                    columns[0].append(page)
                    for column, name in zip(columns[1:], names[1:], strict=True):
                        column.append(row.get(name))
                    if len(columns[0]) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                        columns = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id bigint, {columns}")
