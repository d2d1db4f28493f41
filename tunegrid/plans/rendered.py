"""Page parsers over pages that are rendered from the tables, so that SQL over the same tables tells what they must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrid.plans.registry import register
from tunegrid.sources.adapter import Catalogue
from tunegrid.sources.pages import parse_pages

_SITE = "https://music.example"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pages(rows: DataFrame, key: str, place: str, head: str, url: Column, row: Column, foot: str) -> DataFrame:
    """One page per key: its rows' HTML in the order of place."""
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), row.alias("html")))).alias("parts"))
    return grouped.select(F.col(key).cast("bigint").alias("page_id"), url.alias("url"), F.concat(F.lit(head), F.array_join(F.col("parts")["html"], "\n"), F.lit(foot)).alias("html"))


def chart_pages(c: Catalogue) -> DataFrame:
    """A chart per year, each album in a pair of cells: rank and link, then title, score and votes."""
    rows = c.parts.select("id_release", "title", "artist_id", "release_year")
    path = _text("/album/", F.col("id_release"), "/", F.translate("title", " ", "-"))
    cell = _text(
        '<tr><td class="blackbox"><a href="', path, '">', F.lpad(F.col("id_release").cast("string"), F.greatest(F.lit(6), F.length(F.col("id_release").cast("string"))), F.lit("0")), "</a></td>",
        '<td class="blackbox" onclick="go(\'', path, "')\"><font><b>Band ", F.col("artist_id"), '</b></font> <font class="darktext">', F.initcap("title"), "</font>",
        "<table><tr><td><b>", (F.col("id_release") % 50 / 10).cast("decimal(3,1)"), '</b> <font class="contrasttext">', F.format_number(F.col("id_release") * 7, 0), " Votes</font></td></tr></table></td></tr>",
    )
    return _pages(rows, "release_year", "id_release", "<html><table>", _text(f"{_SITE}/best/albums/", F.col("release_year"), "/"), cell, "</table></html>")


def discography_pages(c: Catalogue) -> DataFrame:
    """An artist's albums in the order of their numbers, the category written before each."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("Albums", "EPs", "Singles", "Compilations")]), (F.col("id_release") % 4 + 1).cast("int"))
    item = _text("<h3>", label, '</h3><a href="/album/', F.col("id_release"), '/x"><b>', F.initcap("title"), "</b></a> <font>", F.col("release_year"), "</font> <b>", (F.col("id_release") % 50 / 10).cast("decimal(3,1)"), "</b> <i>", F.col("id_release") % 900 + 1, " Votes</i>")
    return _pages(c.parts, "artist_id", "id_release", "<html>", _text(f"{_SITE}/bands/", F.col("artist_id"), "/"), item, "</html>")


def vote_pages(c: Catalogue) -> DataFrame:
    """A user's votes, each under a header row with its rating."""
    rows = c.interactions.where("rating > 0").join(c.parts.select("id_release", "title", "artist_id"), "id_release")
    row = _text(
        '<tr class="profilebox"><td><b>', F.col("rating"), "</b> rated</td></tr>\n", '<tr class="', F.when(F.col("id_release") % 2 == 0, "default").otherwise("default2"), '"><td><a href="/album/', F.col("id_release"), '/">Band ', F.col("artist_id"),
        ' <font class="smalloffset">', F.initcap("title"), "</font></a></td></tr>",
    )
    more = '</table><a href="?page=2">2</a>'
    return _pages(rows, "id_user", "id_release", "<table>", _text(f"{_SITE}/uservote.php?memberid=", F.col("id_user"), "&page=1"), row, more)


def soundoff_pages(c: Catalogue) -> DataFrame:
    """An album's ratings with the day they were given, in words."""
    rows = c.interactions.where("rating > 0").join(c.users.select("id_user", "role"), "id_user")
    day = F.day("rating_date")
    said = F.when(F.col("id_user") % 2 == 0, F.concat(F.lit("Heard it "), F.col("id_user").cast("string"), F.lit(" times"))).otherwise("")
    entry = _text(
        '<table style="border-bottom:1px dotted #777"><tr><td><font class="reviewheading">', F.col("rating"), '</font> <font class="mediumtext">fine</font></td><td><a href="/user/u', F.col("id_user"), '">Listener ', F.col("id_user"),
        '</a> <font class="brighttext">', F.col("role"), "</font> | ", F.date_format("rating_date", "MMMM "), day, F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th"), F.date_format("rating_date", " yy"),
        "</td></tr></table><table><tr><td>", said, "</td></tr></table>",
    )
    return _pages(rows, "id_release", "id_user", '<table style="border-top:8px solid #111"><tr><td>', _text(f"{_SITE}/album/", F.col("id_release"), "/"), entry, "</td></tr></table>")


def track_pages(c: Catalogue) -> DataFrame:
    """An order's lines as a track list; every fifth without a duration."""
    lines = c.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    length = F.when(F.col("l_partkey") % 5 != 0, _text(" ", F.col("l_linenumber"), ":", F.lpad(F.col("q").cast("string"), 2, "0"))).otherwise("")
    line = _text("<tr><td>", F.col("l_linenumber"), ". Part of ", F.col("l_partkey"), length, "</td></tr>")
    return _pages(lines, "l_orderkey", "l_linenumber", "<table><tr><td>Tracks</td></tr>", F.lit(f"{_SITE}/album/1/"), line, "</table>")


def profile_pages(c: Catalogue) -> DataFrame:
    """A profile per user; every seventh without a title of its own."""
    first = c.interactions.groupBy("id_user").agg(F.min("rating_date").alias("first"), F.count("*").alias("n"))
    rows = c.users.join(first, "id_user")
    field = lambda name, value: _text('<font class="category">', name, "</font> <font>", value, "</font>")
    html = _text(
        F.when(F.col("id_user") % 7 == 0, F.lit("<title>Someone | Site</title>")).otherwise(_text('<font size="6">Listener ', F.col("id_user"), "</font>")), '<font class="brighttext">', F.col("role"), '</font><a href="/v.php?memberid=', F.col("id_user"), '">votes</a>',
        field("Joined", F.date_format("first", "MM-dd-yy")), field("Album Ratings", F.format_number("n", 0)), field("Objectivity", _text(F.round(F.col("objectivity_score"), 0).cast("int"), "%")),
    )
    return rows.select(F.col("id_user").cast("bigint").alias("page_id"), _text(f"{_SITE}/user/u", F.col("id_user")).alias("url"), html.alias("html"))


_TITLE = "array_to_string(list_transform(string_split(title, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
register("parse_charts", lambda c: parse_pages(chart_pages(c), "chart").drop("art_url"), f"""
    SELECT release_year AS page_id, release_year::INT AS year, id_release::INT AS rank, id_release AS album_id, {_TITLE} AS album_title, 'Band ' || artist_id AS artist_name,
           '{_SITE}/album/' || id_release || '/' || replace(title, ' ', '-') AS album_url, (id_release % 50) / 10.0::DOUBLE AS rating, id_release * 7 AS votes FROM parts""")
register("parse_discographies", lambda c: parse_pages(discography_pages(c), "discography").drop("art_url", "genres"), f"""
    SELECT artist_id AS page_id, id_release AS release_id, {_TITLE} AS title, ['LP', 'EP', 'Single', 'Compilation'][id_release % 4 + 1] AS release_type, release_year::INT AS release_year,
           (id_release % 50) / 10.0::DOUBLE AS avg_rating, (id_release % 900 + 1)::INT AS ratings_count FROM parts""")
register("parse_votes", lambda c: parse_pages(vote_pages(c), "votes"), f"""
    SELECT id_user AS page_id, id_release AS release_id, {_TITLE} AS release_title, 'Band ' || artist_id AS artist_name, rating, '{_SITE}/album/' || id_release || '/' AS url, true AS has_more
    FROM inter JOIN parts USING (id_release) WHERE rating > 0""")
register("parse_soundoffs", lambda c: parse_pages(soundoff_pages(c), "soundoffs"), """
    SELECT id_release AS page_id, 'u' || id_user AS user_id, 'Listener ' || id_user AS user_display, role AS user_role, rating, 'fine' AS rating_label, strftime(rating_date, '%Y-%m-%d') AS rating_date,
           CASE WHEN id_user % 2 = 0 THEN 'Heard it ' || id_user || ' times' END AS soundoff_text
    FROM inter JOIN usr USING (id_user) WHERE rating > 0""")
register("parse_tracklists", lambda c: parse_pages(track_pages(c), "tracklist"), """
    SELECT l_orderkey AS page_id, l_linenumber::INT AS position, 'Part of ' || l_partkey AS title, CASE WHEN l_partkey % 5 <> 0 THEN (l_linenumber * 60 + l_quantity)::INT END AS duration_seconds FROM lineitem""")
register("parse_profiles", lambda c: parse_pages(profile_pages(c), "profile"), """
    SELECT id_user AS page_id, 'u' || id_user AS user_id, CASE WHEN id_user % 7 = 0 THEN 'Someone' ELSE 'Listener ' || id_user END AS display_name, role, strftime(joined, '%Y-%m-%d') AS join_date, NULL::VARCHAR AS last_active,
           NULL::INT AS soundoffs, n::INT AS ratings_count, round(objectivity_score, 0)::DOUBLE AS objectivity_score, id_user::VARCHAR AS member_id
    FROM usr JOIN (SELECT id_user, min(rating_date) AS joined, count(*) AS n FROM inter GROUP BY 1) USING (id_user)""")
