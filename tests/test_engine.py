"""Goldens, invariants and SQL counterparts of the rating engine on the smallest tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tunegrid.functions import text
from tunegrid.operators import evaluation, fusion, merge, pairs, ranking
from tunegrid.plans import registry
from tunegrid.sources import pages

SF = "/root/testdata/sf0.001"
SOME = ["parse_charts", "parse_votes", "parse_soundoffs", "parse_discographies", "parse_tracklists", "parse_profiles", "least_test_split", "user_chunks", "get_or_create_names", "bucket_waits", "negative_samples", "orphans", "release_pairs", "recommend_pairs", "recommend_content", "recommend_rrf", "popular_unseen", "user_collection", "queue_claim", "merge_coalesce_old", "holdout_split", "duration_parse", "date_parse", "eligible_matrix"]


@pytest.mark.parametrize("name", SOME)
def test_sql_counterparts(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "customer", "orders", "lineitem", "embeddings"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    want, got = con.sql(registry.ORACLES[name]), registry.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert Counter(want.fetchall()) == Counter(tuple(r[c] for c in want.columns) for r in got.collect())


def test_pairs_golden(spark):
    likes = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (4, 3)], "id_user long, id_release long")
    got = {(r[0], r[1]): (r[2], round(r[3], 6), round(r[4], 6)) for r in pairs.release_pairs(likes, 1).collect()}
    assert len(got) == 6 and got[1, 2] == got[2, 1] == (3, 0.75, 0.25) and got[1, 3] == (2, 0.5, 0.25) and got[2, 3] == (1, 0.25, 0.166667)


def test_rrf_sums_reciprocal_ranks(spark):
    lists = {"pairs": [40, 10, 30], "content": [10, 20], "nmf": [20, 50, 10], "two_towers": [50]}
    rows = [(1, name, place, item) for name, items in lists.items() for place, item in enumerate(items, 1)]
    want = {i: sum(1 / (10 + items.index(i) + 1) for items in lists.values() if i in items) for i in {x for items in lists.values() for x in items}}
    scored = ranking.by_score(fusion.rrf_scores(spark.createDataFrame(rows, "id_user long, strategy string, rank long, id_release long")), 4).orderBy("rank").collect()
    best = sorted(want, key=lambda i: (-round(want[i], 9), i))[:4]
    assert [(r.id_release, r.score) for r in scored] == [(i, round(want[i], 9)) for i in best]


def test_diversify(spark):
    ranked = spark.createDataFrame([(1, k + 1, k) for k in range(4)], "id_user long, rank long, id_release long")
    releases = spark.createDataFrame([(0, 7), (1, 7), (2, 8), (3, 8)], "id_release long, artist_id long")
    assert [r.id_release for r in ranking.diversify(ranked, releases, 3).orderBy("rank").collect()] == [0, 2, 1]


def test_metrics_golden(spark):
    recs = spark.createDataFrame([(1, "s", k, k) for k in range(1, 5)], "id_user long, strategy string, rank long, id_release long")
    relevant = spark.createDataFrame([(1, 2), (1, 4), (1, 9)], "id_user long, id_release long")
    releases = spark.createDataFrame([(k, 1, 4) for k in range(1, 5)], "id_release long, artist_id long, ratings_count long")
    genres = spark.createDataFrame([(1, 1), (2, 2)], "id_release long, id_genre long")
    got = {r.metric: round(r.value, 6) for r in evaluation.metrics_long(recs, relevant, releases, genres, 4).collect()}
    assert (got["ndcg"], got["precision"], got["recall"], got["f1"], got["mrr"]) == (0.650921, 0.5, 0.666667, 0.571429, 0.5)
    assert got["artist_diversity"] == 0.25 and got["genre_diversity"] == 0.5 and got["novelty"] == 0


def test_recommendations_hold_invariants(spark):
    rows = registry.QUERIES["recommend_rrf"](spark, SF).collect()
    by_user = {}
    for r in rows:
        by_user.setdefault(r.id_user, []).append(r.rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 9 for v in by_user.values())
    seen = {(r.id_user, r.id_release) for r in registry.QUERIES["interactions_latest"](spark, SF).collect()}
    assert not seen & {(r.id_user, r.id_release) for r in rows}


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, "a", "done", 3), (2, None, "pending", 1)], "id long, v string, status string, priority int")
    new = spark.createDataFrame([(1, None, "pending", 2), (2, "b", "pending", 5), (3, "c", "pending", 1)], "id long, v string, status string, priority int")
    rows = {r.id: (r.v, r.status, r.priority) for r in merge.merge(old, new, ["id"], {"v": "coalesce_new", "status": "sticky", "priority": "greatest"}).collect()}
    assert rows == {1: ("a", "done", 3), 2: ("b", "pending", 5), 3: ("c", "pending", 1)}
    assert merge.merge(old, new, ["id"], {"v": "new"}).where("id = 1").first().v is None


def test_text_functions(spark):
    df = spark.createDataFrame([("May 3rd 24", "1:02:03", "1.234 votos", "Été à Paris!"), ("nothing", "1:75", "none", None)], "d string, t string, v string, s string")
    a, b = df.select(text.spoken_date("d"), text.duration_seconds("t"), text.votes("v"), text.ascii_slug("s")).collect()
    assert (str(a[0]), a[1], a[2], a[3]) == ("2024-05-03", 3723, 1234, "ete-a-paris") and tuple(b) == (None, None, None, None)


def page(spark, kind, html, url="https://site.test/user/ana?page=3"):
    rows = spark.createDataFrame([(7, url, html), (8, None, None), (9, url, "")], "page_id long, url string, html string")
    return [r for r in pages.parse_pages(rows, kind).collect() if r.page_id == 7]


def test_chart_page_with_gaps(spark):
    """Entries without rank or album are skipped; scores may have a comma, votes a point; ranks come in order."""
    pair = lambda rank, link, body: f"<td class='blackbox x'>{rank}</td><td class='blackbox' {link}>{body}</td>"
    body = "<font><b>{}</b></font><font class=darktext>{}</font><table><tr><td><b>{}</b><font class=contrasttext>{}</font></td></tr></table>"
    html = "<table><tr>" + pair("#17", "data-album-path='/album/401/Harbour?s=1'", body.format("Low Tide", "Harbour", "3,25", "2.048 votos"))
    html += pair("9.", "onclick=\"x('/album/77/')\"", body.format("A &amp; B", "Nine <i>Lives</i>", "n/a", "none")) + pair("no rank", "onclick=\"x('/album/5/')\"", body.format("X", "Y", "1", "1")) + pair("3", "", body.format("X", "Y", "1", "1"))
    got = page(spark, "chart", html + "</tr></table>", "https://site.test/best/1987")
    assert [(r.year, r.rank, r.album_id, r.album_title, r.artist_name, r.album_url, r.rating, r.votes) for r in got] == [
        (1987, 9, 77, "Nine Lives", "A & B", "https://site.test/album/77", None, None),
        (1987, 17, 401, "Harbour", "Low Tide", "https://site.test/album/401/Harbour", 3.25, 2048),
    ]


def test_vote_page_of_several_ratings(spark):
    html = "<a href='?page=4'>older</a><table><tr class=default><td><a href='/album/1/'>Too - Early</a></td></tr><tr class=profilebox><td>1.5 poor</td></tr>"
    html += "<tr class=default2><td><a href='/album/31/'>Kite - Paper Sky</a></td></tr><tr class=default><td>nothing linked</td></tr><tr class='x profilebox'><td>5 classic</td></tr><tr class=default><td><a href='/album/32/'>Kite <font class=smalloffset>Rope</font></a></td></tr></table>"
    got = [(r.release_id, r.artist_name, r.release_title, r.rating, r.has_more) for r in page(spark, "votes", html)]
    assert got == [(31, "Kite", "Paper Sky", 1.5, True), (32, "Kite", "Rope", 5.0, True)]
    assert not any(r.has_more for r in page(spark, "votes", html.replace("page=4", "page=2")))


def test_soundoff_page_without_ratings_or_users(spark):
    entry = "<table style='border-bottom:1px dotted #000'><tr><td>{}<font class=mediumtext>so so</font>{}</td></tr></table>{}"
    user = "<a href='/user/zoe-9'>Zoe</a> June 11th 1999"
    html = "<table style='border-top:8px solid red'><tr><td>" + entry.format("<font class=reviewheading>2.75</font>", user, "<table><tr><td>Two<br>lines</td></tr></table>") + entry.format("<font class=reviewheading>?</font>", user, "") + entry.format("<font class=reviewheading>3</font>", "nobody", "") + "</td></tr></table>"
    (r,) = page(spark, "soundoffs", html)
    assert (r.user_id, r.user_display, r.user_role, r.rating, r.rating_label, r.rating_date, r.soundoff_text) == ("zoe-9", "Zoe", None, 2.75, "so so", "1999-06-11", "Two lines")


def test_track_discography_and_profile_pages(spark):
    tracks = page(spark, "tracklist", "1) Dawn 0:59<br/>2. Long Road 1:02:07<br>3. Odd 4:75<br>0. Hidden 9:99<br>Bonus 2:00\n4. Untimed")
    assert [(t.position, t.title, t.duration_seconds) for t in tracks] == [(1, "Dawn", 59), (2, "Long Road", 3727), (3, "Odd", None), (4, "Untimed", None)]
    html = "<b>Box Sets</b><a href='/album/501/a'>Everything</a> 1973 <b>4</b> 1,204 ratings <b>Singles:</b><a href='/album/502/b'><img data-src='/p.png'></a><a href='/album/502/b'>One Day</a> 12 votes<a href='/genre/8/'>Dub</a><a href='/genre/9/'>DUB</a><a href='/genre/10/'>Folk</a>"
    *found, genres = page(spark, "discography", html, "https://site.test/bands/3")
    assert [(r.release_id, r.title, r.release_type, r.release_year, r.avg_rating, r.ratings_count) for r in found] == [(501, "Everything", "Compilation", 1973, 4.0, 1204), (502, "One Day", "Single", None, None, 12)]
    assert found[1].art_url == "https://site.test/p.png" and genres.genres == ["Dub", "Folk"]
    (p,) = page(spark, "profile", "<title>Ana B | Site</title><font class=category>Joined</font><font>12-31-98</font><font class=category>Album Ratings</font><font>3.021</font><font class=category>Objectivity</font><font>61%</font>")
    assert (p.user_id, p.display_name, p.role, p.join_date, p.ratings_count, p.objectivity_score, p.member_id) == ("ana", "Ana B", None, "1998-12-31", 3021, 61.0, None)


def test_rating_stream_upserts(spark, tmp_path):
    """Three batches: a late older rating does not win over a newer one; only the last two versions are kept."""
    from tunegrid.streaming import ratings

    schema = "id_user long, id_release long, rating double, rating_date date"
    batches = [[(1, 2, 3.0, "2001-01-01"), (1, 3, 2.0, None)], [(1, 2, 4.0, "2001-03-01"), (1, 3, 2.5, "2000-01-01")], [(1, 2, 1.0, "2001-02-01"), (2, 2, 5.0, "2001-02-01"), (1, 3, 3.5, "2000-01-01")]]
    for rows in batches:
        spark.createDataFrame(rows, "id_user long, id_release long, rating double, day string").selectExpr("id_user", "id_release", "rating", "cast(day AS date) AS rating_date").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ratings.upsert_ratings(ratings.file_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "t/v2")).collect()
    assert sorted((r.id_user, r.id_release, r.rating) for r in got) == [(1, 2, 4.0), (1, 3, 3.5), (2, 2, 5.0)]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v1", "v2"]


def test_event_counts_drop_repeated_events(spark, tmp_path):
    from tunegrid.streaming import ratings

    rows = [(1, "2024-01-01 10:05:00", "play", 1.0), (1, "2024-01-01 10:05:00", "play", 1.0), (2, "2024-01-01 10:55:00", "play", 2.0), (3, "2024-01-01 11:00:00", "skip", 4.0), (4, "2024-01-01 15:00:00", "play", 8.0)]
    spark.createDataFrame(rows, "event_id long, at string, event_type string, value double").selectExpr("event_id", "cast(at AS timestamp) AS ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    counts = ratings.event_counts(ratings.file_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string, value double"))
    counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    got = spark.sql("SELECT hour(window.start) AS h, event_type, n, total FROM counted").collect()
    assert sorted(tuple(r) for r in got) == [(10, "play", 2, 3.0), (11, "skip", 1, 4.0), (15, "play", 1, 8.0)]


def test_copied_table_is_defined_by_its_rows(spark, tmp_path):
    from tunegrid.sources import files

    rows = [(3, "c", 1), (1, "b", 2), (1, "a", 3), (2, None, 4), (4, "x", 5)]
    for k, some in enumerate((rows, rows[::-1])):
        files.copy_table(spark.createDataFrame(some, "id long, v string, n int"), str(tmp_path / str(k)), ["id"], "n < 5", 2)
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / str(k))).collect()) == [(1, "a", 3), (2, None, 4)]


def test_factors_explain_the_ratings_and_take_large_ids(spark):
    from tunegrid.operators import features

    far = 1 << 40
    rows = [(far + u, far + 10 * (u % 2) + i, 5.0) for u in range(12) for i in range(6) if (u + i) % 5]
    found = features.als_factors(spark.createDataFrame(rows, "id_user long, id_release long, rating double"), rank=4, iterations=8).collect()
    users = {r.id - far: r.factors for r in found if r.kind == "user"}
    items = {r.id - far: r.factors for r in found if r.kind == "item"}
    assert len(users) == 12 and len(items) == 12 and min(min(f) for f in [*users.values(), *items.values()]) >= 0
    score = lambda u, i: sum(a * b for a, b in zip(users[u], items[i], strict=True))
    for u in users:  # the other taste's releases score below every release of the own one, rated or not
        assert min(score(u, 10 * (u % 2) + i) for i in range(6)) > max(score(u, 10 * (1 - u % 2) + i) for i in range(6))


def test_random_unseen_walks_the_ring_as_a_full_sort_would(spark):
    from tunegrid.operators.fusion import random_unseen

    users = spark.createDataFrame([(u,) for u in (0, 1, 7, 123456, 999983)], "id_user long")
    # Equal parts: ids that differ by the modulus tie, and the lower comes first.
    ids = [0, 1, 2, 3, 5, 8, 13, 1000003, 1000004, 77777, 500000, 900001]
    releases = spark.createDataFrame([(r,) for r in ids], "id_release long")
    seen = {(1, r) for r in ids} | {(7, r) for r in ids[:9]} | {(0, 5)}
    inter = spark.createDataFrame(sorted(seen), "id_user long, id_release long")
    got = {}
    for u, rank, r in random_unseen(users, inter, releases, 4, 3).select("id_user", "rank", "id_release").collect():
        got.setdefault(u, {})[rank] = r
    for u in (0, 1, 7, 123456, 999983):
        order = sorted((r for r in ids if (u, r) not in seen), key=lambda r: ((u * 2654435761 + r * 40503 + 3 * 97) % 1000003, r))[:4]
        assert got.get(u, {}) == dict(enumerate(order, 1))
    assert random_unseen(users, inter, releases.where("false")).count() == 0
