"""Evaluation by chunks, change sets with versions, and expansion over stored pages."""

import pytest
from pyspark.sql import functions as F

from tunegrid.operators import evaluation, fixes
from tunegrid.operators.expansion import Follow, expand


def test_stopped_evaluation_goes_on_and_bad_users_are_noted(spark, tmp_path):
    users = spark.createDataFrame([(k,) for k in range(60)], "id_user long")
    calls = []

    def evaluate(stop_at):
        def run(some):
            calls.append(1)
            if len(calls) == stop_at:
                raise KeyboardInterrupt
            fails = F.when(F.col("id_user").isin(13, 44), F.raise_error(F.concat(F.lit("bad user "), F.col("id_user").cast("string")))).otherwise(F.col("id_user") * 2)
            return some.withColumn("value", fails)

        return run

    rows, errors = evaluation.evaluate_in_chunks(users, evaluate(0), f"{tmp_path}/whole", 6)
    whole = sorted(tuple(r) for r in rows.collect())
    assert whole == [(k, 2 * k) for k in range(60) if k not in (13, 44)]
    noted = {r.id_user: r.error for r in errors.collect()}
    assert set(noted) == {13, 44} and "bad user 13" in noted[13]
    calls.clear()
    with pytest.raises(KeyboardInterrupt):
        evaluation.evaluate_in_chunks(users, evaluate(4), f"{tmp_path}/cut", 6)
    done = spark.read.parquet(f"{tmp_path}/cut/chunks").count()
    before = len(calls)
    again, noted_again = evaluation.evaluate_in_chunks(users, evaluate(0), f"{tmp_path}/cut", 6)
    assert 0 < done < 6 and len(calls) - before < before + 40
    assert sorted(tuple(r) for r in again.collect()) == whole and {r.id_user for r in noted_again.collect()} == {13, 44}
    # All is committed: nothing runs again.
    evaluation.evaluate_in_chunks(users, evaluate(len(calls) + 1), f"{tmp_path}/cut", 6)


def test_changes_count_what_they_change_and_a_failed_commit_leaves_the_old_version(spark, tmp_path):
    schema = "id long, status string, priority long, last_error string, attempts long, updated_at long"
    users = spark.createDataFrame([(1, "error", 3, "HTTP 404", 2, 5), (2, "error", 1, "timeout", 2, 5), (3, "done", 0, None, 1, 5), (None, "done", 0, None, 1, 5)], schema)
    releases = spark.createDataFrame([(7, "error", "odd", 4, 1)], "id long, status string, last_error string, attempts long, updated_at long")
    issues = spark.createDataFrame([("gone", 1), ("slow", 1), ("slow", 2), ("slow", 99), ("new", 3), ("new", 8), ("odd", 7), ("none", 3), ("new", None)], "category string, id long")
    changes = fixes.planned(issues, {"gone": ("users", "delete"), "slow": ("users", "reset"), "new": ("users", "enqueue"), "odd": ("releases", "reset")})
    tables = {"users": users, "releases": releases}
    counts = {(r.target, r.action): r.n for r in fixes.dry_run(tables, changes).collect()}
    assert counts == {("users", "delete"): 1, ("users", "reset"): 1, ("users", "enqueue"): 2, ("releases", "reset"): 1}
    folder = str(tmp_path / "store")
    assert fixes.current(spark, folder) == 0 and fixes.commit(tables, folder) == 1
    after = fixes.applied(fixes.read_version(spark, folder, ["users", "releases"]), changes, 9)
    want = [(2, "pending", 1, None, 0, 9), (3, "pending", 0, None, 0, 9), (8, "pending", 0, None, 0, 9), (None, "done", 0, None, 1, 5)]
    assert sorted(map(tuple, after["users"].collect()), key=str) == sorted(want, key=str)
    broken = after | {"releases": after["releases"].withColumn("status", F.raise_error(F.lit("disk full")))}
    with pytest.raises(Exception, match="disk full"):
        fixes.commit(broken, folder)
    assert fixes.current(spark, folder) == 1 and fixes.read_version(spark, folder, ["releases"])["releases"].first().status == "error"
    assert fixes.commit(after, folder) == 2 and fixes.read_version(spark, folder, ["releases"])["releases"].first().status == "pending"
    assert fixes.read_version(spark, folder, ["users"], 1)["users"].count() == 4
    with pytest.raises(ValueError):
        fixes.planned(issues, {"gone": ("users", "drop")})


def test_expansion_reaches_everything_once(spark):
    row = '<tr class="profilebox"><td><b>4.0</b> rated</td></tr>\n<tr class="default"><td><a href="/album/{0}/">Band 1 <font class="smalloffset">T</font></a></td></tr>'
    html = lambda ids: "<table>" + "\n".join(row.format(k) for k in ids) + "</table>"
    # A user's votes name releases; a release n is also the user n of the next step, so that chains and cycles arise.
    links = {1: [2, 3], 2: [3, 1], 3: [4], 4: [5, 5], 5: [], 6: [7]}
    pages = spark.createDataFrame([(k, f"https://music.example/uservote.php?memberid={k}&page=1", html(v)) for k, v in links.items() if k != 5], "page_id long, url string, html string")
    follow = [Follow("user", pages, "votes", (("user", F.col("release_id")),))]
    seeds = spark.createDataFrame([("user", 1), ("user", 1), ("user", None)], "kind string, id long")
    got = {r.id: (r.depth, r.status) for r in expand(seeds, follow).collect()}
    assert got == {1: (0, "done"), 2: (1, "done"), 3: (1, "done"), 4: (2, "done"), 5: (3, "error")}
    early = {r.id: (r.depth, r.status) for r in expand(seeds, follow, rounds=1).collect()}
    assert early == {1: (0, "done"), 2: (1, "pending"), 3: (1, "pending")}
    assert expand(seeds.limit(0), follow).collect() == []
