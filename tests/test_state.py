"""Published state, replays, streams, audits from pages, snapshots."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from listings_spark import constants as K
from listings_spark.functions.cascade import classify
from listings_spark.operators import lifecycle as L
from listings_spark.plans import state as S
from listings_spark.sources import runlog, snapshots, tables
from listings_spark.streaming import merge as M
from test_lifecycle import SCHEMA, as_dicts, history, replay

LOG_SCHEMA = SCHEMA + ", pos bigint"


def log_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit(0).cast("bigint"))


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    rows = history(31, commits=24, listings=4)
    jobs, links, _ = replay(rows, 2)
    source, base = str(tmp_path / "log"), str(tmp_path / "state")
    for start in range(0, 24, 8):
        part = [r for r in rows if start <= r[0] < start + 8]
        M.write_commits(log_of(spark, part).coalesce(1), source)
    stream = M.log_stream(spark, source, log_of(spark, rows).schema, files_per_trigger=100)
    M.merge_stream(stream, base, str(tmp_path / "cp")).awaitTermination()
    state = S.load_state(spark, base)
    assert as_dicts(state["listings"], state["provenance"]) == (jobs, links)
    again = [r for r in rows if r[0] >= 16]
    S.apply_log(log_of(spark, again), base)
    state = S.load_state(spark, base)
    assert as_dicts(state["listings"], state["provenance"]) == (jobs, links)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    base = str(tmp_path / "state")
    rows = history(7, commits=12, listings=6)
    S.apply_log(log_of(spark, [r for r in rows if r[0] < 6]), base, buckets=8)
    first = tables.manifest(spark, base)
    held = S.load_state(spark, base)  # a reader that began before the next publication
    one = rows[-1][1]
    later = [r for r in rows if r[0] >= 6 and r[1] == one]
    S.apply_log(log_of(spark, later), base, buckets=99)  # the first publication fixed the number
    second = tables.manifest(spark, base)
    (touched,) = S._touched(log_of(spark, later), 8)
    assert second["buckets"] == 8
    for name in S.STATE:
        moved = {b for b, v in second["tables"][name].items() if first["tables"][name].get(b) != v}
        assert moved <= {str(touched)}
    jobs, links, _ = replay([r for r in rows if r[0] < 6], K.CLOSURE_CONFIRMATIONS)
    assert as_dicts(held["listings"], held["provenance"]) == (jobs, links)
    jobs, links, _ = replay([r for r in rows if r[0] < 6] + later, K.CLOSURE_CONFIRMATIONS)
    state = S.load_state(spark, base)
    assert as_dicts(state["listings"], state["provenance"]) == (jobs, links)
    assert tables.drop_old_versions(spark, base, keep=2) == []
    every = [r for r in rows if r[0] >= 6 and r[1] != one]
    renumbered = [(r[0] + 100, *r[1:]) for r in every]
    S.apply_log(log_of(spark, renumbered), base)
    tables.drop_old_versions(spark, base, keep=1)
    assert S.load_state(spark, base)["listings"].count() == len(
        replay([r for r in rows if r[0] < 6] + later + renumbered, K.CLOSURE_CONFIRMATIONS)[0]
    )


def test_late_commits_are_refused_and_change_nothing(spark, tmp_path):
    base, path = str(tmp_path / "state"), str(tmp_path / "log")
    log = log_of(spark, history(5, commits=12, listings=4))
    S.apply_log(log.filter("run_seq between 6 and 11"), base)
    before = sorted(S.load_state(spark, base)["listings"].collect(), key=str)
    with pytest.raises(S.LateCommit):
        S.apply_log(log.filter("run_seq < 6"), base)
    assert sorted(S.load_state(spark, base)["listings"].collect(), key=str) == before
    for low, high in ((0, 3), (8, 11), (4, 7)):  # the last call comes too late
        M.write_commits(log.filter(F.col("run_seq").between(low, high)), path)
        time.sleep(0.05)
    streamed = str(tmp_path / "streamed")
    query = M.merge_stream(
        M.log_stream(spark, path, log.schema, files_per_trigger=1), streamed, str(tmp_path / "check")
    )
    with pytest.raises(StreamingQueryException, match="LateCommit"):
        query.awaitTermination()
    S.apply_log(log.filter("run_seq < 4 or run_seq > 7"), str(tmp_path / "batch"))
    for name in ("listings", "provenance"):
        left, right = (
            sorted(S.load_state(spark, b)[name].collect(), key=str) for b in (streamed, str(tmp_path / "batch"))
        )
        assert left == right


def test_audit_refuses_opposite_outcomes(spark, tmp_path):
    rows = [("1", 200, False, 200, True), ("1", 404, None, None, None)]
    checks = spark.createDataFrame(
        rows, "listing_id string, public_status int, closed_notice boolean, detail_status int,"
        " identity_ok boolean",
    )
    with pytest.raises(S.AuditConflict):
        S.apply_audit(checks, str(tmp_path), F.expr("timestamp_ntz'2026-01-01 00:00:00'"))


def test_batches_merge_into_untouched_state(spark, tmp_path):
    rows = history(32, commits=20, listings=5)
    jobs, links, _ = replay(rows, 2)
    base = str(tmp_path / "state")
    for keep in (lambda r: r[0] < 9, lambda r: r[0] >= 9):
        S.apply_log(log_of(spark, [r for r in rows if keep(r)]), base)
    state = S.load_state(spark, base)
    assert as_dicts(state["listings"], state["provenance"]) == (jobs, links)
    assert tables.current_version(spark, base) == 2


def test_classification_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), f"Software Intern {2025 + i % 4}", "text", ["Paris"], None) for i in range(9)]
    schema = ("listing_id string, title string, description string, locations array<string>,"
              " posted_at timestamp_ntz")
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    M.classify_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("listing_id", "decision")
    want = classify(df).select("listing_id", "decision")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_replacement_is_whole_or_absent(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(ValueError):
        tables.read_current(spark, base)
    assert tables.replace_table(spark.range(3), base) == 1
    boom = spark.range(5).select(F.raise_error(F.lit("boom")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        tables.replace_table(boom, base)
    assert tables.read_current(spark, base).count() == 3
    assert tables.replace_table(spark.range(7), base) == 2
    assert tables.read_current(spark, base).count() == 7


NOW = datetime(2026, 8, 1)


def run_row(i, status="success", at=NOW):
    return (f"r{i}", i, "s", status, at, at, 5, 4, 3, 2, 1, "c" * 150, "m" * 700)


RUNS = (
    "id string, run_seq bigint, search_slug string, status string, started_at timestamp_ntz,"
    " finished_at timestamp_ntz, duration_ms int, found_count int, accepted_count int,"
    " excluded_count int, warning_count int, error_code string, error_message string"
)


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    runlog.append_runs(spark.createDataFrame([run_row(1), run_row(2, "failed")], RUNS), path)
    runlog.append_runs(
        spark.createDataFrame([run_row(3, at=NOW + timedelta(days=1))], RUNS), path
    )
    rows = {r["id"]: r for r in spark.read.parquet(path).collect()}
    assert len(rows) == 3
    assert rows["r1"]["error_code"] is None and rows["r1"]["found_count"] == 4
    assert rows["r2"]["found_count"] == 0
    assert (len(rows["r2"]["error_code"]), len(rows["r2"]["error_message"])) == (100, 500)
    replayed = spark.createDataFrame([run_row(3), run_row(4)], RUNS)
    assert [r["id"] for r in runlog.new_commits(replayed, spark.read.parquet(path)).collect()] == [
        "r4"
    ]


def test_audit_from_pages(spark, tmp_path):
    from test_collect import detail

    stored = [(str(i), "C", "T", "L", f"k{i}", "c", None, "internship", None, NOW, NOW, NOW,
               "closed" if i == 1 else "open") for i in range(1, 6)]
    empty = S._empty(spark)
    listings = spark.createDataFrame(stored, empty["listings"].schema)
    links = spark.createDataFrame(
        [("s", str(i), NOW, NOW, "r", 2 if i == 1 else 1, i != 1) for i in range(1, 6)],
        empty["provenance"].schema,
    )
    base = str(tmp_path / "state")
    S._publish(listings, links, empty["commits"], base, list(range(S.BUCKETS)), S.BUCKETS)
    public = spark.createDataFrame(
        [("1", 200, "<p>ok</p>"), ("2", 404, None), ("3", 503, None),
         ("4", 200, "<p>unusual activity</p>"),
         ("5", 200, '<div role="alert">No longer accepting applications</div>')],
        "listing_id string, http_status int, html string",
    )
    details = spark.createDataFrame(
        [(str(i), 200, detail("Intern")) for i in range(1, 6)],
        "listing_id string, http_status int, html string",
    )
    when = F.lit(NOW + timedelta(days=2)).cast("timestamp_ntz")
    checks = S.audit_checks(listings, public, details)
    report = S.apply_audit(checks, base, when).first().asDict()
    assert report == {"checked": 5, "available": 1, "deleted": 2, "reopened": 1,
                      "inconclusive": 2}
    state = S.load_state(spark, base)
    jobs, left = as_dicts(state["listings"], state["provenance"])
    assert set(jobs) == {"1", "3", "4"} == {j for _, j in left}
    assert jobs["1"]["status"] == "open"
    assert jobs["1"]["last_seen_at"] == jobs["1"]["updated_at"] == NOW + timedelta(days=2)
    assert left["s", "1"]["active"] and left["s", "1"]["unavailable_confirmations"] == 0
    assert left["s", "3"]["unavailable_confirmations"] == 1


def test_snapshots(spark, tmp_path):
    empty = S._empty(spark)
    rows = history(40, commits=10, listings=3)
    listings, links, _ = L.merge(spark.createDataFrame(rows, SCHEMA))
    state = {
        "searches": spark.createDataFrame([("s", True)], "slug string, enabled boolean"),
        "runs": spark.createDataFrame([run_row(1)], RUNS),
        "listings": listings, "provenance": links,
    }
    base, made = str(tmp_path / "snap"), NOW + timedelta(hours=1)
    options = dict(retention_days=30, run_id="7")
    first = snapshots.create_snapshot(state, base, created_at=made, **options)
    assert snapshots.verify_snapshot(spark, base, first).first()["problems"] == []
    with pytest.raises(ValueError, match="already exists"):
        snapshots.create_snapshot(state, base, created_at=made, **options)
    with pytest.raises(ValueError, match="collection time"):
        snapshots.create_snapshot(state, base, created_at=NOW - timedelta(days=1), **options)
    later = made + timedelta(days=1)
    second = snapshots.create_snapshot(
        state, base, created_at=later, previous_key=first, **options
    )
    with pytest.raises(ValueError, match="newer"):
        snapshots.create_snapshot(
            state, base, created_at=made + timedelta(hours=2), previous_key=second, **options
        )
    report = snapshots.manifest_violations(snapshots.load_manifest(spark, base)).collect()
    assert len(report) == 2 and all(r["violations"] == [] for r in report)
    # A row appended behind the manifest's back is found.
    state["searches"].write.mode("append").parquet(f"{base}/{second}/searches")
    assert snapshots.verify_snapshot(spark, base, second).first()["problems"] == [
        "digest", "size"
    ]
    assert empty["listings"].columns == list(L.LISTING_COLUMNS)


def test_manifest_rules(spark):
    base = ("x", 1, NOW, NOW - timedelta(days=1), None, ("calendar-days", 3,
            NOW + timedelta(days=3)), ("1", 1))

    def row(key, sha="a" * 64, **change):
        names = ("key", "rows", "created", "collected", "previous", "retention", "source")
        v = {**dict(zip(names, base)), **change}
        return (1, key, sha, v["rows"], v["created"], v["collected"], v["previous"],
                v["retention"], v["source"])

    rows = [
        row("ok"),
        row("late", collected=NOW + timedelta(days=1)),
        row("self", previous="self"),
        row("lost", previous="gone"),
        row("due", retention=("calendar-days", 3, NOW)),
        row("days", retention=("calendar-days", 9999, NOW + timedelta(days=9999))),
        row("sha", sha="XYZ"),
        row("young", created=NOW - timedelta(hours=1), previous="ok",
            retention=("calendar-days", 3, NOW - timedelta(hours=1) + timedelta(days=3))),
    ]
    df = spark.createDataFrame(rows, snapshots.MANIFEST)
    got = {r["key"]: r["violations"] for r in snapshots.manifest_violations(df).collect()}
    assert got == {
        "ok": [], "late": ["collected_after_creation"], "self": ["previous_is_self"],
        "lost": ["previous_missing"], "due": ["retain_until"], "days": ["retention_days"],
        "sha": ["digest_shape"], "young": ["previous_is_newer"],
    }


def test_commits_in_any_order_wait_for_those_before_them(spark, tmp_path):
    rows = history(51, commits=30, listings=4)
    jobs, links, _ = replay(rows, 2)
    log = log_of(spark, rows)
    expected = log.select("run_seq").distinct()
    base = str(tmp_path / "state")
    order = [3, 0, 4, 1, 2]  # blocks of six commits
    for nth, block in enumerate(order):
        part = log.filter(F.floor(F.col("run_seq") / 6) == block)
        for _ in range(2):  # a replay changes nothing
            S.apply_in_order(part, base, expected, delay=100)
        merged = {r[0] for r in S.load_state(spark, base)["commits"].collect()}
        whole = next(b for b in range(6) if b not in order[: nth + 1])  # the first block not there yet
        assert merged == {r[0] for r in rows if r[0] < 6 * whole}
    state = S.load_state(spark, base)
    assert as_dicts(state["listings"], state["provenance"]) == (jobs, links)
    assert S.late_commits(spark, base).count() == 0


def test_a_lost_commit_is_given_up_and_kept_apart_when_it_comes(spark, tmp_path):
    rows = history(52, commits=30, listings=4)
    log, base = log_of(spark, rows), str(tmp_path / "state")
    expected = log.select("run_seq").distinct()
    without = [r for r in rows if not 9 <= r[0] <= 10]
    S.apply_in_order(log.filter("run_seq < 9 or run_seq between 11 and 12"), base, expected, delay=5)
    assert S.load_state(spark, base)["commits"].agg(F.max("run_seq")).first()[0] == max(r[0] for r in rows if r[0] < 9)
    S.apply_in_order(log.filter("run_seq > 12"), base, expected, delay=5)
    S.apply_in_order(log.filter("run_seq between 9 and 10"), base, expected, delay=5)
    jobs, links, _ = replay(without, 2)
    state = S.load_state(spark, base)
    assert as_dicts(state["listings"], state["provenance"]) == (jobs, links)
    assert {r["run_seq"] for r in S.late_commits(spark, base).collect()} == {r[0] for r in rows if 9 <= r[0] <= 10}


def test_commits_that_wait_are_not_stored_again_by_the_next_batch(spark, tmp_path, monkeypatch):
    rows = history(54, commits=30, listings=4)
    jobs, links, _ = replay(rows, 2)
    log, base = log_of(spark, rows), str(tmp_path / "state")
    expected = log.select("run_seq").distinct()
    S.apply_in_order(log.filter("run_seq >= 2"), base, expected, delay=100)  # all wait for the first
    waiting = tables.read_whole(spark, base, "pending", tables.manifest(spark, base)).count()
    kept, checkpoint = [], type(log).checkpoint

    def counted(df, *args):
        held = checkpoint(df, *args)
        if "kind" in held.columns and "carried" not in held.columns:  # rows of the log
            kept.append(held.count())
        return held

    monkeypatch.setattr(type(log), "checkpoint", counted)
    S.apply_in_order(log.filter("run_seq = 1"), base, expected, delay=100)
    new = log.filter("run_seq = 1").count()
    assert waiting > new and sum(kept) == new
    pending = tables.read_whole(spark, base, "pending", tables.manifest(spark, base))
    assert pending.count() == waiting + new
    monkeypatch.undo()
    S.apply_in_order(log.filter("run_seq < 1"), base, expected, delay=100)
    S.apply_in_order(log.filter("false"), base, last=True)
    state = S.load_state(spark, base)
    assert as_dicts(state["listings"], state["provenance"]) == (jobs, links)


def test_commits_wait_for_the_delay_where_none_are_announced(spark, tmp_path):
    rows = history(53, commits=20, listings=3)
    log, base = log_of(spark, rows), str(tmp_path / "state")
    S.apply_in_order(log.filter("run_seq % 2 = 1"), base, delay=25)
    assert S.load_state(spark, base)["commits"].count() == 0
    S.apply_in_order(log.filter("run_seq % 2 = 0"), base, delay=4)
    bound = max(r[0] for r in rows) - 4
    assert S.load_state(spark, base)["commits"].agg(F.max("run_seq")).first()[0] == max(r[0] for r in rows if r[0] < bound)
    S.apply_in_order(log.filter("false"), base, last=True)
    jobs, links, _ = replay(rows, 2)
    state = S.load_state(spark, base)
    assert as_dicts(state["listings"], state["provenance"]) == (jobs, links)


def test_evolved_columns_survive_merges_of_some_buckets(spark, tmp_path):
    base = str(tmp_path / "state")
    rows = history(54, commits=20, listings=8)
    log = log_of(spark, rows)
    S.apply_log(log.filter("run_seq < 10"), base, buckets=4)
    held = {r["listing_id"] for r in S.load_state(spark, base)["listings"].collect()}
    S.evolve_state(spark, base, "listings", {"note": "string"}, backfill={"note": "kept"})
    S.evolve_state(spark, base, "provenance", {"rank": "int"})
    one = sorted(held)[0]
    S.apply_log(log.filter((F.col("run_seq") >= 10) & (F.col("listing_id") == one)), base)
    now = tables.manifest(spark, base)
    for bucket in range(4):  # each by itself, old files and new ones
        part = S.load_state(spark, base, only=[bucket])
        assert "note" in part["listings"].columns and "rank" in part["provenance"].columns
    notes = {r["listing_id"]: r["note"] for r in S.load_state(spark, base)["listings"].collect()}
    assert all(notes[i] == "kept" for i in held - {one})
    gone = any(r[1] == one and r[2] == "audit_unavailable" and r[0] >= 10 for r in rows)
    assert notes.get(one) == (None if gone else "kept")
    assert set(now["schemas"]) == {"listings", "provenance"}
    S.evolve_state(spark, base, "listings", drop=("note",))
    assert "note" not in S.load_state(spark, base)["listings"].columns


def test_a_broken_state_is_not_published(spark, tmp_path):
    base = str(tmp_path / "state")
    rows = history(55, commits=12, listings=5)
    S.apply_log(log_of(spark, [r for r in rows if r[0] < 6]), base)
    before = sorted(S.load_state(spark, base)["listings"].collect(), key=str)
    bad = [(*r[:12], "contract", *r[13:]) if r[0] == 11 and r[2] == "observed" else r for r in rows if r[0] >= 6]
    n = len({r[1] for r in bad if r[12] == "contract"})
    assert n
    with pytest.raises(tables.BrokenState, match=f"^{n} rows"):
        S.apply_log(log_of(spark, bad), base)
    assert sorted(S.load_state(spark, base)["listings"].collect(), key=str) == before
    S.apply_log(log_of(spark, bad), base, allowed=n)
    aside = tables.read_quarantine(spark, base)
    assert {r["key"] for r in aside.collect()} == {r[1] for r in bad if r[12] == "contract"}
    assert {tuple(r["violations"]) for r in aside.collect()} == {("employment_type",)}
    kept = {r["listing_id"] for r in S.load_state(spark, base)["listings"].collect()}
    assert not kept & {r["key"] for r in aside.collect()}
