"""The windowed fold against a plain sequential replay of random histories."""

import random
from datetime import datetime, timedelta

import pytest

from listings_spark.operators import lifecycle as L

START = datetime(2026, 5, 1)
FIELDS = ("company", "title", "location", "link", "category", "employment_type")
SCHEMA = (
    "run_seq bigint, listing_id string, kind string, search_slug string, run_id string,"
    " observed_at timestamp_ntz, posted_at timestamp_ntz, company string, title string,"
    " location string, link string, category string, employment_type string,"
    " industries string, start_date string"
)


def history(seed, commits=60, listings=6, searches=3):
    rng = random.Random(seed)
    rows = []
    for seq in range(commits):
        audit = rng.random() < 0.2
        search = None if audit else f"s{rng.randrange(searches)}"
        when = START + timedelta(hours=seq) - timedelta(hours=rng.choice([0, 0, 0, 30]))
        for listing in range(listings):
            if rng.random() < 0.45:
                continue
            if audit:
                kind = rng.choice(["audit_available"] * 4 + ["audit_unavailable", "audit_x"])
            else:
                kind = rng.choice(["observed", "unavailable", "unavailable"])
            seen = kind == "observed"
            rows.append((
                seq, str(listing), kind, search, f"run-{seq}" if seen else None, when,
                when - timedelta(days=rng.randrange(3)) if rng.random() < 0.6 else None,
                "C", f"T{rng.randrange(2)}", "L", f"link{listing}", "c", "internship",
                rng.choice([None, "", "I", "J"]), rng.choice([None, None, "Summer 2027"]),
            ))
    return rows


def replay(rows, threshold):
    """One event at a time, in commit order."""
    listings, links, flags = {}, {}, {}

    def held(listing):
        return any(p["active"] for (s, j), p in links.items() if j == listing)

    def bump(seq, name):
        flags.setdefault(seq, dict.fromkeys(("new", "updated", "closed", "reopened", "deleted"), 0))
        flags[seq][name] += 1

    for row in sorted(rows):
        seq, listing, kind, search, run_id, when, posted = row[:7]
        fields = dict(zip(FIELDS, row[7:13]))
        optional = {"industries": row[13] or None, "start_date": row[14] or None}
        flags.setdefault(seq, dict.fromkeys(("new", "updated", "closed", "reopened", "deleted"), 0))
        job = listings.get(listing)
        if kind == "observed":
            if job is None:
                listings[listing] = {
                    **fields, **optional, "first_seen_at": min(posted or when, when),
                    "last_seen_at": when, "updated_at": when, "status": "open",
                }
                bump(seq, "new")
            else:
                effective = max(job["last_seen_at"], when)
                after = {**fields, **{k: v or job[k] for k, v in optional.items()}}
                changed = any(job[k] != v for k, v in after.items())
                reopened = job["status"] == "closed"
                job.update(after, last_seen_at=effective, status="open")
                if changed or reopened:
                    job["updated_at"] = effective
                if changed:
                    bump(seq, "updated")
                if reopened:
                    bump(seq, "reopened")
            link = links.setdefault(
                (search, listing), {"first_seen_at": when, "last_seen_at": when}
            )
            link.update(
                last_seen_at=max(link["last_seen_at"], when), last_seen_run_id=run_id,
                unavailable_confirmations=0, active=True,
            )
        elif kind == "unavailable":
            link = links.get((search, listing))
            if link is None or not link["active"]:
                continue
            link["unavailable_confirmations"] += 1
            link["active"] = link["unavailable_confirmations"] < threshold
            if not held(listing) and job["status"] == "open":
                job.update(status="closed", updated_at=max(job["updated_at"], when))
                bump(seq, "closed")
        elif kind == "audit_available" and job is not None:
            effective = max(job["last_seen_at"], when)
            if job["status"] == "closed":
                job.update(status="open", updated_at=max(job["updated_at"], effective))
                bump(seq, "reopened")
            job["last_seen_at"] = effective
            for (_, other), link in links.items():
                if other == listing:
                    link.update(unavailable_confirmations=0, active=True)
        elif kind == "audit_unavailable" and job is not None:
            del listings[listing]
            links = {k: v for k, v in links.items() if k[1] != listing}
            bump(seq, "deleted")
    return listings, links, flags


def as_dicts(listings, provenance):
    jobs = {r["listing_id"]: r.asDict() for r in listings.collect()}
    for job in jobs.values():
        del job["listing_id"]
    links = {}
    for r in provenance.collect():
        link = r.asDict()
        links[link.pop("search_slug"), link.pop("listing_id")] = link
    return jobs, links


@pytest.mark.parametrize("seed,threshold", [(1, 2), (2, 1), (3, 3), (4, 2), (5, 2)])
def test_fold_equals_sequential_replay(spark, seed, threshold):
    rows = history(seed)
    jobs, links, flags = replay(rows, threshold)
    log = spark.createDataFrame(rows, SCHEMA)
    listings, provenance, counters = L.merge(log, threshold=threshold)
    got_jobs, got_links = as_dicts(listings, provenance)
    assert got_jobs == jobs
    assert got_links == links
    got = {
        r["run_seq"]: {
            n: r[f"{n}_count"] for n in ("new", "updated", "closed", "reopened", "deleted")
        }
        for r in counters.collect()
    }
    assert got == flags


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_sliced_replay_equals_whole(spark, seed):
    rows = history(seed)
    jobs, links, _ = replay(rows, 2)
    log = spark.createDataFrame(rows, SCHEMA)
    sliced = L.replay(log, 0, 59, threshold=2, commits_per_slice=17)
    got_jobs, got_links = as_dicts(*sliced)
    assert got_jobs == jobs
    assert got_links == links


def test_lowered_threshold_keeps_stored_counts(spark):
    rows = [r for r in history(21, commits=8) if r[2] in ("observed", "unavailable")]
    log = spark.createDataFrame(rows, SCHEMA)
    listings, provenance, _ = L.merge(log, threshold=5)
    jobs, links, _ = replay(rows, 5)
    pair = next(k for k, v in links.items() if v["active"])
    stored = links[pair]["unavailable_confirmations"]
    more = [(99, pair[1], "unavailable", pair[0], None, START + timedelta(days=9), None)
            + (None,) * 8]
    _, after, _ = L.merge(spark.createDataFrame(more, SCHEMA), listings, provenance, threshold=1)
    row = after.filter(f"search_slug = '{pair[0]}' AND listing_id = '{pair[1]}'").first()
    assert row["unavailable_confirmations"] == stored + 1
    assert row["active"] is False


def test_two_confirmations_close_one_listing_and_not_its_twin(spark):
    def row(seq, listing, kind):
        seen = kind == "observed"
        return (seq, listing, kind, "s", f"r{seq}" if seen else None,
                START + timedelta(days=seq), None) + (("C", "T", "L", f"k{listing}", "c",
                "internship", None, None) if seen else (None,) * 8)

    rows = [row(0, "1", "observed"), row(0, "2", "observed"), row(1, "1", "unavailable"),
            row(1, "2", "observed"), row(2, "1", "unavailable"), row(2, "2", "observed")]
    listings, _, _ = L.merge(spark.createDataFrame(rows, SCHEMA))
    assert {r["listing_id"]: r["status"] for r in listings.collect()} == {
        "1": "closed", "2": "open"
    }


def test_late_run_keeps_optional_fields_and_first_seen(spark):
    base = ("C", "T", "L", "k", "c", "internship")
    rows = [
        (0, "1", "observed", "s", "r0", START + timedelta(days=9), None, *base, "I", "Fall 2027"),
        (1, "1", "observed", "s", "r1", START, None, *base, None, None),
    ]
    listings, provenance, _ = L.merge(spark.createDataFrame(rows, SCHEMA))
    job = listings.first()
    assert (job["industries"], job["start_date"]) == ("I", "Fall 2027")
    assert job["first_seen_at"] == job["last_seen_at"] == START + timedelta(days=9)
    assert provenance.first()["last_seen_run_id"] == "r1"


def test_collapse_log_keeps_last_row_of_a_commit(spark):
    df = spark.createDataFrame(
        [(1, "a", 5, "x"), (1, "a", 9, "y"), (2, "a", 1, "z")],
        "run_seq int, listing_id string, pos int, kind string",
    )
    assert {(r["run_seq"], r["kind"]) for r in L.collapse_log(df).collect()} == {
        (1, "y"), (2, "z")
    }


def test_collapse_log_takes_tasks_by_its_raw_rows(spark, monkeypatch):
    # The raw rows of a commit and listing, and those without either, meet in one task.
    keys = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (1, None), (None, None)]
    raw = [(seq, one, pos, f"k{pos}") for pos in range(20) for seq, one in keys]
    df = spark.createDataFrame(raw, "run_seq int, listing_id string, pos int, kind string")
    monkeypatch.setattr(L, "RAW_PER_TASK", 10)
    dealt = L.collapse_log(df, rows=len(raw)).checkpoint()
    assert dealt.rdd.getNumPartitions() == -(-len(raw) // 10)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, L.collapse_log(df).collect()))
    assert {r["kind"] for r in dealt.collect()} == {"k19"}
    assert dealt.count() == len(keys)


def test_registered_queries_collapse_in_tasks_by_raw_rows(spark, monkeypatch):
    from listings_spark.checks import lifecycle_checks

    taken = []
    collapse = L.collapse_log
    monkeypatch.setattr(L, "collapse_log", lambda *a, **k: taken.append(k["rows"]) or collapse(*a, **k))
    raw = lifecycle_checks.read(spark, "/root/testdata/sf0.001", "log_raw").count()
    lifecycle_checks.folded(spark, "/root/testdata/sf0.001")
    lifecycle_checks.log(spark, "/root/testdata/sf0.001")
    assert taken == [raw, raw]


def test_evolve(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, kind string")
    out = L.evolve(df, add={"industries": "string"}, backfill={"kind": "internship"})
    assert [r.asDict() for r in out.orderBy("id").collect()] == [
        {"id": 1, "kind": "internship", "industries": None},
        {"id": 2, "kind": "x", "industries": None},
    ]
    assert L.evolve(out, drop=("industries",)).columns == ["id", "kind"]


def test_fold_takes_tasks_by_its_rows(spark, monkeypatch):
    # Rows of the log and links of the stored state count, whatever bytes they are shuffled in.
    log = spark.createDataFrame(history(5, commits=80), SCHEMA).checkpoint()
    rows = log.count()
    assert rows > 200
    monkeypatch.setattr(L, "ROWS_PER_TASK", 10)
    first = L.fold(log).checkpoint()
    assert first.rdd.getNumPartitions() == -(-rows // 10)
    listings, links = L.listings_from(first).checkpoint(), L.provenance_from(first).checkpoint()
    later = log.selectExpr("run_seq + 100 AS run_seq", *[c for c in log.columns if c != "run_seq"])
    again = L.fold(later, listings, links)
    assert again.rdd.getNumPartitions() == -(-(rows + links.count()) // 10)
    monkeypatch.setattr(L, "ROWS_PER_TASK", 1_000_000)
    assert L.fold(log).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_stored_fold_is_read_by_as_many_tasks_as_it_had(spark, monkeypatch):
    log = spark.createDataFrame(history(6, commits=80), SCHEMA).checkpoint()
    rows = log.count()
    monkeypatch.setattr(L, "ROWS_PER_TASK", 10)
    for table in L.merge(log)[:2]:
        assert table.rdd.getNumPartitions() == -(-rows // 10)
    # A known bound of the rows stands in for counting the log.
    assert L.fold(log, rows=10 * rows).rdd.getNumPartitions() == rows
    assert L.merge(log.filter("false"))[0].count() == 0
