"""Archives against a direct account of what they must hold, with hostile payloads."""

import hashlib
import uuid

from listings_spark.llm import warc
from listings_spark.llm.common import shared_folder

FAKE = (
    "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\n"
    "hello\r\n\r\n"
)


def round_trip(spark, rows, split=None):
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, head string")
    warc.write_archive(pages, folder)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
    try:
        return sorted(tuple(r) for r in warc.page_records(warc.read_archive(spark, folder)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        again = len(data) >= warc.LEAST_BYTES and first[data] != page
        out.append((
            page, len(data), hashlib.sha256(data).hexdigest(),
            "revisit" if again else "response", first[data] if again else None,
        ))
    return sorted(out, key=lambda r: r[0])


def test_payloads_with_magic_and_whole_records(spark):
    long = "x" * 300
    rows = [
        (1, "http://a", f"start {FAKE}{FAKE} tail {long}", "clash"),
        (2, "http://b\r\nWARC-Type: evil", FAKE, None),
        (3, None, FAKE + FAKE, None),
        (4, "", "WARC/1.1\r\n" * 40, None),
        (5, "u", "WARC/1.1\r\nContent-Length: 99999\r\n\r\nshort", None),
        (6, "u", "ends with magic WARC/1.1\r\n", None),
        (7, "u", f"start {FAKE}{FAKE} tail {long}", None),
        (8, "u", "plain\r\n\r\nbody é ü " + long, None),
    ]
    assert round_trip(spark, rows) == expected(rows)
    assert round_trip(spark, rows, split="512") == expected(rows)


def test_scans_split_in_different_ways(spark, monkeypatch):
    """Executors lost between the two scans change their splits, and no record."""
    rows = [(i, f"u{i}", f"{i} {FAKE * (i % 3)} tail {'y' * (i % 97)}" if i % 2 else FAKE + "z" * 400, None) for i in range(160)]
    plain = warc.stored

    def other_splits(df, name):
        out = plain(df, name)
        if name == "members":
            spark.conf.set("spark.sql.files.minPartitionNum", "7")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        return out

    monkeypatch.setattr(warc, "stored", other_splits)
    assert round_trip(spark, rows) == expected(rows)
    assert round_trip(spark, rows, split="700") == expected(rows)


def test_a_very_long_payload(spark):
    rows = [(1, "u", ("long words " + FAKE) * 20_000, None), (2, "u", "x" * 3_000_000, None)]
    assert round_trip(spark, rows) == expected(rows)


def test_nulls_ties_and_copies(spark):
    rows = [(i, f"u{i}", "same " * 40, None) for i in range(30)]
    rows += [(100, "u", None, None), (101, None, "", None), (102, "u", "tiny", None), (103, "u", "tiny", None)]
    assert round_trip(spark, rows) == expected(rows)


def test_repeated_rows_and_null_ids(spark):
    body = "b" * 200
    got = round_trip(spark, [(5, "u", body, None), (5, "u", body, None)])
    assert [r[3] for r in got] == ["response", "response"]
    folder_rows = [(None, "u", body, None), (9, "u", body, None)]
    pages = spark.createDataFrame(folder_rows, "page_id long, url string, html string, head string")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(pages, folder)
    got = {r["page_id"]: r for r in warc.page_records(warc.read_archive(spark, folder)).collect()}
    assert got[None]["record_type"] == "revisit" and got[None]["refers_to"] == 9


def test_empty_table(spark):
    assert round_trip(spark, []) == []


def test_pointer_jumping_takes_only_the_chain(spark):
    # 0 -> 10 -> 40 -> 70 -> 100; 20, 30 and 50 are never reached, though 30 points into the chain
    edges = [(0, 10), (10, 40), (20, 30), (30, 40), (40, 70), (50, 60), (70, 100), (100, 120)]
    nodes = spark.createDataFrame([(1, a, b) for a, b in edges], "file long, at long, next long")
    assert sorted(r["at"] for r in warc.reachable(nodes).collect()) == [0, 10, 40, 70, 100]
