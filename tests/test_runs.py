"""Run reports, pages by key and digest trees against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listings_spark.operators import ordering as O
from listings_spark.operators import runs as N
from listings_spark.sources import snapshots as S

DAY = datetime(2026, 3, 1)


def times(rng, n, days=20):
    return [DAY + timedelta(minutes=30 * rng.randrange(days * 48)) for _ in range(n)]


@pytest.mark.parametrize("hours", [1, 24, 10_000])
def test_run_before_equals_plain_search(spark, hours):
    rng = random.Random(hours)
    runs = [(f"r{i:03}", rng.choice(["a", "a", "a", "b", None]), t) for i, t in enumerate(times(rng, 120))]
    runs.append(("none", "a", None))
    rows = [(i // 2, rng.choice(["a", "a", "a", "b", "c", None]), t, "x") for i, t in enumerate(times(rng, 300))]
    rows += [(900, "a", None, "y"), (901, "a", DAY - timedelta(days=9), None), rows[0], rows[0]]
    made = N.with_run_before(
        # Names that the operator uses inside must not clash.
        spark.createDataFrame(rows, "n int, search_slug string, at timestamp_ntz, slice string").withColumnRenamed("n", "key"),
        spark.createDataFrame(runs, "id string, search_slug string, finished_at timestamp_ntz"), "at", hours=hours,
    )
    assert made.columns == ["key", "search_slug", "at", "slice", "run"]

    def before(search, at):
        met = [(t, i) for i, s, t in runs if search is not None and at is not None and s == search and t is not None and t <= at]
        return max(met)[1] if met else None

    expected = sorted(repr((*r, before(r[1], r[2]))) for r in rows)
    assert sorted(repr((*r[:4], r[4]["id"] if r[4] else None)) for r in made.collect()) == expected


def test_run_before_of_nothing(spark):
    rows = spark.createDataFrame([(1, "a", DAY)], "n int, search_slug string, at timestamp_ntz")
    runs = spark.createDataFrame([], "id string, search_slug string, finished_at timestamp_ntz")
    assert N.with_run_before(rows, runs, "at").collect()[0]["run"] is None
    assert N.with_run_before(rows.limit(0), runs, "at").count() == 0


RUN = "search_slug string, status string, duration_ms int, finished_at timestamp_ntz, " + ", ".join(f"{c} int" for c in N.SUMMED)


def test_totals_of_all_levels(spark):
    runs = spark.createDataFrame(
        [("a", "success", 5, DAY, 1, 1, 0, 0), ("a", "failed", 9, DAY, 2, 0, 0, 1), (None, "failed", 1, None, 4, 0, 0, 0)], RUN
    )
    searches = spark.createDataFrame([("a", "g"), ("a", "g"), ("b", "h")], "slug string, grp string")
    cube = {(r["level"], r["grp"], r["search_slug"], r["status"]): (r["runs"], r["found_count"]) for r in N.run_totals(runs, searches).collect()}
    assert cube[7, None, None, None] == (3, 7)
    assert cube[6, None, None, "failed"] == (2, 6)
    assert cube[3, None, None, None] == (1, 4) and cube[3, "g", None, None] == (2, 3)  # null group and group g
    nested = N.run_totals(runs, searches, nested=True).collect()
    assert {r["level"] for r in nested} == {0, 1, 3, 7} and len(nested) == 3 + 2 + 2 + 1
    assert N.run_totals(runs.limit(0), searches).count() == 0


def test_pages_by_key_walk_through_all_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), i) for i in range(137)]
    df = spark.createDataFrame(rows, "a int, b string, id int")
    order = [("a", True), ("b", False), ("id", True)]
    O.write_ordered(df, str(tmp_path / "t"), order)
    table = spark.read.parquet(str(tmp_path / "t"))
    seen, last = [], None
    while page := O.page_after(table, order, last, 50).collect():
        seen += [tuple(r) for r in page]
        last = page[-1].asDict()
    assert seen == [tuple(r) for r in df.orderBy(F.desc("a"), F.asc("b"), F.desc("id")).collect()]
    with pytest.raises(ValueError):
        O.page_after(table, order, {"a": 1})


def test_key_of_a_page_reaches_the_scan(spark, tmp_path):
    O.write_ordered(spark.range(1000), str(tmp_path / "t"), [("id", True)])
    page = O.page_after(spark.read.parquet(str(tmp_path / "t")), [("id", True)], {"id": 500})
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id,500)" in plan
    assert [r["id"] for r in page.collect()] == list(range(499, 489, -1))


def test_trees_name_the_damaged_buckets(spark, tmp_path):
    rows = spark.range(500).selectExpr("cast(id as string) AS k", "id * 3 AS v").union(spark.sql("SELECT NULL, 1L"))
    changed = rows.withColumn("v", F.when(F.col("k") == "77", 0).otherwise(F.col("v"))).filter("k IS NULL OR k <> '9'")
    for name, df in (("a", rows), ("same", rows.repartition(7)), ("b", changed), ("none", rows.limit(0))):
        S.write_tree(S.digest_tree(df, "k"), str(tmp_path / name))

    def damaged(x, y):
        return S.damaged_buckets(spark, str(tmp_path / x), str(tmp_path / y)).collect()

    assert damaged("a", "same") == []
    bucket = {r["k"]: r["n"] for r in rows.selectExpr("k", "substring(md5(k), 1, 2) AS n").collect()}
    assert {r["node"] for r in damaged("a", "b")} == {bucket["77"], bucket["9"]}
    lost = damaged("a", "none")
    assert sum(r["expected_rows"] for r in lost) == 501 and all(r["actual_rows"] is None for r in lost)
