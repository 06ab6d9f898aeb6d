"""Blocks of long histories against a plain sequential replay."""

import random

import pytest
from pyspark.sql import functions as F

from listings_spark.operators import histories
from listings_spark.operators import lifecycle as L
from test_lifecycle import SCHEMA, as_dicts, history, replay


@pytest.mark.parametrize("seed,threshold,block", [(11, 2, 3), (12, 1, 7), (13, 3, 1), (14, 2, 5), (15, 3, 11)])
def test_blocks_equal_sequential_replay(spark, seed, threshold, block):
    rows = history(seed, commits=90, listings=4)
    # One listing has a short history and stays whole.
    rows = [r for r in rows if r[1] != "3" or r[0] < block]
    jobs, links, flags = replay(rows, threshold)
    log = spark.createDataFrame(rows, SCHEMA)
    long = histories.long_histories(log, block)
    assert {r[0] for r in long.select("listing_id").distinct().collect()} == {"0", "1", "2"}
    assert long.groupBy("listing_id", "block").count().agg(F.max("count")).first()[0] == block
    folded = L.fold(log, threshold=threshold, long=long).checkpoint()
    assert as_dicts(L.listings_from(folded), L.provenance_from(folded, threshold)) == (jobs, links)
    names = ("new", "updated", "closed", "reopened", "deleted")
    got = {r["run_seq"]: {n: r[f"{n}_count"] for n in names} for r in L.counters_from(folded).collect()}
    assert got == flags


@pytest.mark.parametrize("seed", [21, 22, 23])
def test_blocks_continue_stored_state(spark, seed):
    rows = history(seed, commits=80, listings=3)
    cut = 25
    jobs, links, _ = replay(rows, 2)
    log = spark.createDataFrame(rows, SCHEMA)
    # The first part counts with a higher threshold in one case, so a stored count may exceed the next one.
    listings, provenance, _ = L.merge(log.filter(f"run_seq < {cut}"), threshold=2)
    listings, provenance = listings.checkpoint(), provenance.checkpoint()
    rest = log.filter(f"run_seq >= {cut}")
    folded = L.fold(rest, listings, provenance, 2, histories.long_histories(rest, 6)).checkpoint()
    assert as_dicts(L.listings_from(folded), L.provenance_from(folded, 2)) == (jobs, links)


def test_counts_stored_beyond_a_lower_threshold_stay(spark):
    rows = [r for r in history(31, commits=60, listings=2) if r[2] != "audit_unavailable"]
    log = spark.createDataFrame(rows, SCHEMA)
    first, rest = log.filter("run_seq < 30"), log.filter("run_seq >= 30 and kind <> 'observed'")
    listings, provenance, _ = L.merge(first, threshold=5)
    listings, provenance = listings.checkpoint(), provenance.checkpoint()
    plain = L.fold(rest, listings, provenance, 2).checkpoint()
    cut = L.fold(rest, listings, provenance, 2, histories.long_histories(rest, 4)).checkpoint()
    assert as_dicts(L.listings_from(cut), L.provenance_from(cut, 2)) == as_dicts(
        L.listings_from(plain), L.provenance_from(plain, 2)
    )


def test_no_long_history(spark):
    log = spark.createDataFrame(history(5, commits=6), SCHEMA)
    assert histories.long_histories(log, 6) is None


def test_a_hot_listing_spreads_over_tasks(spark):
    """A listing with most of the commits is folded in many tasks, each with one block of it at most."""
    rng = random.Random(2)
    rows = [r for r in history(41, commits=400, listings=1)] + [r for r in history(42, commits=8, listings=3) if r[1] != "0"]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, SCHEMA)
    long = histories.long_histories(log, 20)
    folded = L.fold(log, threshold=2, long=long)
    sizes = folded.groupBy("listing_id", "block").count().collect()
    blocks = [r["count"] for r in sizes if r["listing_id"] == "0"]
    assert len(blocks) >= 8 and max(blocks) <= 20 + 4  # with the state and links that a block starts from
    jobs, links, _ = replay(rows, 2)
    folded = folded.checkpoint()
    assert as_dicts(L.listings_from(folded), L.provenance_from(folded, 2)) == (jobs, links)
