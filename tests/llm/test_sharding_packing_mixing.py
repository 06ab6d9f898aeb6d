"""Shards, packs and mixes against direct computation."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from listings_spark.llm import mixing, packing, sharding

DDL = "doc_id long, text string, source string, size int, shard string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    out = []
    for i in range(700):
        n = rng.choice([0, 1, 3, 30, 99, 100, 250, 900])
        source = rng.choice(["a", "a", "a", "B", "é", "z", None, ""])
        out.append((i * 5, " ".join(rng.choices(["x", "yy", "日本", " nbsp"], k=n)), source, 1, "s"))
    out += [(9000, None, "a", 1, "s"), (None, "no id", "B", 1, "s"), (35, "same id", "B", 1, "s")]
    out += [(35, "same id", "B", 1, "s"), (9100, " \t\n\u000b", "zero words", 1, "s")]
    out += [(9200, "w " * 40000, "long", 1, "s")]
    rng.shuffle(out)
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_shards(spark, rows):
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, DDL).repartition(5)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    shards = defaultdict(list)
    for r in got:
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
        shards[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    order = []
    for shard in sorted(shards):
        held = sorted(shards[shard], key=lambda r: r["slot"])
        assert [r["slot"] for r in held] == list(range(len(held)))
        assert abs(sum(r["size"] for r in held) - total / 16) <= largest
        order += [(r["doc_id"] is None, r["doc_id"] or 0) for r in held]
    assert order == sorted(order) and set(shards) <= set(range(16))


def test_equal_sizes_make_equal_shards(spark):
    docs = spark.createDataFrame([(i, "abc", "s", 1, "") for i in range(1600)], DDL)
    assert Counter(r["shard"] for r in sharding.shard_by_bytes(docs).collect()) == dict.fromkeys(range(16), 100)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    assert sharding.shard_by_bytes(none).collect() == []
    assert packing.pack(none).collect() == []
    assert mixing.mix(none).collect() == []


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_buckets_pad_least():
    rng = random.Random(2)
    for _ in range(20):
        lengths = [rng.choice([0, 1, 2, 5, 9, 20, 33, 34, 80, 200]) for _ in range(60)]
        counts = Counter(lengths)
        cells = sorted(counts)
        for k in (1, 2, 3, 12):
            ends = packing.best_buckets(cells, [counts[c] for c in cells], k)
            assert len(ends) <= k and ends[-1] == cells[-1]
            best = min(
                padding(lengths, [*c, cells[-1]])
                for c in itertools.combinations(cells[:-1], min(k, len(cells)) - 1)
            )
            assert padding(lengths, ends) == best


def test_length_cells_are_ordered_and_narrow(spark):
    from pyspark.sql import functions as F

    lengths = [*range(0, 3000), 10**5, 10**6, 10**6 + 10**4, 10**9]
    df = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", packing.length_cell(F.col("n")).alias("c"))
    cells = {r["n"]: r["c"] for r in df.collect()}
    assert [cells[n] for n in lengths] == sorted(cells[n] for n in lengths)
    assert len({cells[n] for n in range(256)}) == 256
    held = defaultdict(list)
    for n, c in cells.items():
        held[c].append(n)
    assert all(max(v) <= min(v) * 1.01 + 1 for v in held.values())


def test_packs(spark, rows):
    got = packing.pack(spark.createDataFrame(rows, DDL), budget=2000).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, words(t)) for i, t, *_ in rows)
    batches, lengths = defaultdict(list), {}
    for r in got:
        assert r["n_tokens"] <= r["padded_length"]
        lengths[r["bucket"]] = r["padded_length"]
        batches[r["bucket"], r["batch"]].append(r)
    assert len(lengths) <= packing.BUCKETS
    for (bucket, batch), held in batches.items():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
        assert len(held) * lengths[bucket] <= 2000 or len(held) == 1
        if (bucket, batch + 1) in batches:
            assert len(held) == max(1, 2000 // max(1, lengths[bucket]))
    counts = Counter(words(t) for _, t, *_ in rows)
    cells = sorted(counts)
    best = packing.best_buckets(cells, [counts[c] for c in cells], packing.BUCKETS)
    all_lengths = list(counts.elements())
    assert padding(all_lengths, sorted(lengths.values())) <= padding(all_lengths, best) * 1.02 + 1


def wanted_targets(sizes):
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, free = {}, float(sum(sizes.values())), set(sizes)
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, DDL)).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(
        (i, s, words(t)) for i, t, s, *_ in rows
    )
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += words(t)
    target, taken = wanted_targets(sizes), Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for source, words_taken in taken.items():
        largest = max(r["size"] for r in got if r["source"] == source)
        assert abs(words_taken - target[source]) <= largest / 2 + 1e-6
    again = mixing.mix(spark.createDataFrame(list(reversed(rows)), DDL).repartition(7)).collect()
    assert Counter(again) == Counter(got)


def test_short_documents_are_taken_less(spark):
    rows = [(i, "w " * (20 if i % 2 else 200), "a", 1, "") for i in range(4000)]
    rows += [(10**6 + i, "w " * 200, "b", 1, "") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DDL)).collect()
    share = {n: [r["copies"] for r in got if r["source"] == "b" and r["size"] == n] for n in (20, 200)}
    assert 0 < sum(share[200]) < 4000
    short = [r["copies"] for r in got if r["source"] == "a" and r["size"] == 20]
    long = [r["copies"] for r in got if r["source"] == "a" and r["size"] == 200]
    assert sum(short) / len(short) == pytest.approx(0.5 * sum(long) / len(long), rel=0.1) or sum(long) / len(long) == 3
