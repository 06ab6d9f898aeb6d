"""Fingerprints and groups against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from listings_spark.llm import simhash


def plain_print(text: str, width: int = 4) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes: list[int], most: int) -> list[int]:
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)] + ["Ä", "İx", "ſa", "K", "A B"]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 3, 5, 80, 400]))) for _ in range(60)]
    out = list(base)
    for text in base:
        for _ in range(3):
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = "edit"
            out.append(" ".join(parts).upper() if rng.random() < 0.2 else " ".join(parts))
    return [*out, "", None, " \t\n", "one two three four", "ONE two\u000bthree\tfour", base[3]]


def test_whole_query(spark, texts):
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string")
    got = {r["doc_id"]: r for r in simhash.near_groups(docs).collect()}
    codes = [plain_print(t or "") for t in texts]
    assert [got[i * 3 + 1]["print"] % 2**64 for i in range(len(texts))] == codes
    groups = plain_groups(codes, simhash.MOST_BITS)
    assert [got[i * 3 + 1]["component_id"] for i in range(len(texts))] == [g * 3 + 1 for g in groups]


@pytest.mark.parametrize("dense", [False, True])
def test_index_joins_what_brute_force_joins(dense):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for _ in range(4):
        flips = np.uint64(1) << rng.integers(0, 12 if dense else 64, len(codes), dtype=np.uint64)
        codes = np.concatenate([codes, codes ^ flips])
    codes = np.unique(codes)
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    codes = codes[np.argsort(rank)]
    for most in (0, 1, 4):
        a, b = simhash.segment_links(np.zeros(len(codes), dtype=int), codes, most)
        labels = dict(zip(a.tolist(), b.tolist(), strict=True))
        sets = {}
        for c in codes.tolist():
            sets.setdefault(labels.get(c, c), set()).add(c)
        wanted = {}
        for c, g in zip(codes.tolist(), plain_groups(codes.tolist(), most), strict=True):
            wanted.setdefault(g, set()).add(c)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, wanted.values()))
        assert len(a) == len(codes) - len(sets)


def test_every_close_pair_shares_a_mask():
    masks = simhash.block_masks()
    rng = random.Random(2)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 4):
            y ^= 1 << bit
        assert any(x & m == y & m for m in masks)


def test_gray_rank(spark):
    codes = [i ^ (i >> 1) for i in range(200)]
    df = spark.createDataFrame([(c,) for c in codes], "c long")
    assert [r[0] for r in df.select(simhash.gray_rank(F.col("c"))).collect()] == list(range(200))


def test_empty_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(empty).collect() == []
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "q")]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 7), (7, 7), (7, 7)]
