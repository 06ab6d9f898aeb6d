"""Fingerprints against direct editing and multiset differences."""

import hashlib
import random
from collections import Counter

import numpy as np

from listings_spark.llm import sketches


def test_peeling_recovers_every_difference():
    rng = np.random.default_rng(3)
    left, right, wanted = [], [], []
    for n in (0, 1, 2, 5, 40, 300, 5000):
        for common in (0, 1, 700):
            keys = rng.integers(0, 2**63, common + 2 * n, dtype=np.uint64) | np.uint64(1 << 63)
            left.append(keys[: common + n])
            right.append(np.concatenate([keys[:common], keys[common + n :]]))
            wanted.append(2 * n)
    assert sketches.differences(left, right).tolist() == wanted


def test_small_sketch_fails_and_a_larger_one_peels():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, 2**63, 200, dtype=np.uint64)]
    none = [np.zeros(0, dtype=np.uint64)]
    done = []
    for log in (4, 8):
        log = np.array([log])
        found, whole = sketches.sketch(keys, log).minus(sketches.sketch(none, log)).peel()
        done.append((int(found[0]) == 200, bool(whole[0])))
    assert done == [(False, False), (True, True)]


def plain(rows):
    """Results by id, in the order of the contract, for unique ids."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]

        def like(a, b):
            a, b = (Counter(sketches.PARAGRAPH.findall(x.encode())) for x in (a, b))
            total = a.total() + b.total()
            return 2 * (a & b).total() / total if total else 1.0

        out[doc_id] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), like(text, edited), like(text, after)
        )
    return out


def test_whole_query(spark):
    rng = random.Random(9)
    words = ["one", "two.", "drei,", "üñ", "日本", "x\n", "emoji😀", "a;b"] + [f"w{i}" for i in range(50)]
    rows = [(i * 7, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 9, 80, 900])))) for i in range(90)]
    rows += [(1000, None), (1001, ""), (1002, "same " * 500), (1003, "same " * 500), (None, "no id, but text")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, part string")
    got = sketches.fingerprints(docs).collect()
    wanted = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        n, sha, edited, after = wanted[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert abs(r["near_edited"] - edited) < 1e-12 and abs(r["near_next"] - after) < 1e-12
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1000] == prints[1001] and prints[1002] == prints[1003] != prints[7]


def test_one_row_repeated_rows_and_no_rows(spark):
    ddl = "doc_id long, text string"
    assert sketches.fingerprints(spark.createDataFrame([], ddl)).collect() == []
    (one,) = sketches.fingerprints(spark.createDataFrame([(1, "abcdef")], ddl)).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0
    twice = sketches.fingerprints(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a b")], ddl)).collect()
    assert len(twice) == 3 and {r["near_next"] for r in twice} == {1.0}
