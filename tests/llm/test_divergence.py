"""Divergence of sources against plain loops with exact numbers."""

import re
from collections import Counter

import numpy as np
import pytest

from listings_spark.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        often = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in often.items() if n >= least]
        sources = {d[1] for d in docs if d[0] == lang}
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if often[t] >= least) for s in sources}
        both = sum(counts.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s in sources:
            pairs = [(o, sum(abs(share(counts[s], t) - share(counts[o], t)) for t in kept)) for o in sources if o != s]
            terms = [(t, share(counts[s], t) - share(both, t)) for t in kept if counts[s][t]]
            terms = [x for x in terms if x[1] > 0]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def run(spark, rows, least):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, value string")
    return sorted(tuple(r) for r in divergence.audit(docs, least).collect())


ODD = [
    (None, None, None), ("en", None, "Ab ab, AB"), ("en", "a", ""), ("", "b", "É é à 日本 x-y 😀"), ("fr", "only", "123"),
    ("en", "a", "ab " + "long" * 40), ("en", "b", "ab " + "long" * 40), ("en", "c", "ab abc " + "long" * 41),
    ("en", "c", "ab abc " + "long" * 40), ("en", "c", "ab abc " + "long" * 40),
]


@pytest.mark.parametrize("least", [1, 2, 4])
def test_odd_rows_equal_plain_loops(spark, least):
    assert run(spark, ODD, least) == brute(ODD, least)


def test_random_rows_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abéÀ"), rng.integers(1, 9))) for _ in range(60)] + ["ab" * 9, "ab" * 10, "ab" * 33]
    rows = [
        (str(rng.choice(["en", "de"])), f"s{rng.integers(0, 5)}", " ".join(rng.choice(words, rng.integers(0, 40)))) for _ in range(200)
    ]
    assert run(spark, rows, 12) == brute(rows, 12)


def test_empty_and_very_long(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).count() == 0
    rows = [("en", "a", "word " * 300_000 + "x" * 500_000), ("en", "b", "word other")]
    assert run(spark, rows, 1) == brute(rows, 1)


def test_rare_prefixes_are_dropped_before_their_terms(spark):
    terms = divergence.document_terms(
        spark.createDataFrame([("en", "a", f"common{i} word") for i in range(5)] + [("en", "a", "rareabc")], "lang string, source string, text string")
    )
    terms = terms.coalesce(1)
    level = terms.select("lang", "terms.term").mapInArrow(divergence._prefix_batches(4, 0, None), "lang string, prefix binary, n long")
    assert {(bytes(r["prefix"]), r["n"]) for r in level.collect()} == {(b"comm", 5), (b"word", 5), (b"rare", 1)}
    bits = divergence.sieve(level.filter("n >= 2"), "prefix")
    deeper = terms.select("lang", "terms.term").mapInArrow(divergence._prefix_batches(16, 4, bits), "lang string, prefix binary, n long")
    assert {bytes(r["prefix"])[:-1] for r in deeper.collect()} == {b"word", b"common"}
    kept = divergence.kept_terms(terms, 2).collect()
    assert {bytes(r["term"]) for r in kept} == {b"common", b"word"}


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "sieve", lambda alive, column: b"\xff" * (divergence.BITS // 8))
    monkeypatch.setattr(divergence, "HELD", 3)
    assert run(spark, ODD, 2) == brute(ODD, 2)
