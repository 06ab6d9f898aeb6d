"""Repeated strings against a table of all windows, and the index against sorting."""

import hashlib
import random

import numpy as np
import pytest

from listings_spark.llm import anchors, suffix
from listings_spark.llm.anchors import WINDOW


def plain(rows):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, from all windows."""
    least = {}
    data = [((suffix.LAST if i is None else i), (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - WINDOW + 1):
            w = b[s : s + WINDOW]
            least[w] = min(i, least.get(w, i))
    out = []
    for (i, b), (doc_id, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - WINDOW + 1):
            if least[b[s : s + WINDOW]] < i:
                gone[s : s + WINDOW] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def corpus():
    rng = random.Random(6)
    words = ["the", "of", "é", "ü", "and", "thing", "ing", "a", "on", "er", "日本"] + [f"q{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    shared = [say(30) for _ in range(4)] + ["x" * 49, "y" * 50, "z" * 51, "ab" * 200]
    rows = []
    for i in range(120):
        parts = [say(rng.randrange(60)) for _ in range(rng.randrange(4))]
        for _ in range(rng.randrange(3)):
            piece = rng.choice(shared)
            cut = rng.randrange(len(piece))
            parts.insert(rng.randrange(len(parts) + 1), piece[: cut + 40] if rng.random() < 0.5 else piece[cut:])
        rows.append((i * 2, " ".join(parts)))
    long = say(3000)
    rows += [(900, long), (901, long[:6000] + "!" + long[6000:]), (3, long), (902, "ab" * 300), (903, "")]
    rows += [(904, None), (None, long), (None, long), (905, shared[0]), (905, shared[0] + " and more"), (905, long)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("common", [suffix.COMMON, 1])
def test_whole_query(spark, corpus, monkeypatch, common):
    monkeypatch.setattr(suffix, "COMMON", common)
    docs = spark.createDataFrame([(*r, 1) for r in corpus], "doc_id long, text string, n_bytes int")
    assert sorted((tuple(r) for r in suffix.remove_repeats(docs).collect()), key=repr) == plain(corpus)


def test_empty_table(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_intervals_are_runs_of_equal_prefixes():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 99, 300), np.tile([97, 98, 99], 60), np.full(120, 100), rng.integers(97, 123, 200)])
    text = np.concatenate([text, [255], text[50:400], [255]]).astype(np.uint8)
    order = suffix.suffix_order(text)
    for least in (1, 2, 7, 50):
        got = suffix.equal_intervals(text, order, least)
        prefixes = [bytes(np.concatenate([text, text])[i : i + least]) for i in order]
        fits = order + least <= len(text)
        for j in range(1, len(order)):
            if fits[j] and fits[j - 1]:
                assert (got[j] == got[j - 1]) == (prefixes[j] == prefixes[j - 1])


def test_records_cover_every_window_and_agree_on_equal_ones(monkeypatch):
    rng = random.Random(8)
    piece = bytes(rng.choices(b"abcdefgh ", k=400))
    docs = [bytes(rng.choices(b"abcdefgh ", k=n)) for n in (0, 49, 50, 51, 700)]
    docs += [b"12345" + piece + b"678", piece[:80] + b"?" + piece[80:], b"a" * 3000]
    data = np.frombuffer(b"".join(docs), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    for chunk in (anchors.CHUNK, 256):
        monkeypatch.setattr(anchors, "CHUNK", chunk)
        monkeypatch.setattr(anchors, "ROOM", chunk + 2 * WINDOW)
        made = anchors.records(data, offsets)
        seen, where = set(), {}
        for a, c, d, f, n in zip(made.anchor, made.context, made.doc, made.first, made.count, strict=True):
            text = docs[d][f : f + n + WINDOW - 1]
            assert len(text) == n + WINDOW - 1
            where.setdefault((a, c), set()).add(text)
            for i in range(f, f + n):
                assert (d, i) not in seen
                seen.add((d, i))
                assert where.setdefault(docs[d][i : i + WINDOW], a) == a
        assert len(seen) == sum(max(0, len(d) - WINDOW + 1) for d in docs)
        assert all(len(v) == 1 for k, v in where.items() if isinstance(k, tuple))
