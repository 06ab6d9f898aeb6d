"""Near copies of five-word shingles against exact similarities."""

import random

import numpy as np
import pytest

from listings_spark.llm import copies


def test_near_copies_of_five_word_shingles(spark):
    """Edited copies of similarity 0.85 and more are found, texts under 0.5 are left alone."""
    rng = random.Random(12)
    words = [f"word{i}" for i in range(3000)]
    rows, source = [], {}
    for i in range(80):
        text = rng.choices(words, k=400)
        rows.append((i * 10, " ".join(text)))
        for k, edits in ((1, 0), (2, 1), (3, 4), (4, 100)):
            other = list(text)
            for at in rng.sample(range(0, 400, 4), edits):
                other[at] = "edited"
            rows.append((i * 10 + k, " ".join(other)))
            source[i * 10 + k] = i * 10 if edits < 100 else i * 10 + k
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == i for i, s in source.items() if s == i)
    near = [i for i, s in source.items() if s != i]
    assert sum(got[i] == source[i] for i in near) >= 0.97 * len(near)


def edited(text, kind, similarity, new):
    """A copy of about that similarity of its five-word shingles, whose new words are all its own."""
    n = len(text) - 4
    if kind == "appended":
        return text + new[: round(n / similarity - n)]
    lost = round(n * (1 - similarity) / (1 + similarity))  # shingles that differ on each side
    if kind == "replaced":
        return text[:20] + new[: lost - 4] + text[16 + lost :]
    out = list(text)
    for k in range(lost // 5):
        out[8 + 5 * k] = new[k]
    return out


def jaccard(x, y):
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x, y))
    return len(a & b) / len(a | b)


def test_isolated_pairs_by_kind_of_edit(spark):
    rng = random.Random(77)
    words, rows, wanted = [f"w{i}" for i in range(5000)], [], {}
    for kind in ("appended", "replaced", "scattered"):
        for similarity in (0.76, 0.81, 0.83, 0.87, 0.9):
            for _ in range(15):
                text, new = rng.choices(words, k=200), [f"n{rng.getrandbits(40)}" for _ in range(100)]
                other, i = edited(text, kind, similarity, new), 2 * len(rows)
                wanted[i + 2] = i if jaccard(text, other) >= 0.8 else i + 2
                rows += [(i, " ".join(text)), (i + 2, " ".join(other))]
    assert 0.75 < sum(i != k for i, k in wanted.items()) / len(wanted) < 0.85
    got = dict(copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(got[i] == k for i, k in wanted.items()) >= 0.99 * len(wanted)
    assert all(got[i] == i for i, k in wanted.items() if i == k)


def test_units_hold_all_pairs_of_different_labels_in_small_blocks(spark):
    rng = random.Random(6)
    rows, most = [], 16
    for value, sizes in ((1, [150]+[1] * 60), (2, [3, 2, 1]), (3, [40, 30, 9, 9]), (4, [1] * 100)):
        for label, n in enumerate(sizes):
            rows += [(value, 1000 * value + 200 * len(rows) + k, label, 1.0) for k in range(n)]
    rng.shuffle(rows)
    met = spark.createDataFrame(rows, "value long, node long, label long, weight double")
    units = {}
    for unit, _, node, label, side in copies.units(met, most).collect():
        units.setdefault(unit, ([], []))[side].append((node, label))
    assert max(len(s) for u in units.values() for s in u) <= 3 * most  # blocks by hash vary
    got = set()
    for zero, one in units.values():
        for x in zero:
            got |= {frozenset((x, y)) for y in one or zero if x[1] != y[1]}
    by_value = {}
    for value, node, label, _ in rows:
        by_value.setdefault(value, []).append((node, label))
    wanted = {frozenset((x, y)) for v in by_value.values() for x in v for y in v if x[1] != y[1]}
    assert got == wanted


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("sided", [False, True])
def test_spanning_links_join_what_all_pairs_join(sided):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, 12).astype(np.uint64)) for _ in range(40)]
    for base in range(12):
        for _ in range(6):
            other = sets[base].copy()
            other[rng.integers(0, len(other))] = rng.integers(100, 10_000)
            sets.append(np.unique(other))
    sets += [np.zeros(0, dtype=np.uint64), sets[0], sets[0]]
    labels = np.arange(len(sets))
    labels[50:54] = 50
    side = rng.integers(0, 2, len(sets)) if sided else None
    links = copies.spanning_links(labels, sets, side)
    given = [(50, i) for i in range(51, 54)]
    wanted = []
    for i in range(len(sets)):
        for j in range(i):
            x, y = set(sets[i].tolist()), set(sets[j].tolist())
            if 5 * len(x & y) >= 4 * len(x | y) and (not sided or side[i] != side[j]):
                wanted.append((i, j))
    assert len(links) < len(sets)
    assert groups(len(sets), links + given) == groups(len(sets), wanted + given)


def test_a_large_group_leaves_one_link_a_member(spark, monkeypatch):
    """Thousands of edited copies of one text: blocks of 64, links no more than nodes in each round."""
    monkeypatch.setattr(copies, "BLOCK", 64)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    text = rng.choices(words, k=120)
    rows = []
    for i in range(1500):
        other = list(text)
        for at in rng.sample(range(120), 1):
            other[at] = f"e{i}"
        rows.append((i, " ".join(other)))
    rows += [(5000 + i, " ".join(rng.choices(words, k=120))) for i in range(50)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    plain = copies.stored

    def spy(df, name):
        out = plain(df, name)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(copies, "stored", spy)
    got = dict(copies.near_copies(made).collect())
    assert {got[i] for i in range(1500)} == {0}
    assert all(got[5000 + i] == 5000 + i for i in range(50))
    first, both = (x.count() for x in seen["links"])
    assert first < 2 * 1500 and both - first < 1500
    assert seen["asked"][0].count() <= 1500


def test_nulls_ties_and_very_long_texts(spark):
    long = " ".join(f"x{i % 5003}y{i}" for i in range(200_000))
    rows = [(None, long), (3, long + " end"), (3, "a b"), (3, "a b"), (None, None), (9, ""), (None, None), (4, "solid" * 200_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    got = sorted(map(tuple, copies.near_copies(docs).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (3, 3), (None, 9), (9, 9), (None, 9), (4, 4)], key=str)
    assert copies.near_copies(docs.limit(0)).collect() == []
