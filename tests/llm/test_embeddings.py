"""Vector links and components against brute force, with hostile vectors."""

import numpy as np
import pytest

from listings_spark.llm import embeddings

DDL = "vec_id long, embedding array<float>, label int, code long"


def plain(rows, least=embeddings.COSINE):
    usable = []
    for i, (_, v, label, _) in enumerate(rows):
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
        usable.append(ok and any(x != 0 for x in v))
    unit = [np.array(r[1], dtype=np.float32).astype(float) if u else None for r, u in zip(rows, usable, strict=True)]
    unit = [None if v is None else v / np.linalg.norm(v) for v in unit]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is None or unit[j] is None or rows[i][2] != rows[j][2] or len(unit[i]) != len(unit[j]):
                continue
            if unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {
        i: (links[i], min(groups[find(i)])) for i in range(len(rows))
    }


@pytest.mark.parametrize("block", [embeddings.BLOCK, 16])
def test_whole_query(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows, at = [], 0
    for label in (0, 1, None, 2):
        for size in (1, 1, 2, 7, 40, *[1] * 60):
            centre = rng.normal(size=32)
            for _ in range(size):
                rows.append((at, (centre + rng.normal(size=32) * 0.05).tolist(), label, 5))
                at += 1
    rows += [(at + i, rows[3][1], 0, None) for i in range(30)]
    at += 30
    bad = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32]
    rows += [(at + i, v, 0, None) for i, v in enumerate(bad)]
    at += len(bad)
    rows += [(at + i, [1.0, 0.0, i / 100], 0, None) for i in range(3)]
    order = rng.permutation(len(rows))
    docs = spark.createDataFrame([rows[i] for i in order], DDL)
    got = {r["vec_id"]: r for r in embeddings.near_vectors(docs).collect()}
    wanted = plain(rows)
    assert len(got) == len(rows)
    for i, (vec, _, _, _) in enumerate(rows):
        assert (got[vec]["n_links"], got[vec]["component_id"]) == wanted[i]
        assert got[vec]["kept"] == (wanted[i][1] == vec)


def test_recall_at_the_threshold():
    """Pairs just above the threshold share a block of their codes at least nine times in ten."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.935 * base + np.sqrt(1 - 0.935**2) * side
    quantiser = embeddings.learn(base)
    apart = quantiser.codes(base) ^ quantiser.codes(near)
    met = np.zeros(len(base), dtype=bool)
    for mask in quantiser.masks():
        met |= (apart & np.uint64(mask)) == 0
    assert met.mean() >= 0.95


def test_empty_and_repeated_ids(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], DDL)).collect() == []
    rows = [(1, [1.0, 0.0], 3, 0), (1, [1.0, 0.01], 3, 0), (None, [1.0, 0.0], 3, 0), (None, None, 3, 0)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [
        (0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1)
    ]
