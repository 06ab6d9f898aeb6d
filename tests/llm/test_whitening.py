"""Whitening against a dense eigensolver, exact sums against Python's whole numbers."""

import math

import numpy as np
import pytest

from listings_spark.llm import whitening
from listings_spark.llm.queries import op12_whitening

RNG = np.random.default_rng(0)
Q = np.linalg.qr(RNG.standard_normal((40, 40)))[0]
MATRICES = {
    "plain": RNG.standard_normal((300, 40)),
    "graded": RNG.standard_normal((300, 40)) * 10.0 ** (-np.arange(40) / 4),
    "deficient": RNG.standard_normal((15, 40)),
    "identity": np.eye(40),
    "clusters": np.diag(np.r_[np.full(15, 3.0), np.full(15, 3 + 1e-9), np.full(10, 1e-4)]) @ Q,
    "glued": 2 * np.diag([float(abs(i - 20)) for i in range(40)]) + np.diag(np.ones(39), 1) + np.diag(np.ones(39), -1),
    "one rank": np.ones((30, 8)),
    "one column": RNG.standard_normal((30, 1)),
    "two columns": RNG.standard_normal((30, 2)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_values_and_vectors(name):
    a = MATRICES[name]
    width = a.shape[1]
    r = np.linalg.qr(a, mode="r")
    found = whitening.right_singular(np.vstack([r, np.zeros((width - len(r), width))]))
    true = np.zeros(width)
    singular = np.linalg.svd(a, compute_uv=False)
    true[: len(singular)] = singular**2
    assert np.abs(found.values - true).max() <= 1e-13 * true[0]
    assert np.abs(found.axes.T @ found.axes - np.eye(width)).max() < 1e-10
    assert np.abs(a.T @ (a @ found.axes) - found.axes * found.values).max() <= 1e-11 * true[0]


def test_small_singular_values_are_relatively_accurate():
    diagonal = 10.0 ** (-np.arange(30) / 2.0)
    above = diagonal[:-1] * 0.5
    found = whitening.dqds(diagonal, above)
    product = math.prod(float(x) for x in diagonal)
    assert math.sqrt(math.prod(found)) == pytest.approx(product, rel=1e-12)
    assert found == sorted(found, reverse=True)


def expected(rows):
    """Brute force with whole numbers and a dense solver."""
    longest = max((len(v) for _, v in rows if v and all(c is not None and math.isfinite(c) for c in v)), default=0)
    kept = [(i, v) for i, v in rows if v and len(v) == longest and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    apart = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(apart.T @ apart / n)
    order = np.argsort(-values)
    return [i for i, _ in kept], n, dev, apart, values[order], axes[:, order]


def check(rows, found, most=32):
    ids, n, dev, apart, values, axes = expected(rows)
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    assert len(found) == len(ids) * k
    made = {}
    for r in found:
        made.setdefault(r["vec_id"], {})[r["component"]] = r
    for nth, i in enumerate(ids):
        row = made[i]
        assert {r["n"] for r in row.values()} == {n} and {r["deviation"] for r in row.values()} == {dev[nth]}
    for c in range(1, k + 1):
        mine = np.array([made[i][c]["whitened"] for i in ids])
        true = apart @ axes[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(mine - true).max(), np.abs(mine + true).max()) < 1e-7
        assert made[ids[0]][c]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    assert found[0]["identity_error"] < 1e-9


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(rows, op12_whitening(spark, folder).collect())


def test_many_tasks_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(0, [1, 5, 2, 9, 3])]) for i in range(900)]
    odd = [(-1, None), (-2, []), (-3, [1.0, None, 2.0, 3.0, 4.0]), (-4, [float("nan")] * 5), (-5, [1.0, float("inf"), 0.0, 0.0, 0.0]), (-6, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, n string")
    found = whitening.whiten(frame.repartition(40)).collect()
    check(rows, found)
    assert {r["component"] for r in found} == {1, 2, 3, 4, 5}


def test_repeats_nulls_and_no_variance(spark):
    shape = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 5, shape)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0])], shape)
    found = whitening.whiten(twice).collect()
    assert len(found) == 3 and {r["component"] for r in found} == {1}
    assert sorted(round(abs(r["whitened"]), 9) for r in found) == sorted([round(0.5**0.5, 9)] * 2 + [round(2**0.5, 9)])


def test_deviations_beyond_64_bits_on_the_way():
    x = np.array([[1_000_000 + 10**7, 1_000_000], [1_000_000 - 10**7, 1_000_000]])
    n, sums = 2, [2_000_000, 2_000_000]
    assert whitening.deviations(x, n, sums) == [4 * 10**14] * 2
    assert whitening.deviations(x * 10**6, 10**4, [0, 0])[0] == sum((10**10 * int(v)) ** 2 for v in x[0])
