"""Whitening of vectors: blockwise QR, bidiagonal form, dqds and twisted factorisations."""

from __future__ import annotations

from collections.abc import Callable
from math import fsum, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listings_spark.llm.common import stored

COMPONENTS = 32
FAN = 16  # blocks put together in one task of a round
EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
GAP = 1e-3  # relative distance of eigenvalues whose vectors are made orthogonal explicitly


# --- the solver: small matrices, as wide as a vector is long ---------------------------------


def _reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, alpha): x less 2 v (v.x) is alpha in its first place and zero elsewhere."""
    scale = np.abs(x).max(initial=0.0)
    if not scale or not np.abs(x[1:]).max(initial=0.0):
        return np.zeros_like(x), float(x[0])
    alpha = -np.copysign(scale * np.linalg.norm(x / scale), x[0])
    v = x.copy()
    v[0] -= alpha
    v /= np.abs(v).max()
    return v / np.linalg.norm(v), alpha


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, above, right): r is orthogonal times a bidiagonal matrix times right transposed."""
    a, n = r.copy(), r.shape[1]
    right, above = np.eye(n), np.zeros(max(n - 1, 0))
    diagonal = np.zeros(n)
    for k in range(n):
        v, diagonal[k] = _reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            v, above[k] = _reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return diagonal, above, right


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential quotient-difference step: the qd arrays of the shifted matrix, least d."""
    d = least = q[0] - shift
    new_q, new_e = [], []
    for k in range(len(e)):
        pivot = d + e[k]
        ratio = q[k + 1] / pivot if pivot else 0.0
        new_q.append(pivot)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        least = min(least, d)
    return [*new_q, d], new_e, least


def dqds(diagonal: np.ndarray, above: np.ndarray) -> list[float]:
    """Squared singular values of a bidiagonal matrix, falling, each to high relative accuracy."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not scale:
        return [0.0] * len(diagonal)
    found: list[float] = []
    work = [([float(x / scale) ** 2 for x in diagonal], [float(x / scale) ** 2 for x in above], 0.0)]
    close = (10 * EPS) ** 2
    while work:
        q, e, base = work.pop()
        if len(q) > 1 and 1.5 * q[0] < q[-1]:
            q, e = q[::-1], e[::-1]  # the same values; small ones leave sooner at the end
        while len(q) > 1:
            cut = next((k for k in range(len(e)) if e[k] <= close * (base + min(q[k], q[k + 1]))), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], base))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # The least eigenvalue of the last two rows bounds the least one from above.
            a, b = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1]
            middle, off = (a + b) / 2, sqrt(((a - b) / 2) ** 2 + q[-2] * e[-1])
            least = max(0.0, (a * b - q[-2] * e[-1]) / (middle + off)) if middle + off else 0.0
            shift = least * (1 - 1e-6)
            for _ in range(8):
                new_q, new_e, low = _transform(q, e, shift)
                if low >= 0:
                    break
                shift = shift / 4 if shift > EPS * base else 0.0
            else:
                shift = 0.0
                new_q, new_e, _ = _transform(q, e, 0.0)
            q, e, base = new_q, new_e, base + shift
        found.append(base + q[0])
    return [x * scale * scale for x in sorted(found, reverse=True)]


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of the squared bidiagonal matrix for one of its eigenvalues.

    Stationary steps from the top and progressive steps from the bottom meet where what is left
    over is least; from there two recurrences give the vector without a linear system.
    """
    n = len(diagonal)
    floor = max(TINY, float(np.abs(diagonal).max()) * 1e-150)
    base = np.where(np.abs(diagonal) < floor, floor, diagonal)
    d, low = base**2, above / base[:-1]
    down, s, lower = np.zeros(n), np.zeros(n), np.zeros(max(n - 1, 0))
    s[0] = -value
    for k in range(n - 1):
        down[k] = s[k] + d[k] or TINY
        lower[k] = d[k] * low[k] / down[k]
        s[k + 1] = lower[k] * low[k] * s[k] - value
    p, upper = np.zeros(n), np.zeros(max(n - 1, 0))
    p[n - 1] = d[n - 1] - value
    for k in range(n - 2, -1, -1):
        up = d[k] * low[k] ** 2 + p[k + 1] or TINY
        upper[k] = low[k] * d[k] / up
        p[k] = p[k + 1] * d[k] / up - value
    at = int(np.nanargmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -lower[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -upper[k] * z[k]
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def _orthogonal(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            z = z - other * (other @ z)
    return z


def _block_vectors(diagonal: np.ndarray, above: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(squared singular value, vector) of one bidiagonal block, vectors orthogonal to one another."""
    values, out = dqds(diagonal, above), []
    n, rng = len(diagonal), np.random.default_rng(5)
    for k, value in enumerate(values):
        near = [v for x, v in out if x - value <= GAP * max(x, TINY) or value <= EPS * values[0]]
        z = _orthogonal(twisted(diagonal, above, value) if np.isfinite(value) else np.zeros(n), near)
        if not np.linalg.norm(z) > 0.5:  # a tight cluster gave the same vector again: inverse steps
            square = np.diag(diagonal**2 + np.concatenate([[0.0], above**2]))
            square += np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
            shifted = square - (value + 4 * EPS * max(values[0], TINY)) * np.eye(n)
            z = _orthogonal(rng.standard_normal(n), near)
            for _ in range(4):
                z = np.linalg.solve(shifted, z / np.linalg.norm(z))
                z = _orthogonal(z / np.linalg.norm(z), near)
            z = _orthogonal(z / np.linalg.norm(z), near)
        out.append((value, z / np.linalg.norm(z)))
    return out


class Components(NamedTuple):
    values: np.ndarray  # squared singular values, falling
    axes: np.ndarray  # a column for each


def right_singular(r: np.ndarray) -> Components:
    """All squared singular values of a square matrix with their right singular vectors."""
    n = r.shape[1]
    diagonal, above, right = bidiagonal(r)
    size = np.abs(diagonal)
    split = np.flatnonzero(np.abs(above) <= EPS * (size[:-1] + size[1:]) * 0.01) + 1
    found = []
    for start, end in zip([0, *split], [*split, n], strict=True):
        for value, z in _block_vectors(diagonal[start:end], above[start : end - 1]):
            whole = np.zeros(n)
            whole[start:end] = z
            found.append((value, whole))
    found.sort(key=lambda pair: -pair[0])
    return Components(np.array([v for v, _ in found]), right @ np.column_stack([z for _, z in found]))


# --- the passes over the vectors ---------------------------------------------------------------


def _levels(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 64) + 1_000_000)


def fit_list(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of vectors that are not null, of the longest length, with finite entries only."""
    c = F.col("embedding")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = vectors.filter(c.isNotNull() & ~bad & (F.size(c) > 0))
    length = usable.agg(F.max(F.size(c))).first()[0]
    return usable.filter(F.size(c) == F.lit(length)).select("vec_id", _levels(c).alias("x"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the fit list and exact sums by dimension, added up in tasks first."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch, 0).sum(axis=0)
                n, total = n + batch.num_rows, part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), type=pa.int32()), pa.array([n] * len(total)), pa.array(total)],
                names=["at", "n", "s"],
            )

    parts = fit.select("x").mapInArrow(run, "at int, n long, s long")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    return (rows[0]["n"], [r["s"] for r in rows]) if rows else (0, [])  # one row per dimension


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x less the sums, exact: as 64-bit numbers where these suffice, else as Python's."""
    wide = n * (int(np.abs(x).max(initial=0)) + max(map(abs, sums))) >= 1 << 62
    return n * x.astype(object if wide else np.int64) - np.array(sums, dtype=object if wide else np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less the mean, rounded once."""
    return _scaled(x, n, sums).astype(float) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums of squares of n x less the sums, exact."""
    rows = _scaled(x, n, sums)
    if rows.dtype != object and int(np.abs(rows).max(initial=0)) ** 2 * rows.shape[1] >= 1 << 63:
        rows = rows.astype(object)
    return [int(v) for v in (rows * rows).sum(axis=1)]


def _blocks(fit: DataFrame, reduce: Callable, start, write: Callable) -> DataFrame:
    """(id, block): what a task's batches reduce to, one row a task."""

    def run(batches):
        held = start
        for batch in batches:
            if batch.num_rows:
                held = reduce(held, _matrix(batch, 0))
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], type=pa.int64()), pa.array([write(held)], type=pa.binary())],
                names=["id", "block"],
            )

    return fit.select("x").mapInArrow(run, "id long, block binary")


def _tree(blocks: DataFrame, join: Callable[[list[bytes]], bytes]) -> bytes:
    """One block from many, in rounds of FAN together; a block is as large as a matrix of the vectors' width."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("id").to_pylist(), group.column("block").to_pylist(), strict=True))
        return pa.table({
            "id": pa.array([rows[0][0] // FAN], type=pa.int64()),
            "block": pa.array([join([b for _, b in rows])], type=pa.binary()),
        })

    blocks = stored(blocks, "blocks")
    last = blocks.agg(F.max("id")).first()[0]
    while last:
        blocks = stored(
            blocks.groupBy(F.floor(F.col("id") / FAN)).applyInArrow(run, "id long, block binary"), "blocks"
        )
        last //= FAN
    return blocks.first()["block"]


def _square(block: bytes, width: int) -> np.ndarray:
    return np.frombuffer(block).reshape(-1, width)


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: QR of each batch under the R so far, then of the tasks' R in rounds."""
    width = len(sums)

    def reduce(held, x):
        rows = centred(x, n, sums)
        return np.linalg.qr(rows if held is None else np.vstack([held, rows]), mode="r")

    def join(parts: list[bytes]) -> bytes:
        return np.linalg.qr(np.vstack([_square(b, width) for b in parts]), mode="r").tobytes()

    r = _square(_tree(_blocks(fit, reduce, None, np.ndarray.tobytes), join), width)
    return np.vstack([r, np.zeros((width - len(r), width))])


def _moments(held, y: np.ndarray):
    """(count, mean, centred products) of rows put together with those held."""
    mean = y.mean(axis=0)
    new = (len(y), mean, (y - mean).T @ (y - mean))
    return new if held is None else _together(held, new)


def _together(a, b):
    n, apart = a[0] + b[0], b[1] - a[1]
    mean = a[1] + apart * (b[0] / n)
    return n, mean, a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def identity_error(fit: DataFrame, n: int, sums: list[int], directions: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k = directions.shape[1]

    def write(held) -> bytes:
        return np.concatenate([[float(held[0])], held[1], held[2].ravel()]).tobytes()

    def read(block: bytes):
        flat = np.frombuffer(block)
        return flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k)

    def join(parts: list[bytes]) -> bytes:
        held = read(parts[0])
        for part in parts[1:]:
            held = _together(held, read(part))
        return write(held)

    made = _blocks(fit, lambda held, x: _moments(held, centred(x, n, sums) @ directions), None, write)
    return float(np.abs(read(_tree(made, join))[2] / n - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Coordinates of every vector along the leading principal axes, each of unit variance.

    Entries c become whole numbers floor(64 c) + 1 000 000; the fit list is all remaining vectors.
    The centred rows are reduced to a triangle R by blockwise QR, Householder reflections make R
    bidiagonal, dqds finds its singular values and twisted factorisations the directions. Only
    sums and matrices as wide as a vector leave the tasks.

    Vectors that are null, empty, shorter than the longest, or hold null or non-finite entries are
    left out. Axes without variance are left out, so equal vectors give no rows. Null and
    repeated ids: one set of rows per row. Empty input: no rows. Other columns are ignored.
    Columns: vec_id, component (from 1), n, deviation (exact; beyond 64 bits an error), whitened,
    explained, identity_error.
    """
    fit = fit_list(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    shape = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    n, sums = _sums(fit)
    found = right_singular(triangle(fit, n, sums)) if n else Components(np.zeros(0), np.zeros((0, 0)))
    seen = int((found.values > found.values.max(initial=0.0) * (len(sums) * EPS) ** 2).sum())
    k = min(most, seen)
    if not k:
        return vectors.sparkSession.createDataFrame([], shape)
    values = found.values[:k] / n
    directions = found.axes[:, :k] / np.sqrt(values)
    explained = found.values[:k] / fsum(found.values)
    error = identity_error(fit, n, sums, directions)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x, rows = _matrix(part, 1), part.num_rows
                again = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, n)),
                        pa.array(deviations(x, n, sums), type=pa.int64()).take(again),
                        pa.array((centred(x, n, sums) @ directions).ravel()),
                        pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return fit.mapInArrow(run, shape)
