"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listings_spark.llm.common import stored
from listings_spark.llm.components import components

COSINE = 0.93
BITS = 64
TABLES = 8  # codes within TABLES - 1 bits agree on a whole block, and so meet
SAMPLE = 8192  # distinct vectors that the rotation is learned from, drawn by hash
ROUNDS = 50
BLOCK = 1024  # members of one bucket compared together


class Quantiser(NamedTuple):
    """A projection; the signs of the projected unit vector are its code."""

    axes: np.ndarray

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def masks(self) -> list[int]:
        """One mask for each table: the code's bits in blocks of near-equal width."""
        tables = min(TABLES, self.bits)
        cuts = [self.bits * t // tables for t in range(tables + 1)]
        return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        signs = _unit(vectors) @ self.axes > 0
        return signs.astype(np.uint64) @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), np.finfo(float).tiny)


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 3) -> Quantiser:
    """Principal axes, then the rotation that brings them nearest to the corners of a cube.

    Signs of the rotated coordinates and the best rotation for these signs (Procrustes) are found
    in turn, which balances the variance over the bits. Vectors are not centred: angles decide
    what links, and centring would open the angle between vectors near the mean.
    """
    unit = _unit(sample)
    _, _, axes = np.linalg.svd(unit, full_matrices=len(unit) < sample.shape[1])
    axes = axes[: min(bits, sample.shape[1])].T
    flat = unit @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))
    for _ in range(rounds):
        corners = np.where(flat @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(flat.T @ corners)
        rotation = left @ right
    return Quantiser(axes @ rotation)


def comparable(vector: str, label: str) -> Column:
    """True for vectors that can link: a label, and finite components that are not all zero."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return F.coalesce(
        F.col(label).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled with zeros up to `width`."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _code_batches(quantiser: Quantiser):
    def run(batches):
        width = len(quantiser.axes)
        for batch in batches:
            codes = quantiser.codes(_matrix(batch.column(1), width)) if batch.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes.view(np.int64))], names=["node", "code"]
            )

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    labels = np.arange(n)
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def unit_links(vectors, codes, copies, side, table: int, masks: list[int], least: float):
    """Links added to each member of one unit, and the first member of its component here.

    All members of a bucket (one block of its table equal) are ranked by the cosine of their
    vectors. A pair that an earlier table brings together as well is counted there only. With
    two sides, members of one side meet those of the other; within a side another unit does.
    """
    unit = _unit(vectors)
    if side[0] == side[-1]:
        i, j = np.nonzero(np.triu(unit @ unit.T >= least, 1))
    else:
        cut = int(np.argmax(side != side[0]))
        i, j = np.nonzero(unit[:cut] @ unit[cut:].T >= least)
        j = j + cut
    apart = codes[i] ^ codes[j]
    fresh = np.ones(len(i), dtype=bool)
    for mask in masks[:table]:
        fresh &= (apart & np.uint64(mask)) != 0
    i, j = i[fresh], j[fresh]
    added = np.bincount(i, weights=copies[j], minlength=len(codes))
    added += np.bincount(j, weights=copies[i], minlength=len(codes))
    return added.astype(np.int64), _labels(len(codes), i, j)


UNIT = ["label", "dim", "table", "value", "low", "high"]


def _unit_batches(masks: list[int], least: float):
    def solve(rows: pa.RecordBatch, width: int):
        node, copies, code, side = [rows.column(rows.schema.get_field_index(c)) for c in ("node", "copies", "code", "side")]
        vectors = _matrix(rows.column(rows.schema.get_field_index("vector")), width)
        table = rows.column(rows.schema.get_field_index("table"))[0].as_py()
        added, first = unit_links(
            vectors, code.to_numpy().view(np.uint64), copies.to_numpy(), side.to_numpy(), table, masks, least
        )
        found = np.flatnonzero(added)
        return pa.RecordBatch.from_arrays(
            [node.take(pa.array(found)), pa.array(added[found]), node.take(pa.array(first[found]))],
            names=["node", "added", "root"],
        )

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = np.stack([batch.column(batch.schema.get_field_index("unit")).to_numpy()])[0]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            start = 0
            for stop in cuts:
                if stop - start > 1:
                    part = batch.slice(start, stop - start)
                    yield solve(part, part.column(part.schema.get_field_index("dim"))[0].as_py())
                start = stop
            held = batch.slice(start)
        if held is not None and held.num_rows > 1:
            yield solve(held, held.column(held.schema.get_field_index("dim"))[0].as_py())

    return run


def near_vectors(
    rows: DataFrame, least: float = COSINE, key: str = "vec_id", vector: str = "embedding",
    label: str = "label", sample: int = SAMPLE,
) -> DataFrame:
    """One row per vector: links of cosine `least` or more within its label, and its component.

    Equal vectors of a label are one class with a count. A rotation learned from at most `sample`
    classes gives every class a code; classes meet in the tables where a block of their codes is
    equal, and original vectors decide. Buckets are cut into blocks of about BLOCK classes, and
    each pair of blocks is a unit of its own, so hot buckets spread over tasks and no pair leaves
    a task: only counts and spanning links do.

    Vectors that are null, zero or hold null or non-finite components, and vectors without a
    label, link with nothing and are kept. Vectors of different lengths do not link. Null ids
    take part; a component's id is its least id. Rows with one id count as different vectors.
    Empty input: no rows. Other columns are ignored.
    """
    given = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    node = F.concat(
        F.hex(F.xxhash64("label", "vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vector", "label"))
    )
    marked = given.withColumn("node", F.when(comparable("vector", "label"), node))
    classes = stored(
        marked.filter("node is not null")
        .groupBy("node")
        .agg(
            F.min("id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"),
            F.first("vector").alias("vector"),
        )
        .withColumn("dim", F.size("vector")),
        "classes",
    )
    width = classes.agg(F.max("dim")).first()[0] or 0
    drawn = classes.orderBy("node").select("vector").limit(sample).collect()  # bounded
    padded = np.zeros((max(1, len(drawn)), max(1, width)))
    for i, r in enumerate(drawn):
        padded[i, : len(r[0])] = r[0]
    quantiser = learn(padded)
    masks = quantiser.masks()
    codes = stored(
        classes.select("node", "vector").mapInArrow(_code_batches(quantiser), "node string, code long"), "codes"
    )
    coded = classes.join(codes, "node")
    blocks = F.array(*[F.col("code").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])
    placed = coded.select("*", F.posexplode(blocks).alias("table", "value"))
    bucket = ["label", "dim", "table", "value"]
    sizes = (
        placed.groupBy(*bucket).agg(F.count("*").alias("members")).filter("members > 1")
        .withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int"))
    )
    dealt = (
        placed.join(sizes, bucket)
        .withColumn("side", F.pmod(F.hash("node"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("low", F.least("side", "other"))
        .withColumn("high", F.greatest("side", "other"))
        .withColumn("unit", F.xxhash64(*UNIT))
        .repartition("unit")
        .sortWithinPartitions("unit", *UNIT, "side")
        .select("unit", "dim", "table", "side", "node", "copies", "code", "vector")
    )
    links = stored(
        dealt.mapInArrow(_unit_batches(masks, least), "node string, added long, root string"), "links"
    )
    added = links.groupBy("node").agg(F.sum("added").alias("added"))
    roots = components(links, "node", "root").withColumnRenamed("node", "_node")
    rooted = (
        classes.select("node", "least", "copies")
        .join(added, "node", "left")
        .join(roots, F.col("node") == F.col("_node"), "left")
        .select(
            "node", "least", F.coalesce("root", "node").alias("root"),
            (F.col("copies") - 1 + F.coalesce("added", F.lit(0))).alias("n_links"),
        )
    )
    named = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component"))
    known = rooted.join(named, F.col("root") == F.col("_root")).select(
        F.col("node").alias("_node"), "n_links", "component"
    )
    return (
        marked.select("id", "node").join(known, F.col("node") == F.col("_node"), "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
        )
        .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
    )
