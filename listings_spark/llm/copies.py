"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listings_spark.llm.common import stored
from listings_spark.llm.components import components
from listings_spark.llm.simhash import (
    SEED,
    component_ids,
    gray_rank,
    majority_bits,
    print_links,
    shingle_hashes,
)

WIDTH = 5
BANDS, ROWS = 24, 6  # a pair of similarity 0.8 shares a band in 99.93 of 100 cases
BLOCK = 1 << 10  # nodes compared at a time with one another, or with as many others
HEAVY = 1 << 10  # shingles that weigh as much as a node, so that long texts make smaller blocks
SURE = 0.66  # least agreement of least hashes, more than four deviations below similarity 0.8
TURNS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- per text --------------------------------------------------------------------------------


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """For each set that is not empty, the least of its hashes under every turn."""
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    flat = np.concatenate(sets)
    return np.stack([np.minimum.reduceat(flat * turn, starts) for turn in TURNS], axis=1)


def band_values(least: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS least hashes."""
    rows = least.reshape(len(least), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        out = (out ^ rows[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(29))
    return out


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _sets(texts) -> list[list[int]]:
    return [shingle_hashes(t.as_py() or b"", WIDTH) for t in texts]


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _profile_batches(batches):
    """Node, fingerprint, band values and sketch of every text."""
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for start in range(0, len(texts), 200):
            found = _sets(texts[start : start + 200])
            flat = np.fromiter((h for x in found for h in x), dtype=np.uint64)
            prints = majority_bits(flat, np.array([len(x) for x in found], dtype=np.int64))
            sets = [np.unique(np.array(x, dtype=np.uint64)) for x in found]
            full = [s for s in sets if len(s)]
            least = least_hashes(full) if full else np.zeros((0, len(TURNS)), dtype=np.uint64)
            bands, sketch = iter(band_values(least).view(np.int64)), iter(least.astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, len(sets)), batch.column(1).slice(start, len(sets)),
                    _signed([_node(s) for s in sets]), _signed(prints),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([next(bands) if len(s) else [] for s in sets], type=pa.list_(pa.int64())),
                    pa.array([next(sketch).tobytes() if len(s) else b"" for s in sets], type=pa.binary()),
                ],
                names=["doc_id", "row", "node", "print", "size", "bands", "sketch"],
            )


def _set_batches(batches):
    """The sets themselves, with whatever stands beside the text."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        for start in range(0, len(texts), 200):
            sets = [np.unique(np.array(x, dtype=np.uint64)) for x in _sets(texts[start : start + 200])]
            yield pa.RecordBatch.from_arrays(
                [*[c.slice(start, len(sets)) for c in batch.columns[:-1]],
                 pa.array([s.tobytes() for s in sets], type=pa.binary())],
                names=[*batch.schema.names[:-1], "shingles"],
            )


# --- exact decisions inside a task --------------------------------------------------------------


def spanning_links(labels: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join what all pairs of similarity 0.8 join, at most one for each member.

    Decided by the sizes of intersections, from an index of the shingles that members share. Pairs
    of one label are joined already and are not compared; labels merge with every link, so a
    dense group costs little more than its first member's row. With sides, only pairs of side 0
    with side 1 count.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    member = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    order = np.argsort(flat, kind="stable")
    _, number, often = np.unique(flat, return_inverse=True, return_counts=True)
    first = np.concatenate([[0], np.cumsum(often)])
    holders = member[order]  # by number of the shingle
    at = np.concatenate([[0], np.cumsum(size)])
    labels = np.unique(labels, return_inverse=True)[1]
    links = []
    for i in range(len(sets)):
        open_ = labels != labels[i]
        if side is None:
            open_[:i] = False
        else:
            open_ &= side != side[i]
            if side[i]:
                continue
        open_ &= (5 * size >= 4 * size[i]) & (4 * size <= 5 * size[i])
        if not open_.any():
            continue
        own = number[at[i] : at[i + 1]]
        own = own[often[own] > 1]
        runs = often[own]
        places = np.repeat(first[own] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        shared = np.bincount(holders[places], minlength=len(sets))
        for j in np.flatnonzero(open_ & (9 * shared >= 4 * (size + size[i]))).tolist():
            if labels[j] != labels[i]:
                links.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return links


def _links(node: list[int], found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([node[i] for i, _ in found], type=pa.int64()), pa.array([node[j] for _, j in found], type=pa.int64())],
        names=["a", "b"],
    )


def _numbers(shingles: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(s, dtype=np.uint64) for s in shingles]


def _runs(batches, most: int = BLOCK):
    """Rows of one key (the first two columns) at a time, cut once they weigh as much as a block."""
    held: list[tuple] = []
    weight = 0.0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and (row[:2] != held[0][:2] or weight >= most):
                yield held
                held, weight = [], 0.0
            held.append(row)
            weight += 1 + len(row[-1]) / 8 / HEAVY
    if held:
        yield held


def _block_batches(batches):
    for held in _runs(batches):
        if len(held) > 1:
            node, sets = [r[2] for r in held], _numbers([r[3] for r in held])
            yield _links(node, spanning_links(np.array(node), sets))


def _unit_batches(batches):
    """The members of a unit that have a partner of another label there, by their sketches.

    A pair counts only under the first band that it shares, so that it is decided once.
    """

    def flagged(held):
        value = held[0][1]
        node, label, side = (np.array([r[k] for r in held], dtype=np.int64) for k in (2, 3, 4))
        bands = np.array([r[5] for r in held], dtype=np.int64)
        sketch = np.frombuffer(b"".join(r[6] for r in held), dtype=np.uint8).reshape(len(held), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        crossed = bool(len(right))
        right = right if crossed else left
        needed = np.zeros(len(held), dtype=bool)
        for start in range(0, len(left), 32):
            x = left[start : start + 32]
            y = right if crossed else right[start:]
            open_ = label[x][:, None] != label[y][None, :]
            if not open_.any():
                continue
            agree = (sketch[x][:, None, :] == sketch[y][None, :, :]).sum(axis=2, dtype=np.uint8)
            i, j = np.nonzero(open_ & (agree >= SURE * len(TURNS)))
            i, j = x[i], y[j]
            for cut in range(0, len(i), 1 << 16):
                a, b = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
                here = bands[a, (bands[a] == bands[b]).argmax(axis=1)] == value
                needed[a[here]] = needed[b[here]] = True
        at = np.flatnonzero(needed)
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0][0]] * len(at), type=pa.int64()), pa.array(node[at]), pa.array(label[at]), pa.array(side[at])],
            names=["unit", "node", "label", "side"],
        )

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[:2] != held[0][:2]:
                yield flagged(held)
                held = []
            held.append(row)
    if held:
        yield flagged(held)


def _decide_batches(batches):
    def solve(held):
        node = [r[1] for r in held]
        label, side = (np.array([r[k] for r in held], dtype=np.int64) for k in (2, 3))
        return _links(node, spanning_links(label, _numbers([r[4] for r in held]), side if side.any() else None))

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[0] != held[0][0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


# --- candidates ----------------------------------------------------------------------------------


def units(met: DataFrame, most: int = BLOCK) -> DataFrame:
    """(unit, value, node, label, side): pairs of blocks that hold every pair of different labels of a value.

    From (value, node, label, weight). A label that weighs more than half of `most` under a value
    has blocks of its own there, which never meet each other; the other labels share blocks of about
    `most`. Blocks are pairs of hashes, so no task gets a whole common value.
    """
    counts = stored(
        met.groupBy(F.col("value").alias("_value"), F.col("label").alias("_label")).agg(F.sum("weight").alias("n")),
        "counts",
    )
    small = counts.filter(F.col("n") * 2 <= most)
    pools = small.groupBy(F.col("_value").alias("_pool")).agg(
        F.ceil(F.sum("n") / most).cast("long").alias("parts")
    )
    pooled = small.join(pools, F.col("_value") == F.col("_pool")).select(
        "_value", "_label", F.lit(0).cast("long").alias("own"), "parts",
        F.pmod(F.xxhash64("_label"), "parts").alias("part"),
    )
    alone = counts.filter(F.col("n") * 2 > most).select(
        "_value", "_label", F.lit(1).cast("long").alias("own"), F.ceil(F.col("n") / most).cast("long").alias("parts"),
        F.lit(None).cast("long").alias("part"),
    )
    placed = stored(pooled.union(alone), "placed")
    kind = F.when(F.col("own") == 1, F.col("_label"))  # the label that owns a block
    whole = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    blocks = stored(
        placed.select(
            "_value", kind.alias("owner"),
            F.explode(F.when(F.col("own") == 1, whole).otherwise(F.array("part"))).alias("part"),
        ).distinct().withColumn("block", F.xxhash64("_value", F.coalesce("owner", F.lit(0)), F.col("owner").isNull(), "part")),
        "blocks",
    )
    x, y = (
        blocks.select(*[F.col(c).alias(f"{c}{k}") for c in ("_value", "owner", "block")]) for k in (0, 1)
    )
    met_blocks = x.join(y, F.col("_value0") == F.col("_value1")).filter(
        "block0 < block1 and (owner0 is null or owner1 is null or owner0 <> owner1) or block0 = block1 and owner0 is null"
    ).withColumn("unit", F.xxhash64("block0", "block1"))
    sides = stored(
        met_blocks.select(
            "unit", F.explode(F.when(F.col("block0") == F.col("block1"), F.array(F.struct(F.lit(0).alias("side"), F.col("block0").alias("_block"))))
            .otherwise(F.array(
                F.struct(F.lit(0).alias("side"), F.col("block0").alias("_block")),
                F.struct(F.lit(1).alias("side"), F.col("block1").alias("_block")),
            ))).alias("s"),
        ).select("unit", "s.*"),
        "sides",
    )
    entries = met.join(placed, (F.col("value") == F.col("_value")) & (F.col("label") == F.col("_label"))).select(
        "value", "node", "label",
        F.xxhash64(
            F.col("value"), F.coalesce(kind, F.lit(0)), kind.isNull(),
            F.coalesce("part", F.pmod(F.xxhash64("node"), "parts")),
        ).alias("block"),
    )
    return entries.join(sides, F.col("block") == F.col("_block")).select("unit", "value", "node", "label", "side")


def _shared_bands(made: DataFrame) -> DataFrame:
    """(value, node): the band values that different nodes share."""
    entries = made.select(F.explode("bands").alias("value"), "node")
    common = (
        entries.groupBy(F.col("value").alias("_value"))
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .filter("low < high").select("_value")
    )
    return entries.join(common, F.col("value") == F.col("_value")).select("value", "node").distinct()


def _print_groups(nodes: DataFrame) -> DataFrame:
    """(node, group, rank): the fingerprint groups of more than one node, in Gray order."""
    prints = stored(nodes.select(F.col("print").alias("node")).distinct(), "prints")
    roots = components(print_links(prints)).select(F.col("node").alias("_print"), "root")
    grouped = stored(
        nodes.join(roots, F.col("print") == F.col("_print"), "left").select(
            "node", F.coalesce("root", "print").alias("group"), gray_rank(F.col("print")).alias("rank")
        ),
        "grouped",
    )
    several = grouped.groupBy(F.col("group").alias("_group")).agg(
        F.min("node").alias("low"), F.max("node").alias("high")
    ).filter("low < high").select("_group")
    return grouped.join(several, F.col("group") == F.col("_group")).select("node", "group", "rank")


def _first_links(sets: DataFrame) -> DataFrame:
    """Links inside blocks of each fingerprint group, and of each node's most common band.

    Blocks are pieces of the whole order, so a large group spreads over tasks; the two orders cut it
    at different places, and their links together join what each has cut.
    """
    ways = F.array(
        F.struct(F.lit(0).alias("way"), F.col("group").alias("unit"), F.col("rank").alias("order")),
        F.struct(F.lit(1).alias("way"), F.col("value").alias("unit"), F.xxhash64("node").alias("order")),
    )
    order = ["way", "unit", "order", "node"]
    return (
        sets.select(F.explode(ways).alias("w"), "node", "shingles")
        .filter("w.unit is not null")
        .select("w.*", "node", "shingles")
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .select("way", "unit", "node", "shingles")
        .mapInArrow(_block_batches, "a long, b long")
    )


def _rest_links(made: DataFrame, met: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """Links between nodes that share a band and that the links so far have not joined."""
    roots = components(links).withColumnRenamed("node", "_node")
    weights = sets.select(F.col("node").alias("_n"), (1 + F.octet_length("shingles") / (8.0 * HEAVY)).alias("weight"))
    labels = stored(
        weights.join(roots, F.col("_n") == F.col("_node"), "left").select(
            "_n", "weight", F.coalesce("root", "_n").alias("label")
        ),
        "labels",
    )
    labelled = stored(met.join(labels, F.col("node") == F.col("_n")).select("value", "node", "label", "weight"), "labelled")
    mixed = (
        labelled.groupBy(F.col("value").alias("_value"))
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low < high").select("_value")
    )
    open_ = stored(labelled.join(mixed, F.col("value") == F.col("_value")).drop("_value"), "open")
    ends = open_.select(F.col("node").alias("_n")).distinct()
    sketches = stored(
        made.join(ends, F.col("node") == F.col("_n"), "left_semi")
        .groupBy(F.col("node").alias("_n")).agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "sketches",
    )
    asked = stored(
        units(open_).join(sketches, F.col("node") == F.col("_n"))
        .select("unit", "value", "node", "label", "side", "bands", "sketch")
        .repartition("unit", "value").sortWithinPartitions("unit", "value")
        .mapInArrow(_unit_batches, "unit long, node long, label long, side long"),
        "asked",
    )
    contents = sets.select(F.col("node").alias("_n"), "shingles")
    return (
        asked.join(contents, F.col("node") == F.col("_n"))
        .select("unit", "node", "label", "side", "shingles")
        .repartition("unit").sortWithinPartitions("unit")
        .mapInArrow(_decide_batches, "a long, b long")
    )


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of near copies: sets of five-word shingles of similarity 0.8 or more.

    Equal sets make one node. Nodes meet in groups of near SimHash fingerprints (`print_links`)
    and under bands of least hashes; the exact Jaccard similarity of their sets decides, inside
    tasks that hold blocks of bounded weight, and only spanning links leave a task. First each node
    is compared in a block of its fingerprint group and of its most common band, which joins large
    groups; then all pairs of a band that links have not joined, unless 144 least hashes put them
    far below 0.8. Sets are made for nodes that meet another one only.

    `doc_id` may be any orderable column; component_id is the least of a group, null if it has none but nulls.
    Null, empty and blank texts are one group; texts under five words are one shingle; a text of any
    length is one set. Null and repeated ids: one row per row. Empty input: no rows. Other columns
    are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    made = stored(
        keyed.mapInArrow(
            _profile_batches,
            f"doc_id {kind}, row long, node long, print long, size long, bands array<long>, sketch binary",
        ),
        "profiles",
    )
    nodes = stored(
        made.groupBy("node").agg(
            F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row"))["row"].alias("row"),
            F.min("print").alias("print"),
        ),
        "nodes",
    )
    met = stored(_shared_bands(made), "met")
    sizes = met.groupBy(F.col("value").alias("_value")).agg(F.count("*").alias("n"))
    largest = (
        met.join(sizes, F.col("value") == F.col("_value"))
        .groupBy("node").agg(F.max(F.struct("n", "value"))["value"].alias("value"))
    )
    places = _print_groups(nodes).join(largest, "node", "full")
    wanted = stored(
        nodes.select("node", "row").join(places, "node").select(
            F.col("row").alias("_row"), "node", "group", "rank", "value"
        ),
        "wanted",
    )
    sets = stored(
        keyed.join(wanted, F.col("row") == F.col("_row"))
        .dropDuplicates(["row"])
        .select("node", "group", "rank", "value", "text")
        .mapInArrow(_set_batches, "node long, group long, rank long, value long, shingles binary"),
        "sets",
    )
    first = stored(_first_links(sets), "links")
    links = stored(first.union(_rest_links(made, met, sets, first)), "links")
    return made.select("doc_id", "node").join(
        component_ids(nodes.select("node", "least"), links), "node"
    ).select("doc_id", "component_id")
