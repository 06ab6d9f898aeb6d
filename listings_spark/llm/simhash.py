"""SimHash fingerprints and near-duplicate groups over a Gray-order hierarchical index."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listings_spark.llm.common import stored
from listings_spark.llm.components import components

WIDTH = 4  # words in a shingle
MOST_BITS = 4  # differing bits of linked fingerprints
SEED = 42
BLOCKS = 6  # of the fingerprint; linked ones agree on BLOCKS - MOST_BITS whole blocks at least
FAN = 8  # children of an index node
SEGMENT = 1 << 19  # index entries handled at a time
SLICE = 1 << 14  # node pairs expanded at a time
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    """XXH64 of every run of `width` words, of all words if fewer, of nothing without words."""
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    starts = [0, *ends]
    return [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint for each run of `counts` hashes; zero for an empty run.

    Counts eight bits at a time in the byte lanes of 64-bit sums of at most 255 hashes.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    pieces = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = first[owner] + 255 * nth
    docs = np.cumsum(pieces) - pieces
    prints = np.zeros(len(full), dtype=np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), docs, axis=0)
        for byte in range(8):
            prints |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = prints
    return out


def _print_batches(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints, hashes, counts, held = [], [], [], 0

            def flush():
                flat = np.fromiter((h for x in hashes for h in x), dtype=np.uint64, count=held)
                prints.append(majority_bits(flat, np.array(counts, dtype=np.int64)))

            for text in texts:
                found = shingle_hashes(text.as_py() or b"", width)
                hashes.append(found)
                counts.append(len(found))
                held += len(found)
                if held > 1 << 19:
                    flush()
                    hashes, counts, held = [], [], 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(prints).view(np.int64))],
                names=["doc_id", "print"],
            )

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, print) of whole texts, as signed 64-bit numbers; null and blank texts have 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _print_batches(width), f"doc_id {kind}, print long"
    )


def block_masks(blocks: int = BLOCKS, differing: int = MOST_BITS) -> list[int]:
    """Masks of all choices of blocks that `differing` changed bits leave untouched."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - differing)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(code: Column) -> Column:
    """Position of a code in the Gray sequence, where neighbours differ by one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _merge(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Component labels after linking left to right; a label is the least index it holds."""
    while True:
        a, b = labels[left], labels[right]
        open_ = a != b
        if not open_.any():
            return labels
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            next_ = labels[labels]
            if (next_ == labels).all():
                break
            labels = next_


class GrayIndex:
    """Entries in Gray order under their keys, with the bits they share in upper nodes.

    Level 0 holds the entries. A node above covers up to FAN neighbours of one key; `ones` and
    `ever` are the bits set in all and in any of them, so the bits they share are known. Two nodes
    are compared on the bits that both share and that no level above has compared; differences
    add up on the way down, and a pair of groups over the limit is dropped as a whole.
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.ones, self.ever, self.first, self.size = [codes], [codes], [None], [None]
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            within = np.arange(len(group)) - np.repeat(
                starts, np.diff(np.concatenate([starts, [len(group)]]))
            )
            heads = np.flatnonzero(within % FAN == 0)
            self.first.append(heads)
            self.size.append(np.diff(np.concatenate([heads, [len(group)]])))
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], heads))
            self.ever.append(np.bitwise_or.reduceat(self.ever[-1], heads))
            group = group[heads]

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level the label that all entries below a node have, or -1."""
        low = high = labels
        out = [labels]
        for heads in self.first[1:]:
            low, high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            out.append(np.where(low == high, low, -1))
        return out

    def compare(self, level, a, b, spent, seen):
        """Differences so far and bits compared so far, once this level has been added."""
        ones, ever = self.ones[level], self.ever[level]
        shared = ~((ones[a] ^ ever[a]) | (ones[b] ^ ever[b]))
        new = (ones[a] ^ ones[b]) & shared & ~seen
        return spent + np.bitwise_count(new), shared

    def link(self, item: np.ndarray, labels: np.ndarray, most: int) -> np.ndarray:
        """Labels of items after linking all entries of one key within `most` bits.

        Nodes whose entries are all in one component already are not compared any more, so a
        dense group costs little more than its spanning tree.
        """
        codes, top = self.ones[0], len(self.ones) - 1
        if top == 0:
            return labels
        inner = np.ones(len(codes), dtype=bool)
        inner[0] = False
        inner[self.first[1]] = False
        step = np.flatnonzero(inner)  # neighbours in Gray order first: most links of a group
        step = step[np.bitwise_count(codes[step] ^ codes[step - 1]) <= most]
        labels = _merge(labels, item[step], item[step - 1])
        known = self.uniform(labels[item])
        roots = np.arange(len(self.ones[top]))
        zero = np.zeros(len(roots), dtype=np.uint64)
        stack = [(top, roots, roots, np.zeros(len(roots), dtype=np.uint8), zero)]
        while stack:
            level, a, b, spent, seen = stack.pop()
            if len(a) > SLICE:
                cut = SLICE
                stack.append((level, a[cut:], b[cut:], spent[cut:], seen[cut:]))
                a, b, spent, seen = a[:cut], b[:cut], spent[:cut], seen[:cut]
            same = (known[level][a] == known[level][b]) & (known[level][a] >= 0)
            a, b, spent, seen = a[~same], b[~same], spent[~same], seen[~same]
            if not len(a):
                continue
            rows, columns = self.size[level][a], self.size[level][b]
            pairs = rows * columns
            owner = np.repeat(np.arange(len(a)), pairs)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            x = self.first[level][a][owner] + nth // columns[owner]
            y = self.first[level][b][owner] + nth % columns[owner]
            keep = x <= y if level > 1 else x < y
            x, y, owner = x[keep], y[keep], owner[keep]
            spent, seen = self.compare(level - 1, x, y, spent[owner], seen[owner])
            keep = spent <= most
            x, y, spent, seen = x[keep], y[keep], spent[keep], seen[keep]
            if level > 1:
                stack.append((level - 1, x, y, spent, seen))
                continue
            if len(x):
                labels = _merge(labels, item[x], item[y])
                known = self.uniform(labels[item])
        return labels


def segment_links(group: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between codes that meet under a key, at most one for each code."""
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])))
    shared = np.repeat(sizes > 1, sizes)
    group, codes = group[shared], codes[shared]
    if not len(codes):
        return codes, codes
    distinct, item = np.unique(codes, return_inverse=True)
    labels = GrayIndex(group, codes).link(item, np.arange(len(distinct)), most)
    linked = np.flatnonzero(labels != np.arange(len(distinct)))
    return distinct[linked], distinct[labels[linked]]


def _link_batches(most: int):
    def solve(key, value, codes):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])])
        a, b = segment_links(np.cumsum(new), codes.view(np.uint64), most)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
        )

    def run(batches):
        held: list[list[np.ndarray]] = []  # batches of keys that may go on
        rows = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= SEGMENT:
                key, value, codes = (np.concatenate(x) for x in zip(*held, strict=True))
                last = np.flatnonzero((key != key[-1]) | (value != value[-1]))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield solve(key[:cut], value[:cut], codes[:cut])
                held, rows = [[key[cut:], value[cut:], codes[cut:]]], len(key) - cut
                if rows >= SEGMENT // 2:
                    rows = 0  # a key of that size: look again after another segment
        if held:
            key, value, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(key):
                yield solve(key, value, codes)

    return run


def print_links(prints: DataFrame, most: int = MOST_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that join all fingerprints within `most` bits, from distinct (node).

    `most` differing bits leave blocks - most blocks whole, so two linked fingerprints meet under
    a mask of blocks on which they agree. Each task gets whole keys in Gray order and indexes them.
    Only distinct fingerprints take part; those of one key that are not alike spread over the
    keys, and those that are alike are few by count of bit patterns, not by count of documents.
    """
    entries = F.array(*[
        F.struct(
            F.lit(k).cast("long").alias("key"),
            F.col("node").bitwiseAND(F.lit(_signed(m))).alias("value"), F.col("node").alias("code"),
        )
        for k, m in enumerate(block_masks(blocks, most))
    ])
    keyed = (
        prints.select(F.explode(entries).alias("e"))
        .select("e.*")
        .withColumn("rank", gray_rank(F.col("code")))
        .repartition("key", "value")
        .sortWithinPartitions("key", "value", "rank")
        .select("key", "value", "code")
    )
    return keyed.mapInArrow(_link_batches(most), "a long, b long")


def component_ids(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component_id): the least `least` of the nodes that links reach."""
    roots = components(links).withColumnRenamed("node", "_node")
    rooted = nodes.join(roots, F.col("node") == F.col("_node"), "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    named = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    return rooted.join(named, F.col("root") == F.col("_root")).select("node", "component_id")


def near_groups(docs: DataFrame, width: int = WIDTH, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, print, component_id): component_id is the least doc_id of a document's group.

    Fingerprints of `most` or fewer differing bits link; groups are what links reach. Texts are
    lower-cased (A-Z) and cut into words at ASCII white space. Null, empty and blank texts have
    fingerprint 0 and form one group (with any text whose fingerprint is near 0). Null ids get
    the group's least id, which is null when the group has none; repeated rows each get a row.
    Empty input: no rows. Other columns are ignored.
    """
    made = stored(fingerprints(docs, width), "prints")
    nodes = stored(
        made.groupBy(F.col("print").alias("node")).agg(F.min("doc_id").alias("least")), "nodes"
    )
    groups = component_ids(nodes, print_links(nodes, most))
    return made.join(groups, F.col("print") == F.col("node")).select("doc_id", "print", "component_id")


def hex_print(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")
