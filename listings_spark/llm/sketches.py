"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listings_spark.llm.common import stored, whole

# A paragraph is a line, cut further behind clause marks and after 32 bytes, since many texts are
# a single short line. The pieces cover the whole text.
PARAGRAPH = re.compile(rb"[^\n.!?,;:]{1,32}[\n.!?,;:]*|[\n.!?,;:]+")
TABLES = 3  # cells of each digest, one in each table
FIRST = 4  # log2 of cells a table in the first attempt
PRINTED = 2  # log2 of cells a table in the printed fingerprint
TOGETHER = 1 << 17  # digests sketched at a time
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
CHECK = np.uint64(0xD6E8FEB86659FD93)


def digests(text: bytes) -> np.ndarray:
    """Distinct digests of the paragraphs; a paragraph's second, third, ... copy has its own."""
    pieces = PARAGRAPH.findall(text)
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), dtype=np.uint64, count=len(pieces))
    if len(set(pieces)) == len(pieces):
        return found
    seen: Counter = Counter()
    copies = np.zeros(len(pieces), dtype=np.uint64)
    for i, p in enumerate(pieces):
        copies[i] = seen[p]
        seen[p] += 1
    return found + copies * CHECK


def _check(keys: np.ndarray) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * CHECK
    return mixed ^ (mixed >> np.uint64(29))


class Sketches:
    """Cells (count, sum of digests, sum of their checks) of many documents side by side.

    Sums wrap, so that sketches subtract. `log` is each document's log2 of cells a table.
    """

    def __init__(self, log: np.ndarray):
        self.log = log.astype(np.int64)
        sizes = TABLES << self.log
        self.start = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(log)), sizes)
        n = int(sizes.sum())
        self.count = np.zeros(n, dtype=np.int64)
        self.key = np.zeros(n, dtype=np.uint64)
        self.check = np.zeros(n, dtype=np.uint64)

    def cells(self, keys: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
        log = self.log[owner]
        shift = (64 - log).astype(np.uint64)
        return [
            self.start[owner] + (t << log) + ((keys * SPREAD[t]) >> shift).astype(np.int64)
            for t in range(TABLES)
        ]

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> np.ndarray:
        times = np.broadcast_to(np.asarray(sign, dtype=np.int64), keys.shape)
        wide = times.astype(np.uint64)  # -1 wraps
        touched = self.cells(keys, owner)
        for at in touched:
            np.add.at(self.count, at, times)
            np.add.at(self.key, at, keys * wide)
            np.add.at(self.check, at, _check(keys) * wide)
        return np.concatenate(touched)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.log)
        out.count, out.key, out.check = (
            self.count - other.count, self.key - other.key, self.check - other.check
        )
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Digests recovered for each document, and whether its difference is recovered whole.

        A cell of count 1 or -1 whose check fits holds one digest of one side; taking it out of
        its other cells lays open more, until nothing is left or no cell is pure.
        """
        found = np.zeros(len(self.log), dtype=np.int64)
        look = np.arange(len(self.count))
        while len(look):
            look = look[np.abs(self.count[look]) == 1]
            sign = self.count[look]
            wide = sign.astype(np.uint64)
            keys = self.key[look] * wide
            fits = _check(keys) == self.check[look] * wide
            keys, sign, owner = keys[fits], sign[fits], self.owner[look[fits]]
            if not len(keys):
                break
            order = np.lexsort((keys, owner))
            keys, sign, owner = keys[order], sign[order], owner[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
            keys, sign, owner = keys[new], sign[new], owner[new]
            np.add.at(found, owner, 1)
            look = np.unique(self.add(keys, owner, -sign))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return found, ~np.logical_or.reduceat(left, self.start)

    def printed(self) -> list[str]:
        cells = np.empty((len(self.count), 10), dtype=np.uint8)
        cells[:, :2] = (self.count % (1 << 16)).astype(">u2").view(np.uint8).reshape(-1, 2)
        cells[:, 2:] = self.key.astype(">u8").view(np.uint8).reshape(-1, 8)
        sizes = TABLES << self.log
        return [cells[s : s + n].tobytes().hex() for s, n in zip(self.start, sizes, strict=True)]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), owner


def sketch(sets: list[np.ndarray], log: np.ndarray) -> Sketches:
    out = Sketches(log)
    out.add(*_flat(sets))
    return out


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many digests stand on one side only, for each pair of sets.

    The sketches of a pair subtract, which leaves the digests that differ; peeling recovers them.
    A pair whose peeling fails is tried again with larger sketches: at least double, and as
    many cells as the counts left in the cells suggest (their squares add up to about one for
    each cell of each differing digest, and no more digests can differ than both sides have).
    Only two equal digests in one document can keep a roomy sketch from peeling; such a pair is
    counted from the digests themselves.
    """
    out = np.zeros(len(left), dtype=np.int64)
    todo = np.arange(len(left))
    log = np.full(len(left), FIRST)
    while len(todo):
        a, b = [left[i] for i in todo], [right[i] for i in todo]
        gap = sketch(a, log).minus(sketch(b, log))
        total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
        guess = np.minimum(np.add.reduceat(gap.count * gap.count, gap.start) / TABLES, total)
        found, done = gap.peel()
        out[todo[done]] = found[done]
        needed = np.ceil(np.log2(np.maximum(1.0, 0.5 * guess + 4))).astype(np.int64)
        stuck = ~done & (log > np.log2(total + 1) + 3)
        for i in np.flatnonzero(stuck):
            out[todo[i]] = len(np.setxor1d(a[i], b[i]))
        again = ~done & ~stuck
        log, todo = np.maximum(log + 1, needed)[again], todo[again]
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Share of digests in common, of both sides together; 1 for two empty sides."""
    total = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)])
    gap = differences(left, right)
    return np.where(total > 0, (total - gap) / np.maximum(total, 1), 1.0)


class Document(NamedTuple):
    doc_id: object
    text: str
    keys: np.ndarray


RESULT = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def _compared(pairs: list[tuple[Document, Document]]) -> list[list]:
    """The result columns for documents with their next ones."""
    texts = []
    for one, after in pairs:
        half = len(one.text) // 2
        texts.append((one.text[: len(one.text) - half] + after.text[:half]).encode())
    own, edited = [one.keys for one, _ in pairs], [digests(t) for t in texts]
    small = np.full(len(pairs), PRINTED)
    return [
        [len(one.text) for one, _ in pairs],
        [hashlib.sha256(t).hexdigest() for t in texts],
        sketch(own, small).printed(),
        sketch(edited, small).printed(),
        likeness(own, edited).tolist(),
        likeness(own, [after.keys for _, after in pairs]).tolist(),
    ]


def _columns(ids: list, kind: pa.DataType, columns: list[list], rest: dict) -> pa.RecordBatch:
    n = len(ids)
    arrays = [pa.array(ids, type=kind)]
    arrays += [pa.array(c, type=t) for c, (_, t) in zip(columns, RESULT, strict=True)]
    names = ["doc_id", *[name for name, _ in RESULT]]
    for name, (values, t) in rest.items():
        arrays.append(pa.nulls(n, t) if values is None else pa.array(values, type=t))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _neighbour_batches(batches):
    """Rows in order, to results of all but the last, and the first and last rows with their text."""
    held: list[tuple[Document, Document]] = []
    last, part, weight, kind = None, None, 0, None

    def flush():
        rest = {"part": (None, pa.int32()), "edge": (None, pa.string()), "text": (None, pa.string())}
        return _columns([one.doc_id for one, _ in held], kind, _compared(held), rest)

    def edge(doc: Document, name: str):
        rest = {"part": ([part], pa.int32()), "edge": ([name], pa.string()), "text": ([doc.text], pa.string())}
        return _columns([doc.doc_id], kind, [[None]] * len(RESULT), rest)

    for batch in batches:
        kind = batch.column(0).type
        for doc_id, text, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            doc = Document(doc_id, text, digests(text.encode()))
            if last is None:
                part = at
                yield edge(doc, "first")
            else:
                held.append((last, doc))
                weight += len(last.keys) * 3 + len(doc.keys) + 8
                if weight > TOGETHER:
                    yield flush()
                    held, weight = [], 0
            last = doc
    if held:
        yield flush()
    if last is not None:
        yield edge(last, "last")


def _edge_batches(batches):
    for batch in batches:
        ids, texts, after = [c.to_pylist() for c in batch.columns]
        pairs = [
            (Document(i, a, digests(a.encode())), Document(None, b, digests(b.encode())))
            for i, a, b in zip(ids, texts, after, strict=True)
        ]
        yield _columns(ids, batch.column(0).type, _compared(pairs), {})


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how near they are.

    Documents follow one another in descending doc_id, null last, rows that share an id by a
    hash of their text; after the last comes the first. The edited text is the text with its last
    floor(n_chars / 2) code points replaced by as many from the start of the next document.

    Rows are dealt by ranges of the order, so neighbours are at hand in one task and each text is
    shuffled once; only the first and last row of each partition travel again. `fingerprint`
    prints a small sketch (hex, 16 bits of count and 64 of digests a cell); near_edited and
    near_next compare sketches of growing size until the difference peels off.

    Null text: as empty; two empty texts are alike (1). A single document is its own next. Empty
    input: no rows. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = ", ".join(
        f"{name} {'long' if t == pa.int64() else 'double' if t == pa.float64() else 'string'}"
        for name, t in RESULT
    )
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ordered = (
        docs.select("doc_id", whole().alias("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    made = stored(
        ordered.mapInArrow(
            _neighbour_batches, f"doc_id {kind}, {result}, part int, edge string, text string"
        ),
        "sketches",
    )
    firsts = made.filter("edge = 'first'").select(F.col("part").alias("_next"), F.col("text").alias("after"))
    lasts = made.filter("edge = 'last'").select("doc_id", "text", "part")
    line = Window.orderBy("_next")  # one narrow row for each partition
    follows = firsts.select("_next").select(
        F.lag("_next").over(line).alias("part"),
        "_next",
        F.max("_next").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"),
    ).select(F.coalesce("part", "end").alias("part"), "_next")
    edges = (
        lasts.join(follows, "part").join(firsts, "_next").select("doc_id", "text", "after")
        .mapInArrow(_edge_batches, f"doc_id {kind}, {result}")
    )
    names = ["doc_id", *[name for name, _ in RESULT]]
    return made.filter("edge is null").select(*names).union(edges.select(*names))
