"""Removal of repeated byte strings: anchors find candidates, a Burrows-Wheeler index decides."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listings_spark.llm.anchors import WINDOW, Records, records
from listings_spark.llm.common import stored, whole

SEGMENT = 1 << 21  # bytes of context indexed together
COMMON = SEGMENT // 64  # contexts of one anchor that fit a segment; beyond, windows go one by one
LAST = (1 << 63) - 1  # order of documents without id
TOGETHER = 4000  # documents packed together
BREAK = 0xFF  # never a byte of UTF-8


# --- the index -----------------------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in order of the 64 bytes that begin there, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    key = np.ndarray((n,), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
    reach = 8
    while True:
        order = np.argsort(key)
        new = np.empty(n, dtype=bool)
        new[0] = False
        np.not_equal(key[order[1:]], key[order[:-1]], out=new[1:])
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64) + np.uint64(1)
        if reach >= WINDOW:
            return order
        key = rank << np.uint64(32)
        key[:-reach] |= rank[reach:]
        reach *= 2


def equal_intervals(text: np.ndarray, order: np.ndarray, least: int = WINDOW) -> np.ndarray:
    """Interval number, in suffix order, of the suffixes that share their first `least` bytes.

    Works breadth first by the length of the shared prefix. Reading the transform (the byte before
    each suffix) extends the strings of one length to the left by a byte: neighbours that begin
    with the same byte stay in one interval of length l + 1 if the suffixes behind that byte lie
    in one interval of length l. A pair of neighbours gets its common prefix length when it
    parts, in increasing order, and drops out; pairs still together at `least` are never followed
    further.
    """
    n = len(text)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    behind = place[(order + 1) % n]  # inverse of the step from a suffix to the one before it
    head = text[order]
    parted = np.empty(n, dtype=bool)
    parted[0] = True
    np.not_equal(head[1:], head[:-1], out=parted[1:])
    together = np.flatnonzero(~parted)
    now, before = behind[together], behind[together - 1]
    for _ in range(least - 1):
        interval = np.cumsum(parted, dtype=np.int32)
        leaves = interval[now] != interval[before]
        parted[together[leaves]] = True
        stays = ~leaves
        together, now, before = together[stays], now[stays], before[stays]
    return np.cumsum(parted) - 1


def repeated_windows(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray):
    """Windows of the contexts that also stand in a context of a smaller document.

    Context i is data[offsets[i]:offsets[i + 1]] and belongs to docs[i]. Returns the contexts and
    the places of the windows in them, in order.
    """
    sizes = np.diff(offsets)
    home = np.repeat(np.arange(len(sizes)), sizes)
    text = np.full(len(data) + len(sizes), BREAK, dtype=np.uint8)
    text[np.arange(len(data)) + home] = data
    order = suffix_order(text)
    interval = equal_intervals(text, order)
    begin = offsets[:-1] + np.arange(len(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.arange(len(text)) - begin[owner]
    valid = (inside <= sizes[owner] - WINDOW)[order]
    doc = np.where(valid, docs[owner[order]], LAST)
    least = np.minimum.reduceat(doc, np.flatnonzero(np.diff(interval, prepend=-1)))
    found = np.sort(order[valid & (doc > least[interval])])
    return owner[found], inside[found]


# --- packing of rows -----------------------------------------------------------------------------


def _blobs(arrays: list[np.ndarray], starts: np.ndarray) -> pa.Array:
    """One binary value per run of rows: each array's bytes for the run, one array after another."""
    stops = np.append(starts[1:], len(arrays[0]) if arrays else 0)
    return pa.array(
        [b"".join(a[s:e].tobytes() for a in arrays) for s, e in zip(starts, stops, strict=True)],
        type=pa.binary(),
    )


def _spans_by_doc(doc: np.ndarray, twin: np.ndarray, first: np.ndarray, count: np.ndarray):
    """(doc, twin, spans): runs of windows of each document, joined where they touch."""
    order = np.lexsort((first, twin, doc))
    doc, twin, first, count = doc[order], twin[order], first[order], count[order]
    if not len(doc):
        return doc, twin, pa.array([], type=pa.binary())
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])])
    run = head.copy()
    run[1:] |= first[1:] > first[:-1] + count[:-1]
    begin = np.flatnonzero(run)
    last = np.maximum.reduceat(first + count, begin)
    starts = np.searchsorted(begin, np.flatnonzero(head))
    spans = np.stack([first[begin], last - first[begin]], axis=1).astype("<u4")
    return doc[head], twin[head], _blobs([spans], starts)


OUT = pa.schema([
    ("kind", pa.int32()), ("bucket", pa.int32()), ("doc", pa.int64()), ("twin", pa.int32()),
    ("anchor", pa.int64()), ("first", pa.int64()), ("count", pa.int32()), ("blob", pa.binary()),
])
OUT_DDL = "kind int, bucket int, doc long, twin int, anchor long, first long, count int, blob binary"
RECORDS, SPANS, CONTEXT, LOOSE = 0, 1, 2, 3  # kinds of rows


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            columns[f.name] if isinstance(columns.get(f.name), pa.Array)
            else pa.array(columns[f.name], type=f.type) if f.name in columns
            else pa.nulls(n, f.type)
            for f in OUT
        ],
        schema=OUT,
    )


def _span_rows(doc, twin, first, count, buckets: int) -> pa.RecordBatch:
    doc, twin, blob = _spans_by_doc(doc, twin, first, count)
    n = len(doc)
    return _rows(n, kind=np.full(n, SPANS), bucket=doc % buckets, doc=doc, twin=twin, blob=blob)


def _known(anchor, context, doc):
    """Order by (anchor, context), bounds of the runs, and rows whose context an earlier doc has."""
    order = np.lexsort((doc, context, anchor))
    a, c, d = anchor[order], context[order], doc[order]
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
    known = np.empty(len(order), dtype=bool)
    known[order] = d > least
    return known


def _anchor_batches(buckets: int):
    """Arrow batches of (doc, twin, text) to packed records by bucket of the anchor's hash.

    Records whose context a smaller document of the batch has are settled here and leave as spans,
    so that what a corpus repeats often is sent once per batch.
    """

    def run(batches):
        for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
            docs, twins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).cast(pa.large_binary())
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
            made = records(data, offsets)
            if not len(made.anchor):
                continue
            known = _known(made.anchor, made.context, docs[made.doc])
            owner = made.doc[known]
            yield _span_rows(docs[owner], twins[owner], made.first[known], made.count[known], buckets)
            left = Records(*[x[~known] for x in made])
            bucket = (left.anchor % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, left = bucket[order], Records(*[x[order] for x in left])
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            arrays = [
                left.anchor.astype("<u8").view("V8"),
                (left.context >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5],
                left.left, left.right, left.count.astype(np.uint8),
            ]
            stops = np.append(starts[1:], len(bucket))
            blobs = []
            for s, e in zip(starts, stops, strict=True):
                held, row = np.unique(left.doc[s:e], return_inverse=True)
                wide = left.first[s:e].astype("<u4")
                blobs.append(b"".join([
                    np.array([e - s, len(held)], dtype="<u4").tobytes(),
                    docs[held].astype("<i8").tobytes(), twins[held].astype("<i4").tobytes(),
                    row.astype("<u2").tobytes(),
                    (wide & 0xFFFF).astype("<u2").tobytes(), (wide >> 16).astype("<u2").tobytes(),
                    *[a[s:e].tobytes() for a in arrays],
                ]))
            n = len(blobs)
            yield _rows(n, kind=np.full(n, RECORDS), bucket=bucket[starts], blob=pa.array(blobs, pa.binary()))

    return run


def _unpacked(blob: bytes):
    n, held = np.frombuffer(blob, dtype="<u4", count=2)
    at = 8

    def take(kind, count, width=1):
        nonlocal at
        out = np.frombuffer(blob, dtype=kind, count=count * width, offset=at)
        at += out.nbytes
        return out

    docs, twins, row = take("<i8", held), take("<i4", held), take("<u2", n)
    low, high, anchor = take("<u2", n), take("<u2", n), take("<u8", n)
    context = np.zeros((n, 8), dtype=np.uint8)
    context[:, :5] = take(np.uint8, n, 5).reshape(-1, 5)
    left, right, count = take(np.uint8, n), take(np.uint8, n), take(np.uint8, n)
    first = low.astype(np.int64) | (high.astype(np.int64) << 16)
    return (
        docs[row], twins[row], anchor, context.reshape(-1).view("<u8"), left, right, first,
        count.astype(np.int64),
    )


def _meets(anchor, side, doc) -> np.ndarray:
    """Rows that share anchor and side with a row of another document."""
    order = np.lexsort((side, anchor))
    a, s, d = anchor[order], side[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])]))
    several = np.maximum.reduceat(d, starts) != np.minimum.reduceat(d, starts)
    out = np.empty(len(order), dtype=bool)
    out[order] = np.repeat(several, np.diff(np.append(starts, len(order)))) & (s > 0)
    return out


def _bucket_batches(buckets: int, common: int):
    """All packed records of a task's buckets to spans settled by equal contexts, and contexts.

    A context leaves for the index if another document has the same anchor and the same bytes on
    one side of it; one row stands for all documents that share the context. Contexts of an
    anchor with very many different ones leave as loose: no task could hold them together.
    """

    def solve(held):
        doc, twin, anchor, context, left, right, first, count = [
            np.concatenate(p) for p in zip(*map(_unpacked, held), strict=True)
        ]
        known = _known(anchor, context, doc)
        yield _span_rows(doc[known], twin[known], first[known], count[known], buckets)
        rest = np.flatnonzero(~known)
        anchor, doc = anchor[rest], doc[rest]
        open_ = _meets(anchor, left[rest], doc) | _meets(anchor, right[rest], doc)
        rest, anchor = rest[open_], anchor[open_]
        n = len(rest)
        _, same, often = np.unique(anchor, return_inverse=True, return_counts=True)
        yield _rows(
            n, kind=np.where(often[same] > common, LOOSE, CONTEXT), doc=doc[open_], twin=twin[rest], anchor=anchor.view(np.int64),
            first=first[rest], count=count[rest],
        )

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            passed = batch.filter(pc.equal(batch.column(0), SPANS))
            if passed.num_rows:
                yield passed
            packed = batch.filter(pc.equal(batch.column(0), RECORDS))
            for bucket, blob in zip(
                packed.column(1).to_pylist(), packed.column(7).to_pylist(), strict=True
            ):
                held.setdefault(bucket, []).append(blob)
        while held:
            yield from solve(held.popitem()[1])

    return run


def _index_batches(buckets: int):
    """Contexts in order of anchors to spans, whole anchors at a time up to SEGMENT bytes."""

    def solve(held):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        texts = rows.column(4).cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
        doc, twin, first = [rows.column(i).to_numpy() for i in (1, 2, 3)]
        owner, inside = repeated_windows(data, offsets - offsets[0], doc)
        return _span_rows(
            doc[owner], twin[owner], first[owner] + inside, np.ones(len(owner), dtype=np.int64), buckets
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < SEGMENT:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            anchors = rows.column(0).to_numpy()
            cut = np.flatnonzero(anchors != anchors[-1])
            if len(cut):
                yield solve([rows.slice(0, cut[-1] + 1)])
                held = [rows.slice(cut[-1] + 1)]
                size = held[0].nbytes
        if held:
            yield solve(held)

    return run


def _pack_batches(buckets: int):
    """Single windows (doc, twin, first) to spans."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                doc, twin, first = [c.to_numpy() for c in batch.columns]
                yield _span_rows(doc, twin, first, np.ones(len(doc), dtype=np.int64), buckets)

    return run


def _loose_repeats(contexts: DataFrame) -> DataFrame:
    """(doc, twin, first) of windows in (doc, twin, first, count, context) a smaller document has.

    Each window goes by its own bytes: a partial aggregate finds its least document, and the
    join back is one that Spark can split.
    """
    window = F.substring("context", F.col("at") + 1, F.lit(WINDOW))
    windows = contexts.select(
        "doc", "twin", "first", "context", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("at")
    ).select(
        "doc", "twin", (F.col("first") + F.col("at")).alias("first"),
        F.xxhash64(window).alias("h"), F.xxhash64(F.lit(1), window).alias("g"),  # 128 bits stand for it
    )
    least = windows.groupBy(F.col("h").alias("_h"), F.col("g").alias("_g")).agg(F.min("doc").alias("least"))
    same = (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))
    return windows.join(least, same).filter("doc > least").select("doc", "twin", "first")


def _cut_batches(batches):
    """Texts and their packed spans to what is left of each."""
    for batch in batches:
        ids, texts, spans = batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, packed in zip(texts, spans, strict=True):
            data = text.as_buffer() if text.is_valid else b""
            size, removed, pieces, at = len(data), 0, 0, 0
            digest, view = hashlib.sha256(), memoryview(data)
            kept = []
            if packed.is_valid:
                runs = np.frombuffer(b"".join(x.as_py() for x in packed), dtype="<u4").reshape(-1, 2)
                runs = runs[np.argsort(runs[:, 0], kind="stable")].astype(np.int64)
                begin, end = runs[:, 0], np.maximum.accumulate(runs[:, 0] + runs[:, 1] + WINDOW - 1)
                new = np.concatenate([[True], begin[1:] > end[:-1]])
                heads = np.flatnonzero(new)
                for b, e in zip(begin[heads], end[np.append(heads[1:] - 1, len(end) - 1)], strict=True):
                    kept.append((at, b))
                    at, removed, pieces = int(e), removed + int(e - b), pieces + 1
            kept.append((at, size))
            for b, e in kept:
                digest.update(view[b:e])
            out["n_bytes"].append(size)
            out["n_removed"].append(removed)
            out["n_spans"].append(pieces)
            out["kept_sha256"].append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [ids, *[pa.array(out[k], type=pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")],
             pa.array(out["kept_sha256"], type=pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(doc, twin, spans) of windows that stand in a smaller document, from (doc, twin, text)."""
    spark = keyed.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = keyed.mapInArrow(_anchor_batches(buckets), OUT_DDL)
    met = stored(
        packed.repartitionById(buckets, "bucket").mapInArrow(_bucket_batches(buckets, COMMON), OUT_DDL), "met"
    )
    wanted = met.filter(F.col("kind").isin(CONTEXT, LOOSE)).select(
        "kind", F.col("doc").alias("_doc"), F.col("twin").alias("_twin"), "anchor", "first", "count"
    )
    bytes_ = F.substring(
        F.col("text").cast("binary"), (F.col("first") + 1).cast("int"), F.col("count") + WINDOW - 1
    )
    here = (F.col("doc") == F.col("_doc")) & (F.col("twin") == F.col("_twin"))

    def contexts(kind: int) -> DataFrame:
        return keyed.join(wanted.filter(F.col("kind") == kind), here).select(
            "anchor", "doc", "twin", "first", "count", bytes_.alias("context")
        )

    indexed = (
        contexts(CONTEXT)
        .select("anchor", "doc", "twin", "first", "context")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_index_batches(buckets), OUT_DDL)
    )
    loose = _loose_repeats(contexts(LOOSE)).mapInArrow(_pack_batches(buckets), OUT_DDL)
    found = ["doc", "twin", "blob"]
    return (
        met.filter(F.col("kind") == SPANS).select(*found)
        .union(indexed.select(*found))
        .union(loose.select(*found))
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """What is left of each text without the strings of WINDOW bytes that smaller documents hold.

    Bytes are UTF-8; a byte goes if any such string covers it, and strings are judged on the
    texts as they came in. Matches do not cross documents, and a string that only its own
    document repeats stays.

    Null text: empty. Null ids are greater than all others and not compared among themselves;
    so are rows that share an id, each judged by its own text. Texts under WINDOW bytes stay
    whole. Empty input: no rows. Other columns are ignored. Columns: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    keyed = docs.select(
        order.alias("doc"), F.hash(whole()).alias("twin"), "doc_id", whole().alias("text")
    )
    spans = repeated_spans(keyed.select("doc", "twin", "text"))
    gathered = spans.groupBy(F.col("doc").alias("_doc"), F.col("twin").alias("_twin")).agg(
        F.collect_list("blob").alias("spans")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        keyed.select("doc", "twin", "text")
        .join(gathered, (F.col("doc") == F.col("_doc")) & (F.col("twin") == F.col("_twin")), "left")
        .select(
            F.when(F.col("doc") != LAST, F.col("doc")).cast(kind).alias("doc_id"), "text", "spans"
        )
        .mapInArrow(
            _cut_batches,
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        )
    )
