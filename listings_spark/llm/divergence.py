"""Divergence of sources from their language, over terms kept by iceberg refinement of prefixes."""

from __future__ import annotations

from array import array
from collections import Counter
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listings_spark.llm.common import stored, text_slices

LEAST_DOCUMENTS = 30
FIRST_PREFIX, WIDER = 4, 4  # bytes of the first level, and how much longer each level is
SMOOTHING = 5
SCALE = 1_000_000_000
MOST_TERMS = 50
# Bytes of terms as they are, A-Z as a-z, all others as a space.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
END = b"\x00"  # in no term; closes a complete one
BETWEEN = b" "  # in no term
BITS = 1 << 23  # of a sieve
TABLE = 1 << 24  # places of a table that counts without sorting
ROWS = 1 << 20  # sums that a task holds
HELD = 1 << 23  # bytes of terms that a task adds up at a time


def _term_batches(batches):
    """Distinct terms of each text with their occurrences."""
    for batch in batches:
        for start, texts in text_slices([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]):
            terms, counts = [], []
            for text in texts:
                found = Counter(text.translate(LETTERS).split())
                terms.append(BETWEEN.join(found) or None)
                counts.append(array("i", found.values()).tobytes())
            held = pa.StructArray.from_arrays(
                [pa.array(terms, type=pa.binary()), pa.array(counts, type=pa.binary())], names=["term", "n"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).slice(start, len(texts)) for k in (0, 1)] + [held],
                names=["lang", "source", "terms"],
            )


def document_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, terms) of every row: its distinct terms as UTF-8 bytes and their occurrences.

    A row is two byte strings, terms with a space between them and 32-bit counts: the JVM hands
    them on whole, and tasks split them in Arrow. Terms are runs of ASCII letters and of characters
    above ASCII; only A-Z are lower-cased. Null text, lang and source are read as empty.
    """
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.mapInArrow(
        _term_batches, "lang string, source string, terms struct<term: binary, n: binary>"
    )


def sieve(alive: DataFrame, column: str) -> bytes:
    """A bit for every hash of (lang, column) that occurs: a filter of fixed size for any corpus.

    What it lets through by chance costs a count, and exact counts decide later.
    """
    mixed = F.crc32(F.col(column)).bitwiseXOR(F.crc32(F.encode("lang", "UTF-8")))
    place = F.pmod(mixed, F.lit(BITS))
    words = (
        alive.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .collect()  # BITS / 64 rows at most
    )
    bits = np.zeros(BITS // 64, dtype=np.int64)
    for row in words:
        bits[row["word"]] = row["bits"]
    return bits.tobytes()


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each value, the distinct values)."""
    made = values.dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary


def _flat(terms: pa.BinaryArray) -> tuple[pa.Array, np.ndarray]:
    """All terms one after another, with the row of each."""
    lists = pc.split_pattern(terms, pattern=BETWEEN)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(terms)), sizes)


def _sums(keys: np.ndarray, counts: np.ndarray | None, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys under `room` in order with the sums of their counts (None: how often each occurs)."""
    if room <= TABLE:
        occurs = np.bincount(keys, minlength=room)
        found = np.flatnonzero(occurs)
        if counts is None:
            return found, occurs[found]
        sums = np.bincount(keys, weights=counts, minlength=room)  # far under 2^53: exact
        return found, sums[found].astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
    counts = np.ones(len(keys), dtype=np.int64) if counts is None else counts[order]
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _parts(batches, terms_of):
    """Batches in pieces of about HELD bytes of terms."""
    for batch in batches:
        sizes = pc.binary_length(terms_of(batch)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + HELD, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class _Sums:
    """Counts of (group, value) pairs that a task adds up before it sends them on.

    Groups are tuples of texts. At most about 2 * ROWS rows are held; beyond that they leave.
    """

    def __init__(self, columns: tuple[str, ...]):
        self.columns = columns
        self.numbers: dict[tuple, int] = {}
        self.pieces: list[pa.Table] = []
        self.rows = 0

    def add(self, groups: list[tuple], group: np.ndarray, values: pa.Array, counts: np.ndarray):
        """Add rows; yields what leaves."""
        numbers = np.array([self.numbers.setdefault(g, len(self.numbers)) for g in groups], dtype=np.int64)
        self.pieces.append(pa.table({"g": numbers[group], "value": values, "n": counts}))
        self.rows += len(counts)
        if self.rows > 2 * ROWS:
            self._settle()
            if self.rows > ROWS:
                yield from self.end()

    def _settle(self) -> None:
        added = pa.concat_tables(self.pieces).group_by(["g", "value"], use_threads=False).aggregate([("n", "sum")])
        self.pieces = [added.rename_columns({"n_sum": "n"}).select(["g", "value", "n"])]
        self.rows = added.num_rows

    def end(self):
        """All that is held."""
        if not self.rows:
            return
        self._settle()
        names = [pa.array(c, type=pa.string()) for c in zip(*self.numbers, strict=True)]
        for piece in self.pieces[0].to_batches(max_chunksize=1 << 16):
            yield pa.RecordBatch.from_arrays(
                [n.take(piece.column(0)) for n in names] + [piece.column(1), piece.column(2)],
                names=[*self.columns, "n"],
            )
        self.pieces, self.rows, self.numbers = [], 0, {}


def _living(bits: bytes, langs: list[str], lang: np.ndarray, codes: np.ndarray, values: pa.Array) -> np.ndarray:
    """Which of the pairs of a language and a value the sieve lets through; a value is hashed once."""
    of_lang = np.array([crc32(x.encode()) for x in langs], dtype=np.uint32)
    of_value = np.fromiter(map(crc32, values.to_pylist()), dtype=np.uint32, count=len(values))
    place = (of_value[codes] ^ of_lang[lang]) % np.uint32(BITS)
    return np.frombuffer(bits, dtype=np.uint8)[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def _prefix_batches(length: int, before: int, bits: bytes | None):
    """Documents of each open prefix of a level, added up in the task."""

    def run(batches):
        sums = _Sums(("lang", "prefix"))
        for batch in _parts(batches, lambda b: b.column(1)):
            lang_of, langs = _coded(batch.column(0))
            langs = langs.to_pylist()
            terms, row = _flat(batch.column(1))
            if bits is not None:
                long = pc.greater_equal(pc.binary_length(terms), before)
                terms, row = terms.filter(long), row[long.to_numpy(zero_copy_only=False)]
                if len(terms):
                    keep = _living(bits, langs, lang_of[row], *_coded(pc.binary_slice(terms, 0, before)))
                    terms, row = terms.filter(pa.array(keep)), row[keep]
            if not len(terms):
                continue
            ended = pc.binary_join_element_wise(terms, pa.scalar(END), pa.scalar(b""))
            codes, prefixes = _coded(pc.binary_slice(ended, 0, length))
            seen = np.unique(row * len(prefixes) + codes)  # once a document
            lang, code = lang_of[seen // len(prefixes)], seen % len(prefixes)
            keys, counts = _sums(lang * len(prefixes) + code, None, len(langs) * len(prefixes))
            values = prefixes.take(pa.array(keys % len(prefixes)))
            yield from sums.add([(x,) for x in langs], keys // len(prefixes), values, counts)
        yield from sums.end()

    return run


def kept_terms(terms: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term): the terms in at least `least` documents of their language.

    Iceberg refinement. A level counts the documents of every prefix of its length and drops the
    rare ones; the next level extends only prefixes that survived and are no complete terms. No
    term under a dropped prefix can be frequent. Documents are counted in their own rows, so
    partial counts leave the tasks and no document ids do; survivors reach the tasks as a `sieve`.
    Levels end when all survivors are complete; their number is logarithmic in the length of the
    longest frequent beginning.
    """
    found, bits, before, length = [], None, 0, FIRST_PREFIX
    while True:
        level = terms.select("lang", F.col("terms.term").alias("terms")).mapInArrow(
            _prefix_batches(length, before, bits), "lang string, prefix binary, n long"
        )
        often = stored(
            level.groupBy("lang", "prefix").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "prefix"),
            "prefixes",
        )
        complete = F.substring("prefix", -1, 1) == F.lit(END)
        size = F.octet_length("prefix")
        found.append(
            often.filter(complete).select("lang", F.substring(F.col("prefix"), F.lit(1), size - 1).alias("term"))
        )
        alive = often.filter(~complete)
        if alive.isEmpty():
            break
        bits, before, length = sieve(alive, "prefix"), length, length * WIDER
    return reduce(DataFrame.union, found)


def _occurrence_batches(bits: bytes):
    """Occurrences of terms that may be kept, by group, added up in the task."""

    def run(batches):
        sums = _Sums(("lang", "source", "term"))
        for batch in _parts(batches, lambda b: b.column(2).field("term")):
            lang_of, langs = _coded(batch.column(0))
            source_of, sources = _coded(batch.column(1))
            langs, sources = langs.to_pylist(), sources.to_pylist()
            held, row = _flat(batch.column(2).field("term"))
            if not len(held):
                continue
            codes, terms = _coded(held)
            n = np.frombuffer(b"".join(batch.column(2).field("n").to_pylist()), dtype=np.int32)
            group = lang_of[row] * len(sources) + source_of[row]
            keys, counts = _sums(group * len(terms) + codes, n, len(langs) * len(sources) * len(terms))
            group, codes = keys // len(terms), keys % len(terms)
            keep = _living(bits, langs, group // len(sources), codes, terms)
            group, codes, counts = group[keep], codes[keep], counts[keep]
            groups = [(x, y) for x in langs for y in sources]
            yield from sums.add(groups, group, terms.take(pa.array(codes)), counts)
        yield from sums.end()

    return run


def share(count: Column | int, all_: Column, terms: Column) -> Column:
    """1 + the smoothed share of a count in billionths, rounded down, in whole numbers."""
    part = (F.lit(count).cast("long") if isinstance(count, int) else count) + SMOOTHING
    whole = all_ + SMOOTHING * terms
    scaled = F.lit(SCALE).cast("decimal(11,0)") * part.cast("decimal(20,0)")
    wide = whole.cast("decimal(20,0)")
    exact = F.floor((scaled - scaled % wide) / wide).cast("long")
    short = F.lit(SCALE).cast("long") * part  # fits 63 bits in this branch
    return F.when(part <= 9 * SCALE, F.call_function("div", short, whole)).otherwise(exact) + 1


def _pair_batches(batches):
    """Sums of |p - q| between all sources of a language, over the terms that a task gets."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, bases, parts = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        order: dict[str, list[int]] = {}
        for row, lang in enumerate(langs):
            order.setdefault(lang, []).append(row)
        for lang, rows in order.items():
            base = np.array(bases[rows[0]].as_py(), dtype=np.int64)
            chosen = parts.take(pa.array(rows))
            flat = chosen.flatten()
            sizes = chosen.value_lengths().to_numpy(zero_copy_only=False)
            shares = np.tile(base, (len(rows), 1))
            shares[np.repeat(np.arange(len(rows)), sizes), flat.field("i").to_numpy()] = flat.field("p").to_numpy()
            total = sums.setdefault(lang, np.zeros((len(base), len(base)), dtype=np.int64))
            for i in range(len(base)):
                total[i] += np.abs(shares - shares[:, i : i + 1]).sum(axis=0)
    for lang, total in sums.items():
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(i), type=pa.string()), pa.array(i.astype(np.int32)),
             pa.array(j.astype(np.int32)), pa.array(total[i, j])],
            names=["lang", "i", "j", "f"],
        )


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS) -> DataFrame:
    """How far sources lie from one another, and the terms that set each apart from its language.

    A language keeps the terms in at least `least` of its documents. Every source of it, and the
    language itself, gives each kept term a smoothed share. Part `pair`: sums of absolute
    differences to every other source. Part `term`: terms of the source whose share is above
    the language's, the `most` largest differences. Ranks go by value, then by item in byte order.

    Each row is a document of its own, repeated ids and texts included. Null text, lang and source
    are read as empty; sources without terms take part. One source of a language has no pairs.
    Empty input: no rows. Other columns are ignored. Work on pairs is the number of kept terms
    times the square of the sources of a language, which the result has as well.
    """
    terms = stored(document_terms(docs), "terms")
    kept = stored(kept_terms(terms, least), "kept")
    counted = (
        terms.mapInArrow(
            _occurrence_batches(sieve(kept, "term")), "lang string, source string, term binary, n long"
        )
        .repartition("lang", "term")  # few rows a term: tasks have added up theirs; one exchange for both sums
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    )
    by_term = stored(
        counted.groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "n")).alias("parts"), F.sum("n").alias("n"))
        .join(kept, ["lang", "term"], "left_semi"),
        "by-term",
    )
    sizes = (
        by_term.select("lang", F.explode("parts").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    )
    groups = terms.select("lang", "source", F.lit(0).cast("long").alias("n")).distinct()
    sources = (
        groups.union(sizes).groupBy("lang", "source").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"), F.sum("n").alias("total"))
    )
    v = F.col("v")
    counts = kept.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("v"))
    langs = stored(
        sources.join(counts, F.col("lang") == F.col("_lang"), "left").select(
            F.col("lang").alias("_lang"), "sources", "total", F.coalesce("v", F.lit(0)).alias("v"),
        ).withColumn("base", F.when(v > 0, F.transform("sources", lambda s: share(0, s["n"], v)))),
        "langs",
    )
    scored = stored(
        by_term.join(langs, F.col("lang") == F.col("_lang")).select(
            "lang", "term", share(F.col("n"), F.col("total"), v).alias("q"), "base",
            F.transform(
                "parts",
                lambda x: F.struct(
                    (F.array_position(F.col("sources.source"), x["source"]) - 1).cast("int").alias("i"),
                    x["source"].alias("source"),
                    share(
                        x["n"],
                        F.element_at("sources", F.array_position(F.col("sources.source"), x["source"]).cast("int"))["n"],
                        v,
                    ).alias("p"),
                ),
            ).alias("parts"),
        ),
        "scored",
    )
    sums = (
        scored.select("lang", "base", F.transform("parts", lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"))).alias("parts"))
        .mapInArrow(_pair_batches, "lang string, i int, j int, f long")
        .groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))
    )
    names = F.col("sources.source")
    ordered = (
        langs.select(F.col("_lang").alias("lang"), names.alias("names"), F.posexplode(names).alias("i", "source"))
        .select("lang", "i", "source", F.posexplode("names").alias("j", "item"))
        .filter("i <> j")
    )
    pairs = ordered.join(sums, ["lang", "i", "j"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).alias("value")
    )
    apart = (
        scored.select("lang", "term", "q", F.explode("parts").alias("x"))
        .filter("x.p > q")
        .select(
            "lang", "x.source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
            (F.col("x.p") - F.col("q")).alias("value"),
        )
    )
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = apart.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most)
    return pairs.withColumn("rank", F.row_number().over(place)).union(best)
