"""WARC archives: writing with revisits, and reading by verified record boundaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listings_spark.llm.common import stored, whole

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"  # ends a header, and follows every record's block
LEAST_BYTES = 100  # smaller payloads are never replaced by a revisit
RECORDS_PER_FILE = 8192
DATE = "2024-01-01T00:00:00Z"


def _page(column: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))


def _lines(*fields: tuple[str, Column | str]) -> Column:
    parts = []
    for name, value in fields:
        parts += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n")]
    return F.concat(*parts)


def write_archive(pages: DataFrame, folder: str) -> None:
    """Write one record per page, as plain WARC files of at most RECORDS_PER_FILE records.

    A response holds HTTP headers and the payload; a revisit names the first page with the same
    payload and holds the HTTP headers only. Digests of payloads that occur more than once are
    found first, in a narrow table, so that payloads are not shuffled unless that table is large.
    Line separators of the text writer close the records.

    Null html: an empty payload. Null url: no target address; control characters in it are
    percent-encoded. Pages that share both payload and least id are responses. Null ids come
    after all others. Empty input: no files with records.
    """
    rows = pages.select(
        "page_id", "url", whole("html").alias("payload"),
        F.octet_length(whole("html")).alias("bytes"), F.sha2(whole("html"), 256).alias("digest"),
    )
    firsts = stored(
        rows.filter(F.col("bytes") >= LEAST_BYTES)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n"),
        "firsts",
    )
    seen = rows.join(firsts, F.col("digest") == F.col("_digest"), "left").withColumn(
        "again", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    )
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"),
        _lines(
            ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("bytes").cast("string"))
        ),
        F.lit("\r\n"),
    )
    block = F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(MAGIC),
        _lines(
            ("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
            ("WARC-Record-ID", _page("page_id")),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ),
        F.when(
            F.col("again"),
            _lines(
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", _page("first")),
            ),
        ).otherwise(F.lit("")),
        _lines(
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", F.octet_length(block).cast("string")),
        ),
        F.lit("\r\n"),
    )
    seen.select(F.concat(head, block)).write.option("lineSep", END).option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(folder)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes between two magic strings, with their place in the order of their file."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(folder)
        .select(
            F.xxhash64("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("part"),
            F.monotonically_increasing_id().alias("seq"),
            F.col("value").alias("piece"),
        )
    )


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def _parsed(piece: Column, bytes_: Column) -> dict[str, Column]:
    """Header fields of a piece and what its block tells, as far as the piece holds it."""
    head = F.substring_index(piece, END, 1)
    block_at = F.octet_length(head) + len(END)
    length = F.expr("try_cast(length_text as bigint)")
    block = F.substring(bytes_, F.col("block_at") + 1, F.col("length").cast("int")).cast("string")
    http = F.substring_index(F.col("block"), END, 1)
    return {
        "head": head,
        "block_at": block_at,
        "length_text": _field(F.col("head"), "Content-Length"),
        "length": length,
        "whole": F.col("length").isNotNull()
        & (F.octet_length(bytes_) >= F.col("block_at") + F.col("length")),
        "block": F.when(F.col("whole"), block),
        "http": http,
        "payload": F.substring(F.col("block").cast("binary"), F.octet_length("http") + len(END) + 1, 2**31 - 1),
    }


def _described(df: DataFrame, keep: list[str]) -> DataFrame:
    for name, column in _parsed(F.col("piece"), F.col("bytes")).items():
        df = df.withColumn(name, column)

    def page_number(field: str) -> Column:
        return F.expr(
            f"try_cast(regexp_extract(head, '(?im)^{field}: *<urn:page:(-?[0-9]+)>', 1) as bigint)"
        )

    return df.select(
        *keep,
        (F.octet_length("bytes") + len(MAGIC)).cast("long").alias("span"),
        (F.lit(len(MAGIC) + len(END)) + F.col("block_at") + F.col("length")).alias("reach"),
        "whole",
        page_number("WARC-Record-ID").alias("page_id"),
        F.lower(_field(F.col("head"), "WARC-Type")).alias("record_type"),
        page_number("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha256:", "").alias("told_digest"),
        F.expr("try_cast(regexp_extract(http, '(?im)^Content-Length:[ ]*([0-9]+)', 1) as bigint)").alias(
            "told_bytes"
        ),
        F.octet_length("payload").cast("long").alias("bytes_read"),
        F.sha2("payload", 256).alias("digest_read"),
        F.sha2("bytes", 256).alias("content"),
    )


def reachable(nodes: DataFrame) -> DataFrame:
    """Nodes (file, at, next) on the chain that starts at byte 0 of their file, by pointer jumping.

    Candidates that follow one another without a gap form a run: who enters it passes through to
    its end. Pointers lead from a run to the run, and the place in it, where its last candidate
    points. Each round the reached part doubles: reached runs step over the current pointers,
    and every pointer is replaced by the pointer of its target. An archive without magic in its
    payloads is one run a file and needs no round; else rounds are logarithmic in the runs of a file.
    """
    order = Window.partitionBy("file").orderBy("at")
    linked = nodes.withColumn("passes", F.col("next").eqNullSafe(F.lead("at").over(order)))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.coalesce(F.sum((~F.col("passes")).cast("long")).over(before), F.lit(0))
    runs = stored(linked.withColumn("run", breaks), "runs")
    entered = runs.select("file", F.col("at").alias("next"), F.col("run").alias("to"))
    jumps = stored(
        runs.filter("not passes")
        .select("file", "run", "next")
        .join(entered, ["file", "next"])
        .select("file", "run", "to", F.col("next").alias("entry")),
        "jumps",
    )
    reached = [runs.filter("at = 0").select("file", "run", F.col("at").alias("entry"))]
    while not jumps.isEmpty():
        so_far = reduce(DataFrame.union, reached).select("file", "run")
        stepped = so_far.join(jumps, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reached.append(stored(stepped.repartition("file", "run"), "reached"))
        further = jumps.select(
            "file", F.col("run").alias("to"), F.col("to").alias("after"), F.col("entry").alias("there")
        )
        jumps = stored(
            jumps.join(further, ["file", "to"])
            .select("file", "run", F.col("after").alias("to"), F.col("there").alias("entry"))
            .repartition("file", "run"),
            "jumps",
        )
    return (
        runs.join(reduce(DataFrame.union, reached), ["file", "run"])
        .filter("at >= entry")
        .select("file", "at", "next")
    )


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of uncompressed WARC files: page_id, record_type, refers_to, told and read sizes.

    Tasks cut the files at every magic string, wherever splits fall. Each piece with a readable
    header is a candidate that names its successor, the offset where its block must end. Offsets
    are running totals over the narrow pieces of one file (writers bound files); only candidates on the chain from byte 0 are records, so
    magic strings inside payloads, even whole records there, are rejected. Records cut by such
    strings are put together again from their pieces, which a second scan finds by the digests of
    their contents, so nothing depends on how either scan was split.

    A file that does not begin with a record, or whose chain breaks, yields the records before
    the break. Empty folder: no rows.
    """
    pieces = _pieces(spark, folder)
    told = ["page_id", "record_type", "refers_to", "told_digest", "told_bytes", "bytes_read", "digest_read"]
    found = stored(
        _described(
            pieces.withColumn("bytes", F.col("piece").cast("binary")), ["file", "part", "seq"]
        ),
        "pieces",
    )
    earlier = (
        Window.partitionBy("file").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("span").over(earlier), F.lit(0))
    placed = stored(found.withColumn("at", before - len(MAGIC)), "placed")
    nodes = placed.filter("at >= 0 and reach is not null").select(
        "file", "at", (F.col("at") + F.col("reach")).alias("next")
    )
    records = stored(
        placed.join(reachable(nodes), ["file", "at"])
        .select("file", "at", "next", "whole", *told),
        "records",
    )
    complete = records.filter("whole").select(*told)
    cut = records.filter("not whole").select("file", F.col("at").alias("owner"), "next")
    if cut.isEmpty():
        return complete
    members = stored(_members(placed, cut), "members")
    wanted = members.select(F.col("content").alias("_content")).distinct()
    texts = (
        pieces.select(F.sha2(F.col("piece").cast("binary"), 256).alias("content"), "piece")
        .join(wanted, F.col("content") == F.col("_content"), "left_semi")
        .groupBy("content").agg(F.first("piece").alias("piece"))
    )
    joined = (
        members.join(texts, "content")
        .groupBy("file", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("at", F.col("piece").alias("text")))).alias("all"))
        .withColumn("piece", F.array_join(F.col("all.text"), MAGIC))
        .withColumn("bytes", F.col("piece").cast("binary"))
    )
    return complete.union(_described(joined, ["file", "owner"]).select(*told))


def _members(placed: DataFrame, cut: DataFrame) -> DataFrame:
    """The pieces inside each record that magic strings have cut, by byte range.

    Ranges meet pieces on cells of one MiB, so no file is compared with all its records.
    """
    cell = 20
    ranges = cut.withColumn(
        "cell", F.explode(F.sequence(F.shiftright("owner", cell), F.shiftright("next", cell)))
    )
    here = placed.select("file", "at", "content", F.shiftright("at", cell).alias("cell"))
    return here.join(ranges, ["file", "cell"]).filter("at >= owner and at < next").select(
        "file", "at", "owner", "content"
    )


def page_records(read: DataFrame) -> DataFrame:
    """One row per record: what it holds, or for a revisit what it says of the full payload."""
    again = F.col("record_type") == "revisit"
    return read.select(
        "page_id",
        F.when(again, F.col("told_bytes")).otherwise(F.col("bytes_read")).alias("payload_bytes"),
        F.when(again, F.col("told_digest")).otherwise(F.col("digest_read")).alias("payload_digest"),
        "record_type",
        F.when(again, F.col("refers_to")).alias("refers_to"),
    )
