"""Length buckets of least padding and batches under a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listings_spark.llm.common import stored, word_count
from listings_spark.llm.prefix import prefix_sums

BUCKETS = 12
TOKEN_BUDGET = 65_536
FINE = 256  # shorter lengths stay apart; above, FINE // 2 cells for each doubling


def length_cell(length: Column) -> Column:
    """Number of the histogram cell: exact below FINE, then cells of under 1 % relative width.

    Bounds the histogram to a few thousand rows whatever the corpus.
    """
    octave = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 7, F.lit(0))
    return F.when(length < FINE, length).otherwise(
        octave * (FINE // 2) + F.floor(length / F.pow(F.lit(2.0), octave))
    )


def best_buckets(largest: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets that minimise padding.

    Cells are in order of length. Dynamic programming over the number of buckets and the last
    cell covered: padding every document of a bucket to its largest length, less the tokens
    themselves, which no choice changes.
    """
    top = np.asarray(largest, dtype=float)
    below = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=float))])
    n = len(top)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    choices = []
    for _ in range(min(buckets, n)):
        new, choice = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        for last in range(1, n + 1):
            tried = cost[:last] + top[last - 1] * (below[last] - below[:last])
            choice[last] = int(np.argmin(tried))
            new[last] = tried[choice[last]]
        choices.append(choice)
        cost = new
    ends, last = [], n
    for choice in reversed(choices):
        if last == 0:
            break
        ends.append(int(largest[last - 1]))
        last = int(choice[last])
    return ends[::-1]


def pack(
    docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, seed: int = 11
) -> DataFrame:
    """Give every document a length bucket and a batch of at most `budget` padded tokens.

    Tokens are words. The histogram of lengths over all documents (cells bounded by
    `length_cell`, exact sizes inside) goes to the driver, where dynamic programming picks the
    bucket lengths. Inside a bucket documents follow an order drawn from their ids, and every
    budget // bucket length of them make a batch; a document longer than the budget is a batch
    of its own. A hot bucket is spread over many tasks (`prefix_sums`).

    Null or blank text: length 0, in the smallest bucket. Null and repeated ids: ordered by
    length after the draw; wholly equal rows are interchangeable, each with its own slot. Empty
    input: no rows. Other columns are ignored. Columns: doc_id, n_tokens, bucket (from 0),
    padded_length, batch (from 0 inside the bucket), slot (from 0 inside the batch).
    """
    sized = stored(docs.select("doc_id", word_count().alias("n_tokens")), "lengths")
    cells = (
        sized.groupBy(length_cell(F.col("n_tokens")).alias("cell"))
        .agg(F.max("n_tokens").alias("largest"), F.count("*").alias("n"))
        .orderBy("cell")
        .collect()  # bounded by length_cell
    )
    ends = best_buckets([r["largest"] for r in cells], [r["n"] for r in cells], buckets) or [0]
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= e, F.lit(i)) for i, e in enumerate(ends)])
    lengths = F.array(*[F.lit(e).cast("long") for e in ends])
    run = prefix_sums(
        sized.withColumn("bucket", bucket)
        .withColumn("draw", F.xxhash64(F.col("doc_id"), F.lit(seed)))
        .withColumn("one", F.lit(1).cast("long")),
        [F.col("draw"), F.col("doc_id").asc_nulls_last(), F.col("n_tokens")],
        {"position": "one"},
        group="bucket",
    )
    length = F.element_at(lengths, F.col("bucket") + 1)
    held = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(length, F.lit(1))))
    return run.select(
        "doc_id",
        "n_tokens",
        "bucket",
        length.alias("padded_length"),
        F.floor(F.col("position") / held).alias("batch"),
        (F.col("position") % held).alias("slot"),
    )
