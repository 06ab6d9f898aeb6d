"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listings_spark.llm.common import stored


def _towards_least(pairs: DataFrame) -> DataFrame:
    """(x, y, least): each pair with the smallest of x and all its partners.

    A partial aggregate and a join that Spark can split, so a hub with very many partners does
    not land in one task.
    """
    least = pairs.groupBy(F.col("x").alias("_x")).agg(F.min("y").alias("m"))
    return pairs.join(least, F.col("x") == F.col("_x")).select(
        "x", "y", F.least("x", "m").alias("least")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a smaller one in its component; root is the least.

    Large stars join a node's greater neighbours to its least one, small stars the smaller
    ones; both repeat until no edge changes, after a number of rounds logarithmic in the longest
    chain. Edges stay in the shared folder between rounds. Null ends and loops are left out.
    """
    pair = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("x"), F.least(a, b).alias("y")
    )
    now, before = stored(pair.distinct(), "edges"), None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.select(F.col("x").alias("node"), F.col("y").alias("root"))
        before = state
        both = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = (
            _towards_least(both)
            .filter(F.col("y") > F.col("x"))
            .select(F.col("y").alias("x"), F.col("least").alias("y"))
            .distinct()
        )
        small = _towards_least(large)
        joined = small.select("x", F.col("least").alias("y")).union(
            small.filter(F.col("y") > F.col("least")).select(
                F.col("y").alias("x"), F.col("least").alias("y")
            )
        )
        now = stored(joined.distinct(), "edges")
