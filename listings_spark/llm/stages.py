"""Taking decisions about documents back to their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

KEY = "row_key"


def _hashes(kind: DataType) -> bool:
    """Whether Spark hashes values of a type."""
    if isinstance(kind, StructType):
        return all(_hashes(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _hashes(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def row_key(docs: DataFrame) -> Column:
    """Id and a hash of all columns: rows that share it are equal in whatever Spark can hash."""
    return F.struct(
        F.col("doc_id").alias("id"),
        F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if _hashes(f.dataType)]).alias("whole"),
    )


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The key of every row as `doc_id`, with the columns that a decision needs and no others."""
    return docs.select(row_key(docs).alias("doc_id"), *columns)


def apply_times(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of `docs` as often as planned: (KEY, times, alike), one row a key.

    `times` is for all `alike` rows of a key together; being equal, one of them stands for all.
    Rows travel nested, so any column names do. The documents are shuffled once for the join.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(docs).alias(KEY))
    wanted = plan.filter("times > 0").select(F.col(KEY).alias("planned"), F.col("times").cast("int").alias("times"), "alike")
    met = rows.join(wanted, F.col(KEY) == F.col("planned")).select("row", KEY, "times", "alike")
    apart = met.filter("alike = 1")
    alike = met.filter("alike > 1").dropDuplicates([KEY])
    repeated = apart.union(alike).select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select("row.*")
