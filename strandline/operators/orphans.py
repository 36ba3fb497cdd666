"""References to records that do not exist, were withdrawn, or came later.

References and targets share one key (relation, scope, value). Targets are folded to one validity interval a key, with
map-side combining; then both sides are hash-partitioned and sorted by the key and merged linearly, which is Spark's
sort-merge join. A reference side that piles up on one key is split by adaptive skew handling, its one target row being
copied to each split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Open end of a validity interval.
_OPEN = "9999-12-31 23:59:59"


def references(df: DataFrame, table: str, relation: int, row_id: Column, values: Column, at: Column, scope: Column | None = None) -> DataFrame:
    """References of one table: one row for each distinct value of ``values`` (an array) of each row."""
    return df.select(
        F.lit(relation).cast("tinyint").alias("_rel"),
        (scope if scope is not None else F.lit(None)).cast("string").alias("_scope"),
        F.lit(table).alias("tbl"),
        row_id.alias("row_id"),
        at.alias("_at"),
        F.explode(F.array_distinct(values)).alias("ref"),
    ).where(F.col("ref").isNotNull() & (F.col("ref") != ""))


def targets(df: DataFrame, relation: int, key: Column, loaded: Column, withdrawn: Column, scope: Column | None = None) -> DataFrame:
    """Rows that references of one relation may name."""
    return df.select(
        F.lit(relation).cast("tinyint").alias("_rel"),
        (scope if scope is not None else F.lit(None)).cast("string").alias("_scope"),
        key.alias("ref"),
        loaded.alias("_loaded"),
        withdrawn.alias("_withdrawn"),
    ).where(F.col("ref").isNotNull())


def orphans(refs: list[DataFrame], tgts: list[DataFrame]) -> DataFrame:
    """Each reference without a valid target: tbl, row_id, ref, period (month of the referring row), reason.

    ``missing``: no target row. ``late``: every target row was loaded after the referring row. ``deleted``: the target was
    withdrawn not later than the referring row was loaded. The deliveries of a target are one record, valid from the first
    load to the last withdrawal; a delivery never withdrawn keeps it valid. A target without a load time counts as always
    there; a referring row without one has no period and can only be ``missing``. Null and empty values refer to nothing.
    A scope of null on either side means that the relation has none.
    """
    key = ["_rel", "_scope", "ref"]
    whole = reduce(DataFrame.unionByName, tgts).withColumn("_scope", F.coalesce("_scope", F.lit("")))
    kind = dict(whole.dtypes)["_loaded"]
    valid = whole.groupBy(*key).agg(
        F.min(F.coalesce("_loaded", F.lit("0001-01-01 00:00:00").cast(kind))).alias("_first"),
        F.max(F.coalesce("_withdrawn", F.lit(_OPEN).cast(kind))).alias("_until"),
    )
    named = reduce(DataFrame.unionByName, refs).withColumn("_scope", F.coalesce("_scope", F.lit("")))
    joined = named.join(valid.withColumn("_there", F.lit(True)).hint("merge"), key, "left")
    reason = (
        F.when(F.col("_there").isNull(), "missing").when(F.col("_first").cast("timestamp") > F.col("_at"), "late").when(F.col("_until") <= F.col("_at"), "deleted")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("tbl", "row_id", "ref", F.date_format("_at", "yyyy-MM").alias("period"), "reason")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted for each table, period and reason."""
    return found.groupBy("tbl", "period", "reason").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref").alias("n_values"))
