"""Predicates, joins and unions of closed intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import lines


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (e1 >= s2)


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], *, width: int = 4096, prefix: str = "b_") -> DataFrame:
    """All pairs of overlapping rows of a and b on the same keys; columns of b get the prefix.

    Both sides are spread over the bins that they touch and joined on (keys, bin); a pair is kept only in the first bin that
    both touch, so that nothing has to be made distinct. The join is an equi-join, split where a bin is skewed.
    """
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    left = a.withColumn("_bin", bins())
    right = b.withColumn("_bin", bins()).select(*[F.col(c).alias(c if c == "_bin" or c in keys else prefix + c) for c in [*b.columns, "_bin"]])
    both = left.join(right, [*keys, "_bin"])
    s, e, bs, be = F.col("start"), F.col("end"), F.col(prefix + "start"), F.col(prefix + "end")
    return both.where(overlaps(s, e, bs, be) & (F.col("_bin") == F.floor(F.greatest(s, bs) / width))).drop("_bin")


def intersect(s1: Column, e1: Column, s2: Column, e2: Column) -> tuple[Column, Column]:
    """Both ends of the common range; null if there is none."""
    s, e = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(s <= e, s), F.when(s <= e, e)


def union(df: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of overlapping intervals of each key: keys, start, end, n. Touching ones stay apart."""
    run = lines.islands(df, keys, "start", "end")
    return run.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def bounding(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def any_overlap(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any two intervals of a key overlap: keys, overlapping. For keys with few rows, such as the parts of a gene."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_o", F.coalesce(F.col("start") <= reach, F.lit(False))).groupBy(*keys).agg(F.max("_o").alias("overlapping"))
