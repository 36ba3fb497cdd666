"""Scores of gene models by transcript alignments: coverage of exons, confirmed introns, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import intervals, lines

#: Weights of confirmed introns, coverage, 5' and 3' untranslated lengths, and the lengths expected of a whole gene.
WEIGHTS = (0.6, 0.3, 0.05, 0.05)
EXPECTED = (400.0, 200.0, 100.0)


def coverage(exons: DataFrame, alignments: DataFrame, key: str = "gene_id") -> DataFrame:
    """key, covered, length, coverage: bases of exons that alignment parts of the same strand cover, by their union."""
    both = intervals.overlap_join(exons.select(key, "seqid", "strand", "start", "end"), alignments.select("seqid", "strand", "start", "end"), ["seqid", "strand"])
    s, e = intervals.intersect(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))
    cut = both.select(key, s.alias("start"), e.alias("end"))
    run = lines.islands(cut, [key], "start", "end")
    covered = run.groupBy(key, "island").agg((F.max("end") - F.min("start") + 1).alias("n")).groupBy(key).agg(F.sum("n").alias("covered"))
    size = exons.groupBy(key).agg(F.sum(F.col("end") - F.col("start") + 1).alias("length"))
    x = size.join(covered, key, "left").select(key, F.coalesce("covered", F.lit(0)).alias("covered"), "length")
    return x.withColumn("coverage", F.try_divide(F.col("covered").cast("double"), F.col("length").cast("double")))


def confirmed(introns: DataFrame, gaps: DataFrame, key: str = "gene_id") -> DataFrame:
    """key, n_introns, n_confirmed: introns with an alignment gap of the same range on the sequence; strands aren't compared."""
    g = gaps.select("seqid", "start", "end").distinct().withColumn("_g", F.lit(1))
    return introns.join(g, ["seqid", "start", "end"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("n_introns"), F.count("_g").alias("n_confirmed"))


def integrity(a: Column, b: Column, g: Column, e: Column, weights: tuple = WEIGHTS) -> Column:
    """Weighted sum of four shares, each at most 1. The weights must sum to 1."""
    if abs(sum(weights) - 1) > 1e-4:
        raise ValueError("weights must sum to 1")
    return sum((F.lit(w) * F.least(F.lit(1.0), x) for w, x in zip(weights, (a, b, g, e))), F.lit(0.0))
