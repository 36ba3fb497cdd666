"""Descriptive tables, summaries of loci, and compactness of genomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import sequence as Q

GENE_TYPES = ("siLocus", "ciLocus", "niLocus")
MERGED_TYPES = (*GENE_TYPES, "miLocus")
#: Fewest loci from which a quantile is taken.
ENOUGH = 20


def composition(counts: str, length: Column, digits: int = 6) -> dict[str, Column]:
    """GC content, GC skew and share of N from a struct of letter counts; 0 where there is nothing to divide by."""
    n = lambda k: F.col(f"{counts}.{k}")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)) + 1e-9, digits)  # noqa: E731  (halves go up)
    gc = n("g") + n("c") + n("s")
    return {"GCContent": ratio(gc, gc + n("at")), "GCSkew": ratio(n("g") - n("c"), n("g") + n("c")), "NContent": ratio(n("nx"), length)}


def described(df: DataFrame, seq: str, **columns: Column) -> DataFrame:
    """The columns given, and the composition of the sequence; rows whose sequence isn't as long as they say are left out."""
    x = df.withColumn("_ok", F.length(seq) == F.col("Length")).withColumn("_n", Q.letter_counts(F.col(seq))).where("_ok")
    return x.select(*[c.alias(n) for n, c in columns.items()], "Length", *[c.alias(n) for n, c in composition("_n", F.col("Length")).items()])


def ilocus_summary(loci: DataFrame) -> DataFrame:
    kinds = {"fiLoci": "fiLocus", "iiLoci": "iiLocus", "niLoci": "niLocus", "siLoci": "siLocus", "ciLoci": "ciLocus"}
    return loci.groupBy("species").agg(
        F.round(F.sum("effective_length") / 1_000_000, 6).alias("mb"), F.countDistinct("seqid").alias("n_seq"), *[F.count_if(F.col("ilocus_type") == t).alias(n) for n, t in kinds.items()]
    )


def _sum(value: str, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0)).cast("bigint")


def milocus_summary(loci: DataFrame, merged: DataFrame) -> DataFrame:
    """Number and occupancy of merged loci, quartiles of their genes, and singletons, for each species."""
    mi, single = F.col("ilocus_type") == "miLocus", F.col("ilocus_type").isin(*GENE_TYPES)
    quart = F.percentile(F.when(mi, F.col("gene_count")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    m = merged.groupBy("species").agg(
        F.count_if(mi).alias("n_miloci"), _sum("effective_length", mi).alias("occupancy"), _sum("effective_length", F.col("ilocus_type") != "fiLocus").alias("space"), quart.alias("q"), F.count_if(single).alias("singletons")
    )
    g = loci.groupBy("species").agg(F.count_if(single).alias("n_giloci"))
    pct = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) * 100, 6)
    return m.join(g, "species").select(
        "species", "n_miloci", "occupancy", pct("occupancy", "space").alias("percent"), F.round(F.get("q", F.lit(0)), 6).alias("q1"), F.round(F.get("q", F.lit(1)), 6).alias("q2"), F.round(F.get("q", F.lit(2)), 6).alias("q3"),
        "singletons", pct("singletons", "n_giloci").alias("singleton_percent"),
    )


def pilocus_summary(loci: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Protein-coding loci: number, occupancy, and transcripts (species, n_exons) of a single exon."""
    pi = F.col("ilocus_type").isin("siLocus", "ciLocus")
    a = loci.groupBy("species").agg(F.count_if(pi).alias("n_piloci"), _sum("effective_length", pi).alias("occupancy"), _sum("effective_length", F.col("ilocus_type") != "fiLocus").alias("space"))
    t = transcripts.groupBy("species").agg(F.count_if(F.col("n_exons") == 1).alias("single_exon"), F.count(F.lit(1)).alias("n_all"))
    pct = lambda x, y: F.round(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")) * 100, 6)
    return a.join(t, "species", "left").select("species", "n_piloci", "occupancy", pct("occupancy", "space").alias("percent"), F.coalesce("single_exon", F.lit(0)).alias("single_exon"), pct("single_exon", "n_all").alias("single_exon_percent"))


def thresholds(merged: DataFrame, iqnt: float = 0.95, gqnt: float = 0.05) -> DataFrame:
    """species, ithresh, gthresh: quantiles of the lengths of intergenic and of gene loci, cut to whole numbers; null for
    fewer than ENOUGH loci."""
    ii, gi = F.col("ilocus_type") == "iiLocus", F.col("ilocus_type").isin(*MERGED_TYPES)
    q = lambda c, x: F.when(F.count_if(c) >= ENOUGH, F.floor(F.round(F.percentile(F.when(c, F.col("length")), F.lit(x)), 6)))
    return merged.groupBy("species").agg(q(ii, iqnt).cast("bigint").alias("ithresh"), q(gi, gqnt).cast("bigint").alias("gthresh"))


def long_sequences(regions: DataFrame, least: int = 1_000_000) -> DataFrame:
    """species, seqid, length of the sequences (label, seqid, end) of at least so many bases."""
    r = regions.where("seqid IS NOT NULL AND label IS NOT NULL").where(F.col("end") >= least)
    return r.groupBy(F.col("label").alias("species"), "seqid").agg(F.max("end").alias("length"))


def compactness(loci: DataFrame, merged: DataFrame, long: DataFrame, iqnt: float = 0.95, gqnt: float = 0.05) -> DataFrame:
    """species, seqid, sigma, phi of the long sequences: the share of space in merged loci, and of gene loci that are merged."""
    keys = ["species", "seqid"]
    t = thresholds(merged, iqnt, gqnt)
    kind = F.col("ilocus_type")
    big = F.col("gthresh").isNull() | (F.col("length") >= F.col("gthresh"))
    g = loci.join(t, "species").groupBy(*keys).agg(F.count_if(kind.isin(*GENE_TYPES) & big).alias("n_gi"))
    trimmed = (kind == "iiLocus") & (F.col("length") > F.col("ithresh")) | kind.isin(*MERGED_TYPES) & (F.col("length") < F.col("gthresh"))
    m = merged.join(t, "species").groupBy(*keys).agg(
        F.count_if(kind.isin(*GENE_TYPES) & big).alias("n_single"),
        _sum("length", (kind == "miLocus") & big).alias("mi"),
        _sum("effective_length", (kind != "fiLocus") & ~F.coalesce(trimmed, F.lit(False))).alias("space"),
    )
    x = long.select(*keys).join(g, keys).join(m, keys).where("n_gi > 0")
    return x.select(*keys, F.round(F.try_divide(F.col("mi").cast("double"), F.col("space").cast("double")), 6).alias("sigma"), F.round((F.col("n_gi") - F.col("n_single")) / F.col("n_gi"), 6).alias("phi"))


def centroids(points: DataFrame, factor: float = 2.25) -> DataFrame:
    """species, sigma, phi: the mean point without points farther than ``factor`` times the mean distance."""
    mean = points.groupBy("species").agg(F.avg("sigma").alias("ms"), F.avg("phi").alias("mp"))
    x = points.join(mean, "species").withColumn("d", F.sqrt((F.col("sigma") - F.col("ms")) ** 2 + (F.col("phi") - F.col("mp")) ** 2))
    far = x.groupBy("species").agg(F.avg("d").alias("md"))
    kept = x.join(far, "species").where(F.col("d") <= F.col("md") * factor)
    return kept.groupBy("species").agg(F.round(F.avg("sigma"), 6).alias("sigma"), F.round(F.avg("phi"), 6).alias("phi"))
