"""Inference of missing gene structure. Windows run within one gene or transcript, whose parts are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.packed import values_of

#: Which type of parent a feature without one is given.
PARENTS = {"mRNA": "gene", "tRNA": "gene", "rRNA": "gene", "ncRNA": "gene"}


def infer_parents(f: DataFrame, mapping: dict[str, str] = PARENTS) -> DataFrame:
    """New parent rows for parentless features of the mapped types; the parts of one feature share a parent with their joint
    range: file_id, id, type, seqid, start, end, strand."""
    kinds = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    top = f.where((F.size(values_of("parent")) == 0) & F.col("type").isin(*mapping))
    own = F.coalesce("id", F.concat(F.lit("line"), F.col("line_no")))
    return top.groupBy("file_id", F.concat(F.lit("parent-"), own).alias("id"), kinds[F.col("type")].alias("type")).agg(
        F.min("seqid").alias("seqid"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("strand")
    )


def codons(cds: DataFrame, key: str = "gene_id") -> DataFrame:
    """Three bases at either end of the coding parts, by strand: key, strand, start and stop codon ranges."""
    x = cds.groupBy(key).agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.min("strand").alias("strand"))
    back = F.col("strand") == "-"
    left, right = F.struct(F.col("lo").alias("s"), (F.col("lo") + 2).alias("e")), F.struct((F.col("hi") - 2).alias("s"), F.col("hi").alias("e"))
    x = x.withColumn("a", F.when(back, right).otherwise(left)).withColumn("z", F.when(back, left).otherwise(right))
    return x.select(key, "strand", F.col("a.s").alias("start_s"), F.col("a.e").alias("start_e"), F.col("z.s").alias("stop_s"), F.col("z.e").alias("stop_e"))


def _between(exons: DataFrame, found: DataFrame, key: str) -> DataFrame:
    c = found.select(key, F.least("start_s", "stop_s").alias("lo"), F.greatest("start_e", "stop_e").alias("hi"))
    return exons.join(c, key)


def infer_cds(exons: DataFrame, found: DataFrame, key: str = "gene_id") -> DataFrame:
    """Exons clipped to the stretch from the left codon to the right one."""
    x = _between(exons, found, key).where((F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")))
    return x.select(key, "strand", F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"))


def utr_type(before: Column, strand: Column) -> Column:
    """Left of the coding stretch is 5' on the forward strand and 3' on the reverse."""
    return F.when(before == (strand != "-"), "five_prime_UTR").otherwise("three_prime_UTR")


def infer_utrs(exons: DataFrame, found: DataFrame, key: str = "gene_id") -> DataFrame:
    """Parts of exons outside of the coding stretch: key, type, start, end."""
    x = _between(exons, found, key)
    left = F.when(F.col("start") < F.col("lo"), F.struct(F.lit(True).alias("b"), F.col("start").alias("s"), F.least(F.col("end"), F.col("lo") - 1).alias("e")))
    right = F.when(F.col("end") > F.col("hi"), F.struct(F.lit(False).alias("b"), F.greatest(F.col("start"), F.col("hi") + 1).alias("s"), F.col("end").alias("e")))
    x = x.select(key, "strand", F.explode(F.filter(F.array(left, right), lambda r: r.isNotNull())).alias("r"))
    return x.select(key, "strand", utr_type(F.col("r.b"), F.col("strand")).alias("type"), F.col("r.s").alias("start"), F.col("r.e").alias("end"))


def phases(cds: DataFrame, key: str = "gene_id") -> DataFrame:
    """Phase of each coding part: bases to skip for the first whole codon; the first in reading direction has 0."""
    n = F.col("end") - F.col("start") + 1
    place = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    w = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(w), F.lit(0))
    return cds.withColumn("_p", place).withColumn("_n", n).withColumn("phase", F.pmod(3 - F.pmod(before, F.lit(3)), F.lit(3)).cast("int")).drop("_p", "_n")


def infer_exons(cds: DataFrame, utrs: DataFrame, key: str = "gene_id") -> DataFrame:
    """Each coding part together with the untranslated parts that touch it; untranslated parts that touch none stand alone."""
    u = utrs.select(key, F.col("start").alias("us"), F.col("end").alias("ue"))
    left = u.select(key, F.col("us").alias("ls"), (F.col("ue") + 1).alias("start"))
    right = u.select(key, F.col("ue").alias("re"), (F.col("us") - 1).alias("end"))
    x = cds.select(key, "start", "end").join(left, [key, "start"], "left").join(right, [key, "end"], "left")
    coding = x.select(key, F.coalesce("ls", "start").alias("start"), F.coalesce("re", "end").alias("end"))
    touched = cds.select(key, (F.col("start") - 1).alias("ue")).withColumn("side", F.lit(1))
    alone = u.join(touched.select(key, "ue"), [key, "ue"], "left_anti").join(cds.select(key, (F.col("end") + 1).alias("us")), [key, "us"], "left_anti")
    return coding.unionByName(alone.select(key, F.col("us").alias("start"), F.col("ue").alias("end"))).distinct()


def introns(parts: DataFrame, key: str, *, strict: bool = False) -> DataFrame:
    """Gaps between consecutive parts: key, start, end. ``strict`` gives a key none at all if two of its parts adjoin."""
    w = Window.partitionBy(key).orderBy("start", "end")
    x = parts.withColumn("_n", F.lead("start").over(w)).withColumn("_gap", F.col("_n") - F.col("end") - 1)
    if strict:
        x = x.withColumn("_bad", F.max(F.coalesce(F.col("_gap") <= 0, F.lit(False))).over(Window.partitionBy(key))).where(~F.col("_bad"))
    return x.where("_gap > 0").select(key, (F.col("end") + 1).alias("start"), (F.col("_n") - 1).alias("end"))


def shared(parts: DataFrame, keys: list[str], parent: str) -> DataFrame:
    """Parts of identical range once, with all their parents."""
    return parts.groupBy(*keys, "start", "end").agg(F.array_join(F.array_sort(F.collect_set(parent)), ",").alias("parents"), F.count(F.lit(1)).alias("n"))


def context(start: Column, end: Column, strand: Column, c: dict[str, Column], *, whole: bool = True) -> Column:
    """complete, start, stop, 5putr, 3putr or cds, from the ranges of both codons; introns (whole=False) touch no codon."""
    has = lambda s, e: (start <= e) & (end >= s)
    a, z = has(c["start_s"], c["start_e"]), has(c["stop_s"], c["stop_e"])
    lo, hi = F.least(c["start_s"], c["stop_s"]), F.greatest(c["start_e"], c["stop_e"])
    back = strand == "-"
    out = F.when(end < lo, F.when(back, "3putr").otherwise("5putr")).when(start > hi, F.when(back, "5putr").otherwise("3putr")).otherwise("cds")
    return F.when(a & z, "complete").when(a, "start").when(z, "stop").otherwise(out) if whole else out


def valid_transcripts(t: DataFrame) -> DataFrame:
    """Transcripts (with counts of their parts and the range of their gene) that have coding parts, one exon more than
    introns, and stay within their gene."""
    return t.where("n_cds > 0 AND n_exons = n_introns + 1 AND start >= g_start AND end <= g_end")


def representatives(t: DataFrame, group: list[str]) -> DataFrame:
    """The transcript with the longest coding sequence of each group; ties go to the smaller label. Where none codes, the last
    by position."""
    order = F.struct(
        F.col("cds_length"), F.when(F.col("cds_length") == 0, F.col("start")).otherwise(0).alias("p"), F.when(F.col("cds_length") == 0, F.col("end")).otherwise(0).alias("q")
    )
    best = t.groupBy(*group).agg(F.max(order).alias("_best"))
    x = t.join(best, group).where(order == F.col("_best"))
    return x.groupBy(*group).agg(F.min("label").alias("label"), F.max("cds_length").alias("cds_length"))
