"""Filters, labels and trees of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import attributes as A
from strandline.functions.types import SEGMENTS, TRANSCRIPTS, is_a
from strandline.operators import hierarchy
from strandline.operators.packed import values_of


def labels() -> Column:
    """Accession, else Name, else id, else type and place."""
    place = F.concat("type", F.lit(":"), "seqid", F.lit("_"), "start", F.lit("-"), "end", F.coalesce("strand", F.lit(".")))
    return F.coalesce("accession", A.get("attributes", "Name"), "id", place)


def links(f: DataFrame) -> DataFrame:
    """file_id, child (line_no), child id, parent id: one row for each value of a feature's parent."""
    return f.where("parent IS NOT NULL").select("file_id", "line_no", "id", "type", F.explode(F.array_distinct(values_of("parent"))).alias("parent_id"))


def with_parents(f: DataFrame) -> DataFrame:
    """Each feature with each of its parents in the same file: parent_id, parent_type, parent_accession."""
    p = f.where("id IS NOT NULL").select("file_id", F.col("id").alias("parent_id"), F.col("type").alias("parent_type"), F.col("accession").alias("parent_accession")).distinct()
    return f.withColumn("parent_id", F.explode(F.array_distinct(values_of("parent")))).join(p, ["file_id", "parent_id"])


def closure(f: DataFrame) -> DataFrame:
    """file_id, id, top: each named feature with the top-level features above it; none for those on or below a cycle."""
    return hierarchy.depths(f, "file_id", "id", "parent").where("depth >= 0").select("file_id", F.col("feature_id").alias("id"), F.col("root_id").alias("top"))


def under(f: DataFrame, keep: Column) -> DataFrame:
    """Top-level features with what satisfies ``keep`` at or below them: file_id, top, and the feature's columns."""
    tops = closure(f)
    named = f.where(keep & F.col("id").isNotNull()).join(tops, ["file_id", "id"])
    # features without an id hang below their parents
    loose = f.where(keep & F.col("id").isNull() & F.col("parent").isNotNull()).withColumn("_p", F.explode(F.array_distinct(values_of("parent"))))
    loose = loose.join(tops.select("file_id", F.col("id").alias("_p"), "top"), ["file_id", "_p"]).drop("_p").dropDuplicates(["file_id", "line_no", "top"])
    return named.unionByName(loose)


def without_trees(f: DataFrame, offending: Column) -> DataFrame:
    """Drops every tree of which any feature satisfies ``offending``, whole."""
    tops = closure(f)
    bad = under(f, offending).select("file_id", "top").distinct()
    gone = tops.join(bad, ["file_id", "top"], "left_semi").select("file_id", F.col("id").alias("_x")).distinct()
    kept = f.join(gone.withColumnRenamed("_x", "id"), ["file_id", "id"], "left_anti")
    below = kept.where("id IS NULL AND parent IS NOT NULL").select("file_id", "line_no", F.explode(values_of("parent")).alias("_x")).join(gone, ["file_id", "_x"], "left_semi").select("file_id", "line_no").distinct()
    return kept.join(below, ["file_id", "line_no"], "left_anti")


def pseudogenes_fixed(f: DataFrame) -> DataFrame:
    """Genes marked pseudo=true become pseudogenes, and what is below them gets pseudogenic types."""
    flag = (is_a("gene") | is_a("pseudogene")) & (A.get("attributes", "pseudo") == "true")
    bad = f.where(flag & F.col("id").isNotNull()).select("file_id", F.col("id").alias("top")).distinct()
    ids = closure(f).join(bad, ["file_id", "top"], "left_semi").select("file_id", "id").distinct().withColumn("_named", F.lit(True))
    x = f.join(ids, ["file_id", "id"], "left")
    below = f.where("id IS NULL AND parent IS NOT NULL").select("file_id", "line_no", F.explode(values_of("parent")).alias("id")).join(ids, ["file_id", "id"], "left_semi").select("file_id", "line_no").distinct().withColumn("_loose", F.lit(True))
    x = x.join(below, ["file_id", "line_no"], "left")
    inside = F.coalesce("_named", "_loose", F.lit(False))
    t = F.col("type")
    fixed = (
        F.when(flag, "pseudogene").when(~inside, t).when(t.isin("mRNA", "transcript"), "pseudogenic_transcript").when(t == "exon", "pseudogenic_exon").when(t == "CDS", "pseudogenic_CDS").otherwise(t)
    )
    return x.withColumn("type", fixed).drop("_named", "_loose")


#: Where each source keeps the accession of genes and transcripts: attribute keys, tried in order.
SOURCES = {
    "refseq": (["GeneID"], ["transcript_id"]),
    "genbank": (["Name"], []),
    "crg": (["ID"], ["ID"]),
    "pdom": (["Name"], ["ID"]),
    "tair": (["Name"], ["Name"]),
    "beebase": (["Name"], ["Name"]),
    "hymbase": (["Name"], ["Name"]),
    "am10": ([], ["Name"]),
    "local": (["accession", "Name"], ["protein_id", "accession", "Name"]),
}


def _value(key: str) -> Column:
    if key == "ID":
        return F.col("id")
    if key == "accession":
        return F.col("accession")
    if key == "GeneID":
        v = F.regexp_extract("attributes", r"GeneID:([^;,|/ \"']+)", 1)
        return F.when(v != "", v)
    return A.get("attributes", key)


def accessions(f: DataFrame, source: str) -> DataFrame:
    """file_id, line_no, found: the accession that a feature gets under the rules of its source; parts inherit through their
    first parent. One that a feature has already is kept."""
    gene, transcript = SOURCES[source]
    first = lambda keys: F.coalesce(*[_value(k) for k in keys], F.lit(None).cast("string"))
    own = F.when(is_a("gene"), first(gene)).when(F.col("type").isin(*TRANSCRIPTS), F.coalesce(first(transcript), *([F.concat(_value("GeneID"), F.lit(":"), "type")] if source == "refseq" else [])))
    own = F.when(F.col("type").isin(*SEGMENTS, "gene_segment"), _value("GeneID")).otherwise(own)
    x = f.withColumn("_own", own).withColumn("_up", F.get(values_of("parent"), F.lit(0)))
    if source == "genbank":  # transcripts are named after their gene and their type, and hand that on
        genes = x.where(is_a("gene") & F.col("id").isNotNull()).groupBy("file_id", F.col("id").alias("_up")).agg(F.min("_own").alias("_gene"))
        named = F.when(F.col("type").isin(*TRANSCRIPTS), F.concat("_gene", F.lit("."), "type"))
        x = x.join(genes, ["file_id", "_up"], "left").withColumn("_own", F.coalesce("_own", named)).drop("_gene")
    by = x.where("id IS NOT NULL AND _own IS NOT NULL").groupBy("file_id", F.col("id").alias("_up")).agg(F.min("_own").alias("_theirs"))
    x = x.join(by, ["file_id", "_up"], "left")
    part = F.col("type").isin("exon", "intron", "CDS")
    theirs = F.when(part, F.col("_theirs"))
    return x.select("file_id", "line_no", "type", F.coalesce("accession", "_own", theirs).alias("found"))


def aligned(f: DataFrame) -> DataFrame:
    """Two tiers of alignment (match and match_part) as one: parts take the id and type of their match, whose row is dropped."""
    p = f.where("id IS NOT NULL AND type IN ('match', 'cDNA_match', 'EST_match', 'nucleotide_match', 'protein_match')").select("file_id", F.col("id").alias("_m"), F.col("type").alias("_t")).distinct()
    parts = f.where("type = 'match_part'").withColumn("_m", F.get(values_of("parent"), F.lit(0))).join(p, ["file_id", "_m"])
    return parts.select("file_id", "line_no", F.col("_m").alias("id"), F.col("_t").alias("type"), "seqid", "start", "end", "strand")


def profile(f: DataFrame) -> DataFrame:
    """Counts of each type, in all and at the top, and of each pair of child and parent types."""
    kinds = f.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parent").isNull()).alias("n_top")).select(F.col("type").alias("child"), F.lit(None).cast("string").alias("parent"), "n", "n_top")
    pairs = with_parents(f).groupBy(F.col("type").alias("child"), F.col("parent_type").alias("parent")).agg(F.count(F.lit(1)).alias("n")).withColumn("n_top", F.lit(None).cast("bigint"))
    return kinds.unionByName(pairs)
