"""Normalisers of raw lines for each kind of source: chains of native line rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import intervals
from strandline.operators.packed import values_of

SOURCES = ("refseq", "genbank", "hymbase", "beebase", "crg", "tair", "am10", "pdom", "local")


def _type() -> Column:
    return F.get(F.split("line", "\t"), F.lit(2))


def without_types(lines: DataFrame, *types: str) -> DataFrame:
    return lines.where(F.coalesce(~_type().isin(*types), F.lit(True)))


def without_patterns(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """Drops lines that match any of the regular expressions."""
    return lines.where(~F.col("line").rlike("|".join(f"(?:{p})" for p in patterns))) if patterns else lines


def first_of_each(lines: DataFrame) -> DataFrame:
    """Of lines alike in one file, the first."""
    return lines.groupBy("file", "line").agg(F.min("line_no").alias("line_no"))


def named(lines: DataFrame) -> DataFrame:
    """Features with an ID but no Name get their ID as Name. A carriage return at the end goes."""
    lines = lines.withColumn("line", F.rtrim("line", F.lit("\r")))
    ident = F.regexp_extract("line", r"(?:^|\t|;)\s*ID=([^;\n]+)", 1)
    lacks = (ident != "") & ~F.col("line").rlike(r"(?:\t|;)\s*Name=")
    return lines.withColumn("line", F.when(lacks, F.concat(F.regexp_replace("line", ";$", ""), F.lit(";Name="), F.btrim(ident))).otherwise(F.col("line")))


def from_glean(lines: DataFrame) -> DataFrame:
    """Gene predictions whose attributes read ``GenePrediction X`` get ID, Parent and Name."""
    who = F.regexp_extract("line", r"GenePrediction (\S+)", 1)
    attrs = F.when(_type() == "CDS", F.concat(F.lit("ID="), who, F.lit("-CDS;Parent="), who, F.lit(";Name="), who)).otherwise(F.concat(F.lit("ID="), who, F.lit(";Name="), who))
    head = F.array_join(F.slice(F.split("line", "\t"), 1, 8), "\t")
    return lines.withColumn("line", F.when(who != "", F.concat(head, F.lit("\t"), attrs)).otherwise(F.col("line")))


def renamed_scaffolds(lines: DataFrame, label: str) -> DataFrame:
    """scaffold_N and scaffoldN become <label>Scf_N, the first in each line."""
    return lines.withColumn("line", F.regexp_replace("line", r"^(.*?)scaffold_?", f"$1{label}Scf_"))


def headers(lines: DataFrame) -> DataFrame:
    """FASTA headers >gnl|x|id get the bare id in front."""
    bare = F.regexp_extract("line", r"^>gnl\|[^|]+\|(\S+)", 1)
    return lines.withColumn("line", F.when(bare != "", F.concat(F.lit(">"), bare, F.lit(" "), F.expr("substring(line, 2)"))).otherwise(F.col("line")))


def normalised(lines: DataFrame, source: str, label: str = "", exclude: list[str] = []) -> DataFrame:  # noqa: B006
    """Lines (file, line_no, line) of a source in the common form."""
    if source not in SOURCES:
        raise ValueError(f"no such source: {source}")
    lines = without_patterns(lines, exclude)
    if source in ("refseq", "genbank"):
        lines = without_types(lines, "region", "match", "cDNA_match").where(~F.startswith("line", F.lit("##species")))
    elif source in ("hymbase", "beebase"):
        lines = named(first_of_each(without_types(lines, "region")))
    elif source == "crg":
        lines = renamed_scaffolds(lines.withColumn("line", F.regexp_replace("line", r"^([^\t]*\t[^\t]*\t)transcript\t", "$1mRNA\t")), label)
    elif source == "tair":
        lines = lines.withColumn("line", F.regexp_replace("line", r"^(.*?)Index=", "$1index="))
    elif source == "am10":
        lines = from_glean(lines)
    elif source == "local":
        lines = lines.where(F.btrim("line") != "")
    return lines.select("file", "line_no", "line")


def protein_of(source: str, attributes: str = "attributes") -> Column:
    """The protein that a feature's attributes name, under the rules of its source; null where they name none."""
    pick = lambda p: F.nullif(F.regexp_extract(attributes, p, 1), F.lit(""))
    name, protein = pick(r"(?:^|;)\s*Name=([^;\n]+)"), pick(r"(?:^|;)\s*protein_id=([^;\n]+)")
    if source in ("refseq", "genbank"):
        return protein
    if source == "crg":
        return pick(r"(?:^|;)\s*Target=(\S+)")
    if source in ("hymbase", "beebase"):
        return F.replace(name, F.lit("-RA"), F.lit("-PA"))
    if source == "local":
        return F.coalesce(protein, name)
    return name


#: The type of the features that name proteins, for each source.
CARRIERS = {s: "CDS" if s in ("refseq", "genbank", "crg") else "mRNA" for s in SOURCES}


def protein_ids(features: DataFrame, source: str) -> DataFrame:
    """file_id, protein, first_line: the proteins that the coding features (or, for some sources, the transcripts) of a file name."""
    x = features.where(F.col("type") == CARRIERS[source]).select("file_id", "line_no", protein_of(source).alias("protein"))
    return x.where("protein IS NOT NULL").groupBy("file_id", "protein").agg(F.min("line_no").alias("first_line"))


def protein_map(features: DataFrame, gene_loci: DataFrame, source: str) -> DataFrame:
    """file_id, protein, locus: from the first feature that names a protein to its transcript, its gene, and the gene's locus.

    ``gene_loci`` has file_id, gene and locus, however genes were assigned to loci (:func:`linked_loci` follows Parent). Coding
    features of rearranged genes are left out. Proteins whose feature leads to no gene with a locus give no row.
    """
    x = features.where(F.col("type") == CARRIERS[source]).withColumn("protein", protein_of(source)).where("protein IS NOT NULL")
    if source in ("refseq", "genbank"):
        x = x.where(~F.contains("attributes", F.lit("exception=rearrangement required for product")))
    up = F.get(values_of("parent"), F.lit(0))
    first = x.groupBy("file_id", "protein").agg(F.min_by(up, F.struct("line_no", "id")).alias("up"))
    if CARRIERS[source] == "CDS":
        mrnas = features.where("type = 'mRNA' AND id IS NOT NULL").groupBy("file_id", F.col("id").alias("up")).agg(F.min_by(up, F.struct("line_no", "id")).alias("gene"))
        first = first.join(mrnas, ["file_id", "up"])
    else:
        first = first.withColumnRenamed("up", "gene")
    return first.join(gene_loci, ["file_id", "gene"]).select("file_id", "protein", "locus")


def linked_loci(features: DataFrame, name: Column) -> DataFrame:
    """file_id, gene, locus: the name of the locus feature that each gene has as its first parent."""
    loci = features.where("type = 'locus' AND id IS NOT NULL").groupBy("file_id", F.col("id").alias("up")).agg(F.min(name).alias("locus"))
    genes = features.where("type = 'gene' AND id IS NOT NULL").select("file_id", F.col("id").alias("gene"), F.get(values_of("parent"), F.lit(0)).alias("up")).distinct()
    return genes.join(loci, ["file_id", "up"]).select("file_id", "gene", "locus")


def contained_loci(features: DataFrame, loci: DataFrame) -> DataFrame:
    """file_id, gene, locus: the shortest gene locus (file_id, seqid, start, end, name) that holds the whole gene."""
    genes = features.where("type = 'gene' AND id IS NOT NULL").groupBy("file_id", F.col("id").alias("gene")).agg(F.min(F.struct("seqid", "start", "end")).alias("p")).select("file_id", "gene", "p.*")
    x = intervals.overlap_join(genes, loci.select("file_id", "seqid", "start", "end", "name"), ["file_id", "seqid"]).where("b_start <= start AND b_end >= end")
    return x.groupBy("file_id", "gene").agg(F.min_by("b_name", F.struct(F.col("b_end") - F.col("b_start"), F.col("b_start"), F.col("b_name"))).alias("locus"))
