"""Readers and writers of the text formats, as plans over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.lines import carried

#: Lines of a file that one task numbers or attributes to headers; more are settled by one summary row for each so many.
LINES = 1 << 18

# Metrics, operators and sources of a locus filter file.
_METRICS = {"LocusLength": "length", "GeneCount": "genes", "TranscriptCount": "mrnas", "ExonCount": "exons", "CDSLength": "cds"}
_OPERATORS = (">", ">=", "<", "<=", "=", "<>")


def filter_rules(text: str) -> list[tuple[str, str, int, str | None]]:
    """Rules of a filter file: metric, operator, value, source (R, P or none).

    A line is ``Metric Operator Value [R|P]``; blank lines and those that begin with # are left out.
    """
    rules = []
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.startswith("#"):
            continue
        metric, op, value, *source = line.split()
        if metric not in _METRICS or op not in _OPERATORS or source[:1] not in ([], ["R"], ["P"]):
            raise ValueError(f"line {n} is no filter: {line}")
        rules.append((metric, op, int(value), source[0] if source else None))
    return rules


def locus_filters(text: str) -> Column:
    """The conjunction of the rules of a filter file, over columns start, end, genes, r_/p_ mrnas, exons and cds; <> is no
    condition."""
    out = F.lit(True)
    for metric, op, value, source in filter_rules(text):
        if op == "<>":
            continue
        name = _METRICS[metric]
        if name == "length":
            x = F.col("end") - F.col("start") + 1
        elif name == "genes":
            x = F.col("genes")
        else:
            x = sum((F.col(f"{s}_{name}") for s in ([source.lower()] if source else ["r", "p"])), F.lit(0))
        v = F.lit(value)
        out = out & {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v, "=": x == v}[op]
    return out


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no, line of text files, compressed ones too. Numbers follow the order within each file.

    A file is read whole by one task only if it is compressed; numbers come from byte order within partitions of one file.
    """
    raw = spark.read.text(path, wholetext=False).select(F.input_file_name().alias("file"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    # partitions of a file are numbered in order; a count of each gives the offset of the next
    raw = raw.withColumn("_part", F.shiftright("_at", 33))
    sizes = raw.groupBy("file", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.withColumn("_off", F.sum("_n").over(Window.partitionBy("file").orderBy("_part")) - F.col("_n")).drop("_n")
    return raw.join(sizes, ["file", "_part"]).select("file", (F.col("_off") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "line")


def regions(lines: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """seqid, start, end of ##sequence-region pragmas."""
    p = r"^##sequence-region\s+(\S+)\s+(\d+)\s+(\d+)"
    hit = lines.where(F.col("line").rlike(p))
    g = lambda i: F.regexp_extract("line", p, i)
    return hit.select(*keep, g(1).alias("seqid"), g(2).try_cast("bigint").alias("start"), g(3).try_cast("bigint").alias("end"))


def fasta(lines: DataFrame) -> DataFrame:
    """file, defline, seqid, seq of FASTA lines (file, line_no, line): records are the runs from one > to the next."""
    x = lines.withColumn("line", F.rtrim("line", F.lit("\r")))
    x = carried(x, ["file"], ["line_no"], F.startswith("line", F.lit(">")), "_h", cell=LINES).withColumn("_r", F.col("_h.line_no")).where("_r IS NOT NULL")
    per = x.groupBy("file", "_r").agg(F.max(F.when(F.col("line_no") == F.col("_r"), F.col("line"))).alias("d"), F.array_sort(F.collect_list(F.when(F.col("line_no") > F.col("_r"), F.struct("line_no", "line")))).alias("s"))
    name = F.substring("d", F.lit(2), F.length("d"))
    return per.select("file", name.alias("defline"), F.get(F.split(name, r"\s+"), F.lit(0)).alias("seqid"), F.array_join(F.transform("s", lambda r: r["line"]), "").alias("seq"))


def clusters(lines: DataFrame) -> DataFrame:
    """file, cluster_id, idx, length, defline, species, accession of cluster listings: a header line, then its members."""
    head = F.startswith("line", F.lit(">Cluster "))
    x = carried(lines, ["file"], ["line_no"], head, "_h", cell=LINES).withColumn("_head", F.col("_h.line_no"))
    names = lines.where(head).select("file", F.col("line_no").alias("_head"), F.btrim(F.expr("substring(line, 10)")).alias("cluster_id"))
    x = x.where(~head & F.col("_head").isNotNull() & (F.btrim("line") != "")).join(names, ["file", "_head"])
    v = F.split("line", r"\s+")
    name = F.get(v, F.lit(2))
    return x.select(
        "file", "cluster_id", F.get(v, F.lit(0)).try_cast("int").alias("idx"), F.regexp_replace(F.get(v, F.lit(1)), "aa,$|nt,$", "").try_cast("int").alias("length"),
        name.alias("defline"), F.get(F.split(name, r"\|"), F.lit(1)).alias("species"), F.regexp_replace(F.get(F.split(name, r"\|"), F.lit(2)), r"\.\.\.$", "").alias("accession"),
    )


def id_list(lines: DataFrame) -> DataFrame:
    """The first word of each line that isn't blank."""
    return lines.select(F.get(F.split(F.btrim("line"), r"\s+"), F.lit(0)).alias("id")).where("id <> ''")


def gff3_text(f: DataFrame) -> DataFrame:
    """Features as lines of nine tab-separated columns, sorted by place: the column ``value`` for write.text."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    attrs = F.array_join(F.filter(F.array(F.when(F.col("id").isNotNull(), F.concat(F.lit("ID="), "id")), F.when(F.col("parent").isNotNull(), F.concat(F.lit("Parent="), "parent")), "attributes"), lambda x: x.isNotNull() & (x != "")), ";")
    score = F.when(F.col("score").isNotNull(), F.format_string("%.3g", "score")).otherwise(".")
    line = F.concat_ws("\t", "seqid", dot("source"), "type", "start", "end", score, dot("strand"), dot("phase"), F.when(attrs == "", ".").otherwise(attrs))
    return f.orderBy("seqid", "start", "end", "type").select(line.alias("value"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
