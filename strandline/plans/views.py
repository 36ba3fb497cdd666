"""Views on which the annotation queries run, as Spark plans and as SQL for the check.

Models of genes come from orders and line items: an order is a gene on the sequence of its customer, its line items are the
exons. Features, loci, regions and sequences come from the domain tables, repeated deliveries counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import kept, table

#: Every model sequence has this extent.
REGION_END = 30_000


def genes(spark: SparkSession, d: str) -> DataFrame:
    """gene_id, seqid, start, end, strand, derived once."""
    return kept(spark, "genes", d, lambda: _genes(spark, d))


def _genes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    begin = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("bigint") * 10 + 1
    g = o.select(
        F.col("o_orderkey").alias("gene_id"),
        F.concat(F.lit("seq"), "o_custkey").alias("seqid"),
        begin.alias("start"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END").alias("strand"),
        F.floor(F.col("o_totalprice") / 200).cast("bigint").alias("_more"),
    )
    last = _parts(spark, d).groupBy("gene_id").agg(F.max((F.col("rn") - 1) * 60 + F.col("qty") - 1).alias("_last"))
    g = g.join(last, "gene_id", "left")
    return g.select("gene_id", "seqid", "start", F.greatest(F.col("start") + 199 + F.col("_more"), F.col("start") + F.coalesce("_last", F.lit(0))).alias("end"), "strand")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("gene_id"),
        F.row_number().over(w).cast("bigint").alias("rn"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        (F.col("l_returnflag") != "R").alias("coding"),
        F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supp"),
    )


def exons(spark: SparkSession, d: str) -> DataFrame:
    """gene_id, rn, seqid, strand, start, end, code (C, F or T), and the raw marks that predictions and alignments use; derived once."""
    return kept(spark, "exons", d, lambda: _exons(spark, d))


def _exons(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).join(genes(spark, d).select("gene_id", "seqid", "strand", F.col("start").alias("g_start")), "gene_id")
    first = F.min(F.when(F.col("coding"), F.col("rn"))).over(Window.partitionBy("gene_id"))
    before = F.coalesce(F.col("rn") < first, F.lit(True))
    code = F.when(F.col("coding"), "C").when(before == (F.col("strand") != "-"), "F").otherwise("T")
    begin = F.col("g_start") + (F.col("rn") - 1) * 60
    return p.select("gene_id", "rn", "seqid", "strand", begin.alias("start"), (begin + F.col("qty") - 1).alias("end"), code.alias("code"), "coding", "status", "line", "supp", "qty")


def kept_exons(spark: SparkSession, d: str) -> DataFrame:
    """The exons as a written table, for plans that use them many times with different columns."""
    return exons(spark, d)


def predicted(spark: SparkSession, d: str, e: DataFrame | None = None) -> DataFrame:
    """A second annotation of the same genes, changed by rule: gene_id, seqid, strand, start, end, code."""
    e = (exons(spark, d) if e is None else e).withColumn("m", F.col("gene_id") % 6)
    e = e.where(~((F.col("m") == 3) & (F.col("status") == "O")) & ~((F.col("m") == 4) & F.col("coding") & (F.col("line") == 2)) & ~((F.col("m") == 5) & ~F.col("coding")))
    end = F.when(F.col("m").isin(1, 4) & (F.col("line") % 3 == 0) & (F.col("qty") > 1), F.col("end") - 1).otherwise(F.col("end"))
    flip = (F.col("m") == 2) & (F.col("rn") == 1)
    code = (
        F.when(flip & (F.col("code") == "C"), "F").when(flip, "C")
        .when((F.col("gene_id") % 12 == 6) & (F.col("code") == "F"), "T").when((F.col("gene_id") % 12 == 6) & (F.col("code") == "T"), "F").otherwise(F.col("code"))
    )
    return e.select("gene_id", "seqid", "strand", "start", end.alias("end"), code.alias("code"))


def alignments(spark: SparkSession, d: str, e: DataFrame | None = None) -> DataFrame:
    """Parts of transcript alignments: aln_id, seqid, strand, start, end."""
    e = exons(spark, d) if e is None else e
    even = e.where("supp % 2 = 0").select(F.concat(F.lit("a"), "gene_id").alias("aln_id"), "seqid", "strand", "start", "end")
    moved = e.where("line % 4 = 0").select(F.concat(F.lit("b"), "gene_id").alias("aln_id"), "seqid", "strand", (F.col("start") + 5).alias("start"), (F.col("end") + 5).alias("end"))
    return even.unionByName(moved)


def regions(spark: SparkSession, d: str) -> DataFrame:
    return genes(spark, d).select("seqid").distinct().select("seqid", F.lit(1).cast("bigint").alias("start"), F.lit(REGION_END).cast("bigint").alias("end"))


_FEATURE = ["file_id", "line_no", "seqid", "source", "type", "start", "end", "score", "strand", "phase", "id", "parent", "accession", "attributes"]


def features(spark: SparkSession, d: str) -> DataFrame:
    """Placed features, repeated deliveries once."""
    f = table(spark, d, "features").select(*_FEATURE)
    return f.where("file_id IS NOT NULL AND seqid IS NOT NULL AND type IS NOT NULL AND start <= end").distinct()


def loci(spark: SparkSession, d: str) -> DataFrame:
    """The delivered iLoci, once each, with sound coordinates; the species is that of the file's label."""
    x = table(spark, d, "locus").drop("row_id", "loaded_at").distinct()
    return x.where("seqid IS NOT NULL AND start <= end").withColumn("species", F.substring_index("file_id", ".", 1)).withColumn("length", F.col("end") - F.col("start") + 1)


SQL = {
    "parts": """parts AS (SELECT l_orderkey AS gene_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn,
  CAST(l_quantity AS BIGINT) AS qty, l_returnflag <> 'R' AS coding, l_linestatus AS status, l_linenumber AS line, l_suppkey AS supp FROM lineitem)""",
    "genes": """genes AS (SELECT o_orderkey AS gene_id, 'seq' || o_custkey AS seqid, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 10 + 1 AS s,
  greatest(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 10 + 1 + 199 + CAST(floor(o_totalprice / 200) AS BIGINT),
    date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 10 + 1 + coalesce(x, 0)) AS e,
  CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand
  FROM orders LEFT JOIN (SELECT gene_id, max((rn - 1) * 60 + qty - 1) AS x FROM parts GROUP BY 1) m ON m.gene_id = o_orderkey)""",
    "exons": """exons AS (SELECT p.*, g.seqid, g.strand, g.s + (rn - 1) * 60 AS s, g.s + (rn - 1) * 60 + qty - 1 AS e,
  CASE WHEN coding THEN 'C' WHEN coalesce(rn < min(CASE WHEN coding THEN rn END) OVER (PARTITION BY p.gene_id), true) = (g.strand <> '-') THEN 'F' ELSE 'T' END AS code
  FROM parts p JOIN genes g ON p.gene_id = g.gene_id)""",
    "pred": """pred AS (SELECT gene_id, seqid, strand, s, CASE WHEN gene_id % 6 IN (1, 4) AND line % 3 = 0 AND qty > 1 THEN e - 1 ELSE e END AS e,
  CASE WHEN gene_id % 6 = 2 AND rn = 1 THEN CASE code WHEN 'C' THEN 'F' ELSE 'C' END WHEN gene_id % 12 = 6 AND code = 'F' THEN 'T' WHEN gene_id % 12 = 6 AND code = 'T' THEN 'F' ELSE code END AS code
  FROM exons WHERE NOT (gene_id % 6 = 3 AND status = 'O') AND NOT (gene_id % 6 = 4 AND coding AND line = 2) AND NOT (gene_id % 6 = 5 AND NOT coding))""",
    "aln": """aln AS (SELECT 'a' || gene_id AS aln_id, seqid, strand, s, e FROM exons WHERE supp % 2 = 0 UNION ALL SELECT 'b' || gene_id, seqid, strand, s + 5, e + 5 FROM exons WHERE line % 4 = 0)""",
    "feats": """feats AS (SELECT DISTINCT file_id, line_no, seqid, source, type, "start" AS s, "end" AS e, score, strand, phase, id, parent, accession, attributes FROM features
  WHERE file_id IS NOT NULL AND seqid IS NOT NULL AND type IS NOT NULL AND "start" <= "end")""",
    "loci": """loci AS (SELECT DISTINCT locus_id, name, file_id, seqid, "start" AS s, "end" AS e, ilocus_type, n_children, left_overlap, right_overlap, liil, riil, effective_length,
  iilocus_exception, fg_orient, split_part(file_id, '.', 1) AS species, "end" - "start" + 1 AS len FROM locus WHERE seqid IS NOT NULL AND "start" <= "end")""",
}
_NEEDS = {"genes": ["parts"], "exons": ["parts", "genes"], "pred": ["exons"], "aln": ["exons"]}


def with_views(*names: str) -> str:
    """The head of a query: WITH and the views named, and those that they need."""
    done: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in done)
