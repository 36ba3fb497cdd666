"""Queries on descriptive tables, summaries and compactness."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import sequence as Q
from strandline.operators import loci, summaries
from strandline.operators import structure as S
from strandline.plans import loci_queries as L
from strandline.plans import model_queries as M
from strandline.plans import views as V
from strandline.plans.catalog import Catalog
from strandline.session import ship, table

C = Catalog()
W = V.with_views

#: The letters of a model sequence repeat this stretch.
MOTIF = "ACGTTGCAANCGGTSAATCWGGXCA"


def with_sequence(df):
    spark = df.sparkSession
    ship(spark)
    # few small rows become long sequences: without a number of its own, the shuffle would be coalesced to one task
    return _with_sequence(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "start", "end"))


def _with_sequence(df):
    """Adds seq: the letters of a model sequence from start to end."""
    m = len(MOTIF)
    long = F.repeat(F.lit(MOTIF), F.floor((F.col("end") - F.col("start")) / m).cast("int") + 2)
    return df.withColumn("seq", F.substring(long, F.pmod(F.col("start") - 1, F.lit(m)).cast("int") + 1, (F.col("end") - F.col("start") + 1).cast("int")))


_SEQ = f"substr(repeat('{MOTIF}', CAST(({{e}} - {{s}}) // {len(MOTIF)} + 2 AS INTEGER)), ({{s}} - 1) % {len(MOTIF)} + 1, {{e}} - {{s}} + 1)"


def _n(letters: str) -> str:
    return f"length(regexp_replace(seq, '[^{letters}]', '', 'g'))"


_COMP = f"""round(coalesce({_n("CGS")} / nullif({_n("ATWCGS")}, 0)::DOUBLE, 0) + 1e-9::DOUBLE, 6) AS "GCContent", round(coalesce(({_n("G")} - {_n("C")}) / nullif({_n("CG")}, 0)::DOUBLE, 0) + 1e-9::DOUBLE, 6) AS "GCSkew", round(coalesce({_n("NX")} / nullif(length(seq), 0)::DOUBLE, 0) + 1e-9::DOUBLE, 6) AS "NContent\""""


@C.add("ilocus_desc", W("exons") + L._extended() + f""",
cod AS (SELECT g.seqid, g.isle, coalesce(bool_or(x.code = 'C'), false) AS c FROM m2 g LEFT JOIN exons x ON x.gene_id = g.gene_id GROUP BY ALL),
everything AS ({L._all(500)}),
t AS (SELECT a.*, CASE kind WHEN 'fi' THEN 'fiLocus' WHEN 'ii' THEN 'iiLocus' ELSE CASE WHEN NOT cod.c THEN 'niLocus' WHEN n_genes > 1 THEN 'ciLocus' ELSE 'siLocus' END END AS class, {_SEQ.format(s='a."start"', e='a."end"')} AS seq
  FROM everything a LEFT JOIN core ON core.seqid = a.seqid AND core.s = a.core_start LEFT JOIN cod ON cod.seqid = core.seqid AND cod.isle = core.isle)
SELECT seqid || '_' || "start" || '-' || "end" AS "LocusPos", seqid AS "SeqID", "end" - "start" + 1 AS "Length", CAST("end" - "start" + 1 - ceil(coalesce(left_overlap, 0) / 2.0) - floor(coalesce(right_overlap, 0) / 2.0) AS BIGINT) AS "EffectiveLength",
{_COMP}, class AS "LocusClass", coalesce(n_genes, 0) AS "GeneCount", coalesce(orient, 'NA') AS "FlankGeneOrient" FROM t""")  # fmt: skip
def ilocus_desc(spark, d):
    x = with_sequence(L.classified_loci(spark, d)).withColumn("Length", F.col("end") - F.col("start") + 1)
    return summaries.described(
        x, "seq", LocusPos=F.concat("seqid", F.lit("_"), "start", F.lit("-"), "end"), SeqID=F.col("seqid"),
        EffectiveLength=loci.effective_length(F.col("start"), F.col("end"), F.col("left_overlap"), F.col("right_overlap")), LocusClass=F.col("ilocus_type"), GeneCount=F.coalesce("n_genes", F.lit(0)), FlankGeneOrient=F.coalesce("orient", F.lit("NA")),
    )


@C.add("premrna_desc", W("exons") + M._COD + f""",
x AS (SELECT gene_id, count(*) AS n FROM exons GROUP BY 1), u AS (SELECT gene_id, CAST(coalesce(sum(e - s + 1) FILTER (before = (strand <> '-')), 0) AS BIGINT) AS u5, CAST(coalesce(sum(e - s + 1) FILTER (before <> (strand <> '-')), 0) AS BIGINT) AS u3 FROM utr GROUP BY 1)
SELECT 'm' || g.gene_id AS "Accession", g.e - g.s + 1 AS "Length", {_COMP.replace("seq,", "q.seq,").replace("(seq)", "(q.seq)")}, x.n AS "ExonCount", x.n - 1 AS "IntronCount", coalesce(u5, 0) AS "5pUTRlen", coalesce(u3, 0) AS "3pUTRlen"
FROM genes g JOIN x ON x.gene_id = g.gene_id LEFT JOIN u ON u.gene_id = g.gene_id JOIN (SELECT gene_id, {_SEQ.format(s="s", e="e")} AS seq FROM genes) q ON q.gene_id = g.gene_id""")  # fmt: skip
def _(spark, d):
    n = F.col("end") - F.col("start") + 1
    of = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, n)), F.lit(0))
    u = M._utrs(spark, d).groupBy("gene_id").agg(of("five_prime_UTR").alias("u5"), of("three_prime_UTR").alias("u3"))
    x = V.exons(spark, d).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))
    g = with_sequence(V.genes(spark, d)).withColumn("Length", n).join(x, "gene_id").join(u, "gene_id", "left").na.fill(0, ["u5", "u3"])
    return summaries.described(g, "seq", Accession=F.concat(F.lit("m"), "gene_id"), ExonCount=F.col("n"), IntronCount=F.col("n") - 1, **{"5pUTRlen": F.col("u5"), "3pUTRlen": F.col("u3")})


def _spliced(parts):
    p = with_sequence(parts).groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "strand"))).alias("p"), F.sum(F.col("end") - F.col("start") + 1).alias("Length"))
    forward = F.array_join(F.transform("p", lambda r: r["seq"]), "")
    return p.withColumn("seq", F.when(F.get("p", F.lit(0)).getField("strand") == "-", Q.reverse_complement(forward)).otherwise(forward))


def _spliced_sql(parts: str) -> str:
    return f"""(SELECT gene_id, CAST(sum(e - s + 1) AS BIGINT) AS len, CASE WHEN min(strand) = '-' THEN reverse(translate(string_agg({_SEQ.format(s="s", e="e")}, '' ORDER BY s), 'ACGTUWSMKRYBDHVN', 'TGCAAWSKMYRVHDBN')) ELSE string_agg({_SEQ.format(s="s", e="e")}, '' ORDER BY s) END AS seq FROM {parts} GROUP BY 1)"""


@C.add("mrna_desc", W("exons") + f""" SELECT 'm' || gene_id AS "Accession", len AS "Length", {_COMP} FROM {_spliced_sql("exons")}""")
def _(spark, d):
    x = _spliced(V.exons(spark, d).select("gene_id", "start", "end", "strand"))
    return summaries.described(x, "seq", Accession=F.concat(F.lit("m"), "gene_id"))


@C.add("cds_desc", W("exons") + M._COD + f""" SELECT 'm' || gene_id AS "MrnaAcc", len AS "Length", {_COMP} FROM {_spliced_sql("cds")}""")
def _(spark, d):
    x = _spliced(M._cds(spark, d))
    return summaries.described(x, "seq", MrnaAcc=F.concat(F.lit("m"), "gene_id"))


_FIRST = """SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY seqid, strand, s, e ORDER BY gene_id) AS rk FROM ({0})) WHERE rk = 1"""


@C.add("distinct_exons", W("exons") + """ SELECT seqid, strand, s AS "start", e AS "end", min(gene_id) AS first_gene, count(*) AS n FROM exons GROUP BY ALL""")
def _(spark, d):
    return V.exons(spark, d).groupBy("seqid", "strand", "start", "end").agg(F.min("gene_id").alias("first_gene"), F.count(F.lit(1)).alias("n"))


@C.add("exon_desc", W("exons") + M._COD + f""",
c AS (SELECT x.*, CASE WHEN x.s <= a2 AND x.e >= a1 AND x.s <= z2 AND x.e >= z1 THEN 'complete' WHEN x.s <= a2 AND x.e >= a1 THEN 'start' WHEN x.s <= z2 AND x.e >= z1 THEN 'stop' ELSE {M._CTX.format(c="x.")} END AS context FROM exons x JOIN cod ON cod.gene_id = x.gene_id),
f AS ({_FIRST.format("SELECT gene_id, seqid, strand, s, e, context FROM c")}),
ph AS (SELECT gene_id, s, e, (3 - coalesce(sum(e - s + 1) OVER (PARTITION BY gene_id ORDER BY CASE WHEN strand = '-' THEN -s ELSE s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS phase FROM cds)
SELECT seqid || '_' || f.s || '-' || f.e || strand AS "ExonPos", 'm' || f.gene_id AS "MrnaAcc", f.e - f.s + 1 AS "Length", {_COMP}, context AS "Context", CASE WHEN context = 'cds' THEN CAST(phase AS INTEGER) END AS "Phase", CASE WHEN context = 'cds' THEN CAST((f.e - f.s + 1 - phase + 3) % 3 AS INTEGER) END AS "Remainder"
FROM (SELECT *, {_SEQ.format(s="s", e="e")} AS seq FROM f) f LEFT JOIN ph ON ph.gene_id = f.gene_id AND ph.s = f.s AND ph.e = f.e""")  # fmt: skip
def _(spark, d):
    keys = ["seqid", "strand", "start", "end"]
    x = V.exons(spark, d).join(M.C.queries["exon_context"](spark, d), ["gene_id", "rn"])
    x = x.groupBy(*keys).agg(F.min(F.struct("gene_id", "context")).alias("r")).select(*keys, "r.*")
    ph = S.phases(M._cds(spark, d)).select("gene_id", "start", "end", "phase")
    x = with_sequence(x).withColumn("Length", F.col("end") - F.col("start") + 1).join(ph, ["gene_id", "start", "end"], "left")
    inner = F.col("context") == "cds"
    return summaries.described(
        x, "seq", ExonPos=F.concat("seqid", F.lit("_"), "start", F.lit("-"), "end", "strand"), MrnaAcc=F.concat(F.lit("m"), "gene_id"), Context=F.col("context"), Phase=F.when(inner, F.col("phase")), Remainder=F.when(inner, F.pmod(F.col("Length") - F.col("phase"), F.lit(3)).cast("int"))
    )


@C.add("intron_desc", W("exons") + M._COD + M._INTRONS + f""",
c AS (SELECT x.*, {M._CTX.format(c="x.")} AS context FROM intr x JOIN cod ON cod.gene_id = x.gene_id), f AS ({_FIRST.format("SELECT gene_id, seqid, strand, s, e, context FROM c")})
SELECT seqid || '_' || s || '-' || e || strand AS "IntronPos", 'm' || gene_id AS "MrnaAcc", e - s + 1 AS "Length", {_COMP}, context AS "Context" FROM (SELECT *, {_SEQ.format(s="s", e="e")} AS seq FROM f)""")  # fmt: skip
def _(spark, d):
    keys = ["seqid", "strand", "start", "end"]
    ctx = M.C.queries["intron_context"](spark, d)
    x = M._introns(spark, d).join(ctx, ["gene_id", "start"])
    x = x.groupBy(*keys).agg(F.min(F.struct("gene_id", "context")).alias("r")).select(*keys, "r.*")
    x = with_sequence(x).withColumn("Length", F.col("end") - F.col("start") + 1)
    return summaries.described(x, "seq", IntronPos=F.concat("seqid", F.lit("_"), "start", F.lit("-"), "end", "strand"), MrnaAcc=F.concat(F.lit("m"), "gene_id"), Context=F.col("context"))


# summaries

_MI = """,
x0 AS (SELECT *, coalesce(ilocus_type IN ('siLocus', 'niLocus') AND coalesce(iilocus_exception, '') <> 'intron-gene', false) AS can FROM loci),
y0 AS (SELECT *, sum(CASE WHEN can THEN 0 ELSE 1 END) OVER (PARTITION BY file_id, seqid ORDER BY s, e, locus_id) AS stop FROM x0),
mi AS (SELECT any_value(species) AS species, seqid, max(e) - min(s) + 1 AS len, CASE WHEN can AND count(*) > 1 THEN 'miLocus' ELSE min(ilocus_type) END AS ilocus_type,
  CAST(sum(coalesce(n_children, 0)) AS BIGINT) AS gene_count, CAST(sum(coalesce(effective_length, 0)) AS BIGINT) AS effective_length FROM y0 GROUP BY file_id, seqid, can, stop)"""
_GI = "('siLocus', 'ciLocus', 'niLocus')"


def _mi(spark, d):
    x = loci.merged_loci(V.loci(spark, d), ["file_id", "seqid"])
    return x.withColumn("species", F.substring_index("file_id", ".", 1)).withColumn("length", F.col("end") - F.col("start") + 1)


@C.add("ilocus_summary", W("loci") + """ SELECT species, round(sum(effective_length) / 1000000.0, 6) AS mb, count(DISTINCT seqid) AS n_seq, count(*) FILTER (ilocus_type = 'fiLocus') AS "fiLoci", count(*) FILTER (ilocus_type = 'iiLocus') AS "iiLoci",
count(*) FILTER (ilocus_type = 'niLocus') AS "niLoci", count(*) FILTER (ilocus_type = 'siLocus') AS "siLoci", count(*) FILTER (ilocus_type = 'ciLocus') AS "ciLoci" FROM loci GROUP BY species""")  # fmt: skip
def ilocus_summary(spark, d):
    return summaries.ilocus_summary(V.loci(spark, d))


@C.add("milocus_summary", W("loci") + _MI + f""",
a AS (SELECT species, count(*) FILTER (ilocus_type = 'miLocus') AS n_miloci, CAST(coalesce(sum(effective_length) FILTER (ilocus_type = 'miLocus'), 0) AS BIGINT) AS occupancy, sum(effective_length) FILTER (ilocus_type <> 'fiLocus') AS space,
  quantile_cont(gene_count, [0.25, 0.5, 0.75]) FILTER (ilocus_type = 'miLocus') AS q, count(*) FILTER (ilocus_type IN {_GI}) AS singletons FROM mi GROUP BY 1),
b AS (SELECT species, count(*) FILTER (ilocus_type IN {_GI}) AS n FROM loci GROUP BY 1)
SELECT a.species, n_miloci, occupancy, round(occupancy / space::DOUBLE * 100, 6) AS percent, round(q[1], 6) AS q1, round(q[2], 6) AS q2, round(q[3], 6) AS q3, singletons, round(singletons / n::DOUBLE * 100, 6) AS singleton_percent FROM a JOIN b ON a.species = b.species""")  # fmt: skip
def _(spark, d):
    return summaries.milocus_summary(V.loci(spark, d), _mi(spark, d))


@C.add("pilocus_summary", W("loci") + """ SELECT a.species, n_piloci, occupancy, round(occupancy / space::DOUBLE * 100, 6) AS percent, coalesce(single_exon, 0) AS single_exon, round(single_exon / n_all::DOUBLE * 100, 6) AS single_exon_percent FROM
(SELECT species, count(*) FILTER (ilocus_type IN ('siLocus', 'ciLocus')) AS n_piloci, CAST(coalesce(sum(effective_length) FILTER (ilocus_type IN ('siLocus', 'ciLocus')), 0) AS BIGINT) AS occupancy, sum(effective_length) FILTER (ilocus_type <> 'fiLocus') AS space FROM loci GROUP BY 1) a
LEFT JOIN (SELECT split_part(file_id, '.', 1) AS species, count(*) FILTER (n_exons = 1) AS single_exon, count(*) AS n_all FROM (""" + M._MRNA + """ SELECT file_id, n_exons FROM t) GROUP BY 1) b ON b.species = a.species""")  # fmt: skip
def _(spark, d):
    t = M._transcripts(spark, d).withColumn("species", F.substring_index("file_id", ".", 1))
    return summaries.pilocus_summary(V.loci(spark, d), t)


_THR = f"""{_MI},
thr AS (SELECT species, CASE WHEN count(*) FILTER (ilocus_type = 'iiLocus') >= 20 THEN CAST(floor(round(quantile_cont(len, 0.95) FILTER (ilocus_type = 'iiLocus'), 6)) AS BIGINT) END AS ithresh,
  CASE WHEN count(*) FILTER (ilocus_type IN ('siLocus', 'ciLocus', 'niLocus', 'miLocus')) >= 20 THEN CAST(floor(round(quantile_cont(len, 0.05) FILTER (ilocus_type IN ('siLocus', 'ciLocus', 'niLocus', 'miLocus')), 6)) AS BIGINT) END AS gthresh FROM mi GROUP BY 1)"""  # fmt: skip


@C.add("compact_thresholds", W("loci") + _THR + " SELECT * FROM thr")
def _(spark, d):
    return summaries.thresholds(_mi(spark, d))


_LONG = """, long AS (SELECT label AS species, seqid, max("end") AS length FROM regions WHERE seqid IS NOT NULL AND label IS NOT NULL AND "end" >= 100000 GROUP BY ALL)"""
_COMPACT = _THR + _LONG + f""",
gg AS (SELECT l.species, seqid, count(*) FILTER (ilocus_type IN {_GI} AND (gthresh IS NULL OR len >= gthresh)) AS n_gi FROM loci l JOIN thr ON thr.species = l.species GROUP BY ALL),
mm AS (SELECT mi.species, seqid, count(*) FILTER (ilocus_type IN {_GI} AND (gthresh IS NULL OR len >= gthresh)) AS n_single, coalesce(sum(len) FILTER (ilocus_type = 'miLocus' AND (gthresh IS NULL OR len >= gthresh)), 0) AS m,
  coalesce(sum(effective_length) FILTER (ilocus_type <> 'fiLocus' AND NOT coalesce((ilocus_type = 'iiLocus' AND len > ithresh) OR (ilocus_type IN ('siLocus', 'ciLocus', 'niLocus', 'miLocus') AND len < gthresh), false)), 0) AS space FROM mi JOIN thr ON thr.species = mi.species GROUP BY ALL),
pts AS (SELECT long.species, long.seqid, round(m / nullif(space, 0)::DOUBLE, 6) AS sigma, round((n_gi - n_single) / n_gi::DOUBLE, 6) AS phi FROM long JOIN gg ON gg.species = long.species AND gg.seqid = long.seqid JOIN mm ON mm.species = long.species AND mm.seqid = long.seqid WHERE n_gi > 0)"""  # fmt: skip

#: The test genomes are small: here sequences of this length count, and not only those of the operator's default.
TEST_LONG = 100_000


@C.add("longseqs", W("loci") + _LONG + " SELECT * FROM long")
def longseqs(spark, d):
    return summaries.long_sequences(table(spark, d, "regions"), TEST_LONG)


def _compact(spark, d):
    return summaries.compactness(V.loci(spark, d), _mi(spark, d), longseqs(spark, d))


@C.add("compact_phi", W("loci") + _COMPACT + " SELECT species, seqid, phi FROM pts")
def _(spark, d):
    return _compact(spark, d).select("species", "seqid", "phi")


@C.add("compact_sigma", W("loci") + _COMPACT + " SELECT species, seqid, sigma FROM pts")
def _(spark, d):
    return _compact(spark, d).select("species", "seqid", "sigma")


@C.add("compact_centroid", W("loci") + _COMPACT + """,
c1 AS (SELECT *, avg(sigma) OVER (PARTITION BY species) AS ms, avg(phi) OVER (PARTITION BY species) AS mp FROM pts), c2 AS (SELECT *, sqrt((sigma - ms) ** 2 + (phi - mp) ** 2) AS dd FROM c1), c3 AS (SELECT *, avg(dd) OVER (PARTITION BY species) AS md FROM c2)
SELECT species, round(avg(sigma), 6) AS sigma, round(avg(phi), 6) AS phi FROM c3 WHERE dd <= md * 2.25 GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return summaries.centroids(_compact(spark, d))


@C.add("sink_tex", W("loci") + r""" SELECT species, lpad(species, 12, ' ') || ' & ' || lpad(printf('%.1f', round(sum(effective_length) / 1000000.0 + 1e-9, 1)), 12, ' ') || ' & ' || lpad(format('{:,}', count(DISTINCT seqid)), 12, ' ') || ' \\' AS line FROM loci GROUP BY species""")
def _(spark, d):
    x = V.loci(spark, d).groupBy("species").agg((F.sum("effective_length") / 1_000_000).alias("mb"), F.countDistinct("seqid").alias("n"))
    cell = lambda c: F.lpad(c, 12, " ")
    return x.select("species", F.concat(F.concat_ws(" & ", cell("species"), cell(F.format_string("%.1f", F.round(F.col("mb") + 1e-9, 1))), cell(F.format_number("n", 0))), F.lit(" \\\\")).alias("line"))
