"""Queries on intervals and loci."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import intervals, lines, loci
from strandline.plans import views as V
from strandline.plans.catalog import Catalog
from strandline.session import ship

C = Catalog()
W = V.with_views

_MERGED = """,
m1 AS (SELECT *, max(e) OVER (PARTITION BY seqid ORDER BY s, e, gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM genes),
m2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY s, e, gene_id) AS isle FROM m1),
core AS (SELECT seqid, isle, min(s) AS s, max(e) AS e, count(*) AS n, arg_min(strand, (s, e, gene_id)) AS strand FROM m2 GROUP BY seqid, isle)"""


def _extended(delta: int = 500) -> str:
    d = delta
    return (
        _MERGED
        + f""",
nb AS (SELECT *, 1 AS rs, {V.REGION_END} AS re, lag(e) OVER w AS p, lead(s) OVER w AS nx, lead(strand) OVER w AS ns FROM core WINDOW w AS (PARTITION BY seqid ORDER BY s)),
cs AS (SELECT *, CASE WHEN p IS NULL THEN '-' WHEN p + {d} >= s THEN 'A' WHEN p + {2 * d} >= s THEN 'B' WHEN p + {3 * d} >= s THEN 'C' ELSE 'D' END AS lc,
  CASE WHEN nx IS NULL THEN '-' WHEN e + {d} >= nx THEN 'A' WHEN e + {2 * d} >= nx THEN 'B' WHEN e + {3 * d} >= nx THEN 'C' ELSE 'D' END AS rc FROM nb),
ext AS (SELECT *, CASE lc WHEN '-' THEN CASE WHEN s >= rs + {2 * d} THEN s - {d} ELSE rs END WHEN 'A' THEN CASE WHEN rs + {d} > s THEN rs ELSE s - {d} END WHEN 'C' THEN (p + s) // 2 + 1 ELSE s - {d} END AS xs,
  CASE rc WHEN '-' THEN CASE WHEN re > {2 * d} AND e <= re - {2 * d} THEN e + {d} ELSE re END WHEN 'C' THEN (e + nx) // 2 ELSE least(e + {d}, re) END AS xe,
  CASE lc WHEN 'A' THEN least(p + {d}, re) - (CASE WHEN rs + {d} > s THEN rs ELSE s - {d} END) + 1 WHEN 'B' THEN p - s + {2 * d} + 1 ELSE 0 END AS lo,
  CASE rc WHEN 'A' THEN least(e + {d}, re) - (CASE WHEN rs + {d} > nx THEN rs ELSE nx - {d} END) + 1 WHEN 'B' THEN e - nx + {2 * d} + 1 ELSE 0 END AS ro,
  CASE rc WHEN 'A' THEN 'delta-overlap-gene' WHEN 'B' THEN 'delta-overlap-delta' WHEN 'C' THEN 'delta-re-extend' END AS ex,
  CASE WHEN strand = '+' AND ns = '+' THEN 'FF' WHEN strand = '+' AND ns = '-' THEN 'FR' WHEN strand = '-' AND ns = '+' THEN 'RF' ELSE 'RR' END AS fg FROM cs)"""
    )


def _all(delta: int, inner: bool = True, ends: bool = True) -> str:
    d = delta
    ii = f"CASE WHEN {{c}} IN ('A', 'B', 'C') THEN 0 WHEN {{c}} = 'D' AND {'true' if inner else 'false'} AND {{b}} - {{a}} - {2 * d} - 1 > 0 THEN {{b}} - {{a}} - {2 * d} - 1 END"
    sql = f"""SELECT seqid, 'gene' AS kind, xs AS "start", xe AS "end", s AS core_start, e AS core_end, n AS n_genes, CAST(lo AS BIGINT) AS left_overlap, CAST(ro AS BIGINT) AS right_overlap,
  CAST({ii.format(c="lc", a="p", b="s")} AS BIGINT) AS liil, CAST({ii.format(c="rc", a="e", b="nx")} AS BIGINT) AS riil, ex AS exception, NULL::VARCHAR AS orient FROM ext"""
    blank = "NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"
    if ends:
        sql += f" UNION ALL SELECT seqid, 'fi', rs, s - {d} - 1, {blank}, NULL FROM ext WHERE lc = '-' AND s >= rs + {2 * d} AND s - {d} - 1 >= rs"
        sql += f" UNION ALL SELECT seqid, 'fi', e + {d} + 1, re, {blank}, NULL FROM ext WHERE rc = '-' AND re > {2 * d} AND e <= re - {2 * d} AND e + {d} + 1 <= re"
    if inner:
        sql += f" UNION ALL SELECT seqid, 'ii', e + {d} + 1, nx - {d} - 1, {blank}, fg FROM ext WHERE rc = 'D' AND nx - e - {2 * d} - 1 > 0"
    return sql


@C.add("locus_merge", W("genes") + _MERGED + ' SELECT seqid, s AS "start", e AS "end", n AS n_genes, strand FROM core')
def _(spark, d):
    return loci.merged(V.genes(spark, d))


@C.add("locus_extend", W("genes") + _extended() + _all(500))
def locus_extend(spark, d):
    return loci.extended(loci.merged(V.genes(spark, d)), V.regions(spark, d), 500)


@C.add("iilocus", W("genes") + _extended() + f' SELECT seqid, "start", "end", orient FROM ({_all(500)}) WHERE kind = \'ii\'')
def _(spark, d):
    return locus_extend(spark, d).where("kind = 'ii'").select("seqid", "start", "end", "orient")


@C.add("filocus", W("genes") + _extended() + f' SELECT seqid, "start", "end" FROM ({_all(500)}) WHERE kind = \'fi\'')
def _(spark, d):
    return locus_extend(spark, d).where("kind = 'fi'").select("seqid", "start", "end")


@C.add("locus_endmode_skipends", W("genes") + _extended(200) + _all(200, ends=False))
def _(spark, d):
    return loci.extended(loci.merged(V.genes(spark, d)), V.regions(spark, d), 200, endmode=-1)


@C.add("locus_endmode_endsonly", W("genes") + _extended(200) + _all(200, inner=False))
def _(spark, d):
    return loci.extended(loci.merged(V.genes(spark, d)), V.regions(spark, d), 200, endmode=1)


@C.add("locus_endmode_skipii", W("genes") + _extended(200) + _all(200, inner=False, ends=False))
def _(spark, d):
    return loci.extended(loci.merged(V.genes(spark, d)), V.regions(spark, d), 200, skip_ii=True)


@C.add("ilens", W("genes") + _extended() + """
SELECT seqid, CAST(CASE WHEN rc = 'D' THEN nx - e - 1001 ELSE 0 END AS BIGINT) AS length, fg AS orient FROM ext WHERE rc <> '-'
UNION ALL SELECT seqid, 0, 'NA' FROM (SELECT seqid, unnest(range(n - 1)) FROM ext WHERE lc <> '-')""")  # fmt: skip
def _(spark, d):
    return loci.inner_lengths(loci.merged(V.genes(spark, d)), 500)


@C.add("inner_orientation", W("genes") + _extended() + ' SELECT seqid, s AS "start", fg AS orient FROM ext WHERE rc <> \'-\'')
def _(spark, d):
    x = lines.neighbours(loci.merged(V.genes(spark, d)), ["seqid"], ["start", "end"], ["strand"])
    return x.where("next_strand IS NOT NULL").select("seqid", "start", loci.orientation(F.col("strand"), F.col("next_strand")).alias("orient"))


@C.add("effective_length", W("genes") + _extended() + """
SELECT seqid, xs AS "start", xe AS "end", CAST(xe - xs + 1 - ceil(lo / 2.0) - floor(ro / 2.0) AS BIGINT) AS effective_length FROM ext""")  # fmt: skip
def _(spark, d):
    x = locus_extend(spark, d).where("kind = 'gene'")
    return x.select("seqid", "start", "end", loci.effective_length(F.col("start"), F.col("end"), F.col("left_overlap"), F.col("right_overlap")).alias("effective_length"))


@C.add("space_conserved", W("genes") + _extended() + f""",
everything AS ({_all(500)})
SELECT seqid, CAST(sum("end" - "start" + 1 - ceil(coalesce(left_overlap, 0) / 2.0) - floor(coalesce(right_overlap, 0) / 2.0)) AS BIGINT) AS covered FROM everything GROUP BY seqid""")  # fmt: skip
def _(spark, d):
    x = locus_extend(spark, d)
    n = loci.effective_length(F.col("start"), F.col("end"), F.col("left_overlap"), F.col("right_overlap"))
    return x.groupBy("seqid").agg(F.sum(n).alias("covered"))


@C.add("locus_mint", W("exons") + _MERGED + """
SELECT g.seqid, min(g.s) AS "start", count(DISTINCT g.gene_id) AS child_gene, count(x.rn) AS child_exon, count(*) FILTER (x.code = 'C') AS child_cds, count(*) FILTER (x.code = 'F') AS child_utr5, count(*) FILTER (x.code = 'T') AS child_utr3
FROM m2 g LEFT JOIN exons x ON x.gene_id = g.gene_id GROUP BY g.seqid, g.isle""")  # fmt: skip
def _(spark, d):
    per = V.exons(spark, d).groupBy("gene_id").agg(F.count(F.lit(1)).alias("x"), *[F.count_if(F.col("code") == c).alias(c) for c in "CFT"])
    g = loci.with_locus(V.genes(spark, d)).join(per, "gene_id", "left")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return g.groupBy("seqid", F.col("locus_start").alias("start")).agg(F.count(F.lit(1)).alias("child_gene"), n("x").alias("child_exon"), n("C").alias("child_cds"), n("F").alias("child_utr5"), n("T").alias("child_utr3"))


def classified_loci(spark, d):
    """All loci, extended, with their class."""
    coding = V.exons(spark, d).where("code = 'C'").select("gene_id").distinct().withColumn("c", F.lit(True))
    core = loci.merged(V.genes(spark, d).join(coding, "gene_id", "left"), coding=F.coalesce(F.max("c"), F.lit(False)))
    x = loci.extended(core, V.regions(spark, d), 500, keep=("coding",))
    return x.withColumn("ilocus_type", loci.classified(F.col("kind"), F.col("n_genes"), F.coalesce("coding", F.lit(False))))


@C.add("ilocus_classify", W("exons") + _extended() + f""",
cod AS (SELECT g.seqid, g.isle, coalesce(bool_or(x.code = 'C'), false) AS c FROM m2 g LEFT JOIN exons x ON x.gene_id = g.gene_id GROUP BY ALL)
SELECT a.seqid, a."start", a."end", CASE kind WHEN 'fi' THEN 'fiLocus' WHEN 'ii' THEN 'iiLocus' ELSE CASE WHEN NOT cod.c THEN 'niLocus' WHEN n_genes > 1 THEN 'ciLocus' ELSE 'siLocus' END END AS ilocus_type
FROM ({_all(500)}) a LEFT JOIN core ON core.seqid = a.seqid AND core.s = a.core_start LEFT JOIN cod ON cod.seqid = core.seqid AND cod.isle = core.isle""")  # fmt: skip
def _(spark, d):
    return classified_loci(spark, d).select("seqid", "start", "end", "ilocus_type")


@C.add("join_map_gene_locus", W("genes") + _MERGED + " SELECT g.gene_id AS gene, g.seqid || ':' || c.s || '-' || c.e AS locus FROM m2 g JOIN core c ON c.seqid = g.seqid AND c.isle = g.isle")
def _(spark, d):
    m = loci.merged(V.genes(spark, d)).select("seqid", F.col("start").alias("locus_start"), F.concat("seqid", F.lit(":"), "start", F.lit("-"), "end").alias("locus"))
    return loci.with_locus(V.genes(spark, d)).join(m, ["seqid", "locus_start"]).select(F.col("gene_id").alias("gene"), "locus")


@C.add("join_map_mrna_locus", W("genes") + _MERGED + " SELECT 'm' || g.gene_id AS mrna, g.seqid || ':' || c.s || '-' || c.e AS locus FROM m2 g JOIN core c ON c.seqid = g.seqid AND c.isle = g.isle")
def _(spark, d):
    return C.queries["join_map_gene_locus"](spark, d).select(F.concat(F.lit("m"), "gene").alias("mrna"), "locus")


@C.add("transcript_mapping", W("genes") + " SELECT 'm' || gene_id AS mrna, seqid || ':' || s || '-' || e AS place FROM genes")
def _(spark, d):
    return V.genes(spark, d).select(F.concat(F.lit("m"), "gene_id").alias("mrna"), F.concat("seqid", F.lit(":"), "start", F.lit("-"), "end").alias("place"))


@C.add("uloci", """SELECT seqid, min("start") AS "start", max("end") AS "end", 'fiLocus' AS ilocus_type, true AS unannot FROM regions
WHERE seqid IS NOT NULL AND "start" <= "end" AND seqid NOT IN (SELECT seqid FROM features WHERE type = 'gene' AND seqid IS NOT NULL) GROUP BY seqid""")  # fmt: skip
def _(spark, d):
    r = intervals.bounding(spark.read.parquet(f"{d}/regions.parquet").where("seqid IS NOT NULL AND start <= end"), ["seqid"])
    return loci.without_genes(r, spark.read.parquet(f"{d}/features.parquet").where("type = 'gene' AND seqid IS NOT NULL"))


@C.add("lpdriver", W("genes") + _extended() + f""",
u AS ({_all(500)} UNION ALL SELECT 'none' || n_nationkey, 'fi', 1, 1000 + n_nationkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation)
SELECT seqid, "start", "end", kind, printf('locus%06d', row_number() OVER (ORDER BY seqid, "start", "end", kind)) AS name FROM u""")  # fmt: skip
def _(spark, d):
    bare = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("none"), "n_nationkey").alias("seqid"), F.lit(1).cast("bigint").alias("start"), (F.col("n_nationkey") + 1000).cast("bigint").alias("end"), F.lit("fi").alias("kind"))
    both = locus_extend(spark, d).select("seqid", "start", "end", "kind").unionByName(bare)
    return lines.numbered(both, ["seqid"], ["start", "end", "kind"]).select("seqid", "start", "end", "kind", F.format_string("locus%06d", "serial").alias("name"))


@C.add("rename_serial", W("genes") + """ SELECT gene_id, printf('g%05d', row_number() OVER (ORDER BY seqid, s, e, gene_id)) AS name FROM genes""")
def _(spark, d):
    return lines.numbered(V.genes(spark, d), ["seqid"], ["start", "end", "gene_id"]).select("gene_id", F.format_string("g%05d", "serial").alias("name"))


@C.add("miloci_merge", W("loci") + """,
x AS (SELECT *, coalesce(ilocus_type IN ('siLocus', 'niLocus') AND coalesce(iilocus_exception, '') <> 'intron-gene', false) AS can FROM loci),
y AS (SELECT *, sum(CASE WHEN can THEN 0 ELSE 1 END) OVER (PARTITION BY file_id, seqid ORDER BY s, e, locus_id) AS stop FROM x)
SELECT file_id, seqid, min(s) AS "start", max(e) AS "end", CASE WHEN can AND count(*) > 1 THEN 'miLocus' ELSE min(ilocus_type) END AS ilocus_type, count(*) AS n_merged,
  CAST(sum(coalesce(n_children, 0)) AS BIGINT) AS gene_count, CAST(sum(coalesce(effective_length, 0)) AS BIGINT) AS effective_length FROM y GROUP BY file_id, seqid, can, stop""")  # fmt: skip
def _(spark, d):
    return loci.merged_loci(V.loci(spark, d), ["file_id", "seqid"])


@C.add("filens", W("loci") + " SELECT species, name AS locus, liil, riil FROM loci WHERE liil IS NOT NULL AND riil IS NOT NULL")
def _(spark, d):
    return V.loci(spark, d).where("liil IS NOT NULL AND riil IS NOT NULL").select("species", F.col("name").alias("locus"), "liil", "riil")


@C.add("filter_simple_iloci", W("loci") + " SELECT name FROM loci WHERE ilocus_type = 'siLocus' AND n_children = 1")
def _(spark, d):
    return V.loci(spark, d).where("ilocus_type = 'siLocus' AND n_children = 1").select("name")


def refined_sql(last: str, delta: int = 500) -> str:
    """Refined loci (part: seqid, locus_start, part, s, e, ...) from a fold over the genes of each locus, and a last query on them."""
    d = delta
    meets = """CASE WHEN (g.cs IS NULL) <> (o.cs IS NULL) THEN false
  WHEN g.cs IS NOT NULL AND (g.s <> o.s OR g.e <> o.e) THEN least(g.ce, o.ce) >= greatest(g.cs, o.cs) ELSE least(g.e, o.e) >= greatest(g.s, o.s) END"""
    return W("genes", "exons") + _extended(delta) + f""",
cds AS (SELECT gene_id, min(s) FILTER (code = 'C') AS cs, max(e) FILTER (code = 'C') AS ce, list({{'s': s, 'e': e}}) AS ex FROM exons GROUP BY 1),
members AS (SELECT m2.seqid, isle, row_number() OVER (PARTITION BY m2.seqid, isle ORDER BY m2.s, m2.e, m2.gene_id) AS rn, {{'id': m2.gene_id, 's': m2.s, 'e': m2.e, 'cs': cs, 'ce': ce, 'ex': coalesce(ex, [])}} AS g
  FROM m2 JOIN core USING (seqid, isle) LEFT JOIN cds ON cds.gene_id = m2.gene_id WHERE n > 1),
fold AS (SELECT seqid, isle, rn, 1 AS bin, [g] AS held FROM members WHERE rn = 1
  UNION ALL SELECT t.seqid, t.isle, t.rn, CASE WHEN t.yes THEN t.bin ELSE t.bin + 1 END, CASE WHEN t.yes THEN list_append(t.held, t.g) ELSE [t.g] END
  FROM (SELECT m.seqid, m.isle, m.rn, f.bin, f.held, m.g, len(list_filter(list_transform(f.held, lambda o: {meets.replace("g.", "m.g.")}), lambda x: x)) > 0 AS yes
    FROM fold f JOIN members m ON m.seqid = f.seqid AND m.isle = f.isle AND m.rn = f.rn + 1) t),
bins AS (SELECT seqid, isle, bin, arg_max(held, rn) AS gs FROM fold GROUP BY ALL),
split AS (SELECT *, len(gs) = 2 AND gs[2].e <= gs[1].e AND len(gs[1].ex) >= 2 AND len(list_filter(gs[1].ex, lambda x: x.s <= gs[2].e AND x.e >= gs[2].s)) = 0 AS intron FROM bins),
cut AS (SELECT seqid, isle, gs, NULL::VARCHAR AS ty, NULL::VARCHAR AS exc FROM split WHERE NOT intron
  UNION ALL SELECT seqid, isle, [gs[1]], 'ciLocus', NULL FROM split WHERE intron UNION ALL SELECT seqid, isle, [gs[2]], NULL, 'intron-gene' FROM split WHERE intron),
ranged AS (SELECT *, list_min(list_transform(gs, lambda x: x.s)) AS a, list_max(list_transform(gs, lambda x: x.e)) AS b, len(list_filter(gs, lambda x: x.cs IS NOT NULL)) > 0 AS coding FROM cut),
placed AS (SELECT r.*, x.xs AS o1, x.xe AS o2, x.s AS locus_start, x.n AS n_all, x.lo, x.ro,
  CAST(CASE WHEN lc IN ('A', 'B', 'C') THEN 0 WHEN lc = 'D' AND x.s - p - {2 * d} - 1 > 0 THEN x.s - p - {2 * d} - 1 END AS BIGINT) AS ol, CAST(CASE WHEN rc IN ('A', 'B', 'C') THEN 0 WHEN rc = 'D' AND nx - x.e - {2 * d} - 1 > 0 THEN nx - x.e - {2 * d} - 1 END AS BIGINT) AS orr,
  row_number() OVER w AS part, count(*) OVER k AS n_parts, CASE WHEN x.xs + {d} > r.a THEN x.xs ELSE r.a - {d} END AS s0, CASE WHEN r.b + {d} > x.xe THEN x.xe ELSE r.b + {d} END AS e0,
  count(DISTINCT r.coding) OVER k AS kinds FROM ranged r JOIN ext x USING (seqid, isle) WINDOW k AS (PARTITION BY r.seqid, isle), w AS (PARTITION BY r.seqid, isle ORDER BY r.a, r.b, r.gs[1].id)),
ends AS (SELECT *, part = first_value(part) OVER (PARTITION BY seqid, isle ORDER BY e0 DESC, part DESC) AS closes FROM placed),
closed AS (SELECT *, CASE WHEN part = 1 THEN o1 ELSE s0 END AS s, CASE WHEN closes THEN o2 ELSE e0 END AS e FROM ends),
beside AS (SELECT *, min(s) FILTER (part = 2) OVER k AS s2, min(e) FILTER (part = 2) OVER k AS e2, min(s) FILTER (part = 1) OVER k AS s1, min(e) FILTER (part = 1) OVER k AS e1, max(exc) FILTER (part = 2) OVER k AS exc2,
  part = first_value(part) OVER (PARTITION BY seqid, isle ORDER BY e DESC, part) AS rightmost FROM closed WINDOW k AS (PARTITION BY seqid, isle)),
told AS (SELECT *, n_parts = 2 AND coalesce(exc2, '') <> 'intron-gene' AS apart, kinds = 2 AND n_parts = 2 AND s1 <= s2 AND e2 <= e1 AS holds, e1 - s2 + 1 AS ov, o2 - o1 + 1 - (lo + 1) // 2 - ro // 2 AS whole FROM beside),
part AS (SELECT seqid, locus_start, part, s, e, gs, CAST(len(gs) AS INTEGER) AS n_genes,
  CASE WHEN kinds = 2 AND n_parts = 2 THEN CASE WHEN coding THEN 'siLocus' ELSE 'niLocus' END WHEN ty IS NOT NULL THEN ty WHEN NOT coding THEN 'niLocus' WHEN len(gs) > 1 THEN 'ciLocus' ELSE 'siLocus' END AS ilocus_type,
  CASE WHEN kinds = 1 OR n_parts > 2 THEN CASE WHEN part = 1 THEN whole END WHEN holds THEN CASE part WHEN 1 THEN whole ELSE 0 END
    WHEN part = 1 THEN e - s + 1 - (lo + 1) // 2 - ov // 2 ELSE e - s + 1 - (ov + 1) // 2 - ro // 2 END AS effective_length,
  CASE WHEN kinds = 1 AND coding AND len(gs) > 1 OR kinds = 2 AND n_parts > 2 AND part = 1 THEN 'complex-overlap-' || n_all
    WHEN part = 1 AND apart THEN CASE WHEN holds THEN 'gene-contain-gene' ELSE 'gene-overlap-gene' END ELSE exc END AS exception,
  CASE WHEN kinds = 1 THEN CASE WHEN apart AND part = 2 THEN 0 END WHEN n_parts = 2 THEN CASE WHEN apart THEN CASE part WHEN 1 THEN ol ELSE 0 END END WHEN part = 1 THEN ol ELSE 0 END AS liil,
  CASE WHEN kinds = 1 THEN CASE WHEN apart AND part = 1 THEN 0 END WHEN n_parts = 2 THEN CASE WHEN apart THEN CASE WHEN holds THEN CASE part WHEN 1 THEN orr ELSE 0 END WHEN part = 1 THEN 0 ELSE orr END END
    WHEN rightmost THEN orr WHEN part > 1 THEN 0 END AS riil FROM told)
""" + last


@C.add("refine_loci", refined_sql("""SELECT seqid, locus_start, CAST(part AS INTEGER) AS part, s AS "start", e AS "end", n_genes, ilocus_type, CAST(effective_length AS BIGINT) AS effective_length, exception,
  CAST(liil AS BIGINT) AS liil, CAST(riil AS BIGINT) AS riil, array_to_string(list_transform(gs, lambda x: x.id), ',') AS genes FROM part"""))
def _(spark, d):
    ship(spark)
    return loci.refined(V.genes(spark, d), V.exons(spark, d), V.regions(spark, d))


@C.add("refine_bin", refined_sql("SELECT seqid, locus_start, CAST(part AS INTEGER) AS part, CAST(unnest(list_transform(gs, lambda x: x.id)) AS VARCHAR) AS gene FROM part"))
def _(spark, d):
    """Genes of each bin of each locus."""
    ship(spark)
    x = loci.refined(V.genes(spark, d), V.exons(spark, d), V.regions(spark, d))
    return x.select("seqid", "locus_start", "part", F.explode(F.split("genes", ",")).alias("gene"))


@C.add("refine_summary", refined_sql("SELECT ilocus_type, exception, count(*) AS n, CAST(sum(effective_length) AS BIGINT) AS effective_length FROM part GROUP BY ALL"))
def _(spark, d):
    ship(spark)
    x = loci.refined(V.genes(spark, d), V.exons(spark, d), V.regions(spark, d))
    return x.groupBy("ilocus_type", "exception").agg(F.count(F.lit(1)).alias("n"), F.sum("effective_length").alias("effective_length"))


# intervals


@C.add("interval_union", W("exons") + """,
x AS (SELECT seqid, s, e, max(e) OVER (PARTITION BY seqid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM exons),
y AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM x)
SELECT seqid, min(s) AS "start", max(e) AS "end", count(*) AS n FROM y GROUP BY seqid, i""")  # fmt: skip
def _(spark, d):
    return intervals.union(V.exons(spark, d).select("seqid", "start", "end"), ["seqid"])


@C.add("interval_intersect", W("exons", "pred") + """
SELECT x.gene_id, x.s AS exon_start, p.s AS pred_start, greatest(x.s, p.s) AS "start", least(x.e, p.e) AS "end" FROM exons x JOIN pred p ON p.gene_id = x.gene_id AND x.s <= p.e AND x.e >= p.s""")  # fmt: skip
def _(spark, d):
    p = V.predicted(spark, d).select("gene_id", F.col("start").alias("ps"), F.col("end").alias("pe"))
    s, e = intervals.intersect(F.col("start"), F.col("end"), F.col("ps"), F.col("pe"))
    x = V.exons(spark, d).join(p, "gene_id").withColumn("_s", s).withColumn("_e", e).where("_s IS NOT NULL")
    return x.select("gene_id", F.col("start").alias("exon_start"), F.col("ps").alias("pred_start"), F.col("_s").alias("start"), F.col("_e").alias("end"))


@C.add("range_join", W("exons") + ' SELECT gene_id, min(s) AS "start", max(e) AS "end" FROM exons GROUP BY gene_id')
def _(spark, d):
    return intervals.bounding(V.exons(spark, d), ["gene_id"])


@C.add("overlap_check_any", W("aln") + """
SELECT DISTINCT a.aln_id, EXISTS (SELECT 1 FROM aln b, aln c WHERE b.aln_id = a.aln_id AND c.aln_id = a.aln_id AND (b.s, b.e) < (c.s, c.e) AND b.s <= c.e AND b.e >= c.s) AS overlapping FROM aln a""")  # fmt: skip
def _(spark, d):
    return intervals.any_overlap(V.alignments(spark, d), ["aln_id"])


@C.add("join_overlap", W("genes", "aln") + """,
al AS (SELECT aln_id, seqid, min(s) AS s, max(e) AS e FROM aln GROUP BY ALL)
SELECT gene_id, aln_id FROM genes g JOIN al a ON a.seqid = g.seqid AND a.s <= g.e AND a.e >= g.s""")  # fmt: skip
def _(spark, d):
    al = V.alignments(spark, d).groupBy("aln_id", "seqid").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return intervals.overlap_join(V.genes(spark, d), al, ["seqid"]).select("gene_id", F.col("b_aln_id").alias("aln_id"))


@C.add("feat_overlap", W("feats") + """,
g AS (SELECT * FROM feats WHERE type = 'gene'), r AS (SELECT * FROM feats WHERE type IN ('repeat_region', 'transposable_element'))
SELECT g.file_id, g.line_no, r.line_no AS repeat_line FROM g JOIN r ON g.file_id = r.file_id AND g.seqid = r.seqid AND g.s <= r.e AND g.e >= r.s""")  # fmt: skip
def _(spark, d):
    f = V.features(spark, d).select("file_id", "seqid", "line_no", "type", "start", "end")
    both = intervals.overlap_join(f.where("type = 'gene'"), f.where("type IN ('repeat_region', 'transposable_element')"), ["file_id", "seqid"])
    return both.select("file_id", "line_no", F.col("b_line_no").alias("repeat_line"))


@C.add("overlap_predicate", W("exons") + """,
c AS (SELECT gene_id, min(s) FILTER (code = 'C') AS cs, max(e) FILTER (code = 'C') AS ce FROM exons GROUP BY 1), g AS (SELECT genes.*, cs, ce FROM genes LEFT JOIN c USING (gene_id))
SELECT a.gene_id AS a, b.gene_id AS b FROM g a JOIN g b ON a.seqid = b.seqid AND a.gene_id < b.gene_id AND a.s <= b.e AND a.e >= b.s
WHERE (a.cs IS NULL) = (b.cs IS NULL) AND (a.cs IS NULL OR (a.s = b.s AND a.e = b.e) OR (a.cs <= b.ce AND a.ce >= b.cs))""")  # fmt: skip
def _(spark, d):
    c = V.exons(spark, d).where("code = 'C'").groupBy("gene_id").agg(F.min("start").alias("cs"), F.max("end").alias("ce"))
    g = V.genes(spark, d).join(c, "gene_id", "left")
    x = intervals.overlap_join(g, g, ["seqid"]).where("gene_id < b_gene_id")
    coding = "(cs IS NULL OR (start = b_start AND end = b_end) OR (cs <= b_ce AND ce >= b_cs))"
    return x.where(f"isnull(cs) = isnull(b_cs) AND {coding}").select(F.col("gene_id").alias("a"), F.col("b_gene_id").alias("b"))


@C.add("sort_features", W("genes") + ' SELECT gene_id, seqid, s AS "start", e AS "end" FROM genes ORDER BY seqid, s, e')
def _(spark, d):
    return V.genes(spark, d).select("gene_id", "seqid", "start", "end").orderBy("seqid", "start", "end")


@C.add("locus_sort_compare", W("genes") + _MERGED + """ SELECT seqid, s AS "start", CASE WHEN lag(s) OVER w IS NULL THEN 0 ELSE sign(s - lag(s) OVER w) END AS compared FROM core WINDOW w AS (PARTITION BY seqid ORDER BY s, e)""")
def _(spark, d):
    x = lines.neighbours(loci.merged(V.genes(spark, d)), ["seqid"], ["start", "end"], ["start"])
    return x.select("seqid", "start", F.coalesce(F.signum(F.col("start") - F.col("prev_start")), F.lit(0)).cast("int").alias("compared"))
