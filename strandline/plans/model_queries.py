"""Queries on gene structure, comparison of annotations, and alignment support."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.types import is_a
from strandline.operators import compare as K
from strandline.operators import features as O
from strandline.operators import intervals, loci, support
from strandline.operators import structure as S
from strandline.operators.packed import values_of
from strandline.plans import views as V
from strandline.plans.catalog import Catalog
from strandline.plans.loci_queries import _MERGED
from strandline.plans.problems import _VALUES
from strandline.session import ship

C = Catalog()
W = V.with_views

# structure

_COD = """,
ends AS (SELECT gene_id, min(s) AS lo, max(e) AS hi, min(strand) AS strand FROM exons WHERE code = 'C' GROUP BY 1),
cod AS (SELECT gene_id, strand, CASE WHEN strand = '-' THEN hi - 2 ELSE lo END AS a1, CASE WHEN strand = '-' THEN hi ELSE lo + 2 END AS a2, CASE WHEN strand = '-' THEN lo ELSE hi - 2 END AS z1, CASE WHEN strand = '-' THEN lo + 2 ELSE hi END AS z2 FROM ends),
cds AS (SELECT x.gene_id, x.strand, greatest(s, least(a1, z1)) AS s, least(e, greatest(a2, z2)) AS e FROM exons x JOIN cod ON cod.gene_id = x.gene_id WHERE s <= greatest(a2, z2) AND e >= least(a1, z1)),
utr AS (SELECT x.gene_id, x.strand, true AS before, s, least(e, least(a1, z1) - 1) AS e FROM exons x JOIN cod ON cod.gene_id = x.gene_id WHERE s < least(a1, z1)
  UNION ALL SELECT x.gene_id, x.strand, false, greatest(s, greatest(a2, z2) + 1), e FROM exons x JOIN cod ON cod.gene_id = x.gene_id WHERE e > greatest(a2, z2))"""


def _coding(spark, d):
    return V.exons(spark, d).where("code = 'C'")


def _cod(spark, d):
    return S.codons(_coding(spark, d))


def _cds(spark, d):
    return S.infer_cds(V.exons(spark, d).select("gene_id", "strand", "start", "end"), _cod(spark, d))


def _utrs(spark, d):
    return S.infer_utrs(V.exons(spark, d).select("gene_id", "strand", "start", "end"), _cod(spark, d))


@C.add("infer_start_codon", W("exons") + _COD + ' SELECT gene_id, a1 AS "start", a2 AS "end" FROM cod')
def _(spark, d):
    return _cod(spark, d).select("gene_id", F.col("start_s").alias("start"), F.col("start_e").alias("end"))


@C.add("infer_stop_codon", W("exons") + _COD + ' SELECT gene_id, z1 AS "start", z2 AS "end" FROM cod')
def _(spark, d):
    return _cod(spark, d).select("gene_id", F.col("stop_s").alias("start"), F.col("stop_e").alias("end"))


@C.add("infer_cds", W("exons") + _COD + ' SELECT gene_id, strand, s AS "start", e AS "end" FROM cds')
def _(spark, d):
    return _cds(spark, d)


@C.add("infer_utrs", W("exons") + _COD + """ SELECT gene_id, strand, CASE WHEN before = (strand <> '-') THEN 'five_prime_UTR' ELSE 'three_prime_UTR' END AS type, s AS "start", e AS "end" FROM utr""")
def _(spark, d):
    return _utrs(spark, d)


@C.add("set_utr_types", W("exons") + _COD + """ SELECT x.gene_id, x.rn, CASE WHEN (x.e < cod.a1) = (x.strand <> '-') THEN 'five_prime_UTR' ELSE 'three_prime_UTR' END AS type FROM exons x JOIN cod ON cod.gene_id = x.gene_id WHERE x.code <> 'C'""")
def _(spark, d):
    x = V.exons(spark, d).where("code <> 'C'").select("gene_id", "rn", "end", "strand").join(_cod(spark, d).drop("strand"), "gene_id")
    return x.select("gene_id", "rn", S.utr_type(F.col("end") < F.col("start_s"), F.col("strand")).alias("type"))


@C.add("cds_multi", W("exons") + " SELECT gene_id, rn, 'CDS' || gene_id AS id, min(s) OVER (PARTITION BY gene_id) AS first FROM exons WHERE code = 'C'")
def _(spark, d):
    x = _coding(spark, d)
    return x.select("gene_id", "rn", F.concat(F.lit("CDS"), "gene_id").alias("id"), F.min("start").over(Window.partitionBy("gene_id")).alias("first"))


@C.add("cds_phase", W("exons") + _COD + """ SELECT gene_id, s AS "start", e AS "end", CAST((3 - coalesce(sum(e - s + 1) OVER (PARTITION BY gene_id ORDER BY CASE WHEN strand = '-' THEN -s ELSE s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS INTEGER) AS phase FROM cds""")
def _(spark, d):
    return S.phases(_cds(spark, d)).select("gene_id", "start", "end", "phase")


@C.add("infer_exons", W("exons") + _COD + ' SELECT x.gene_id, s AS "start", e AS "end" FROM exons x JOIN cod ON cod.gene_id = x.gene_id')
def _(spark, d):
    """From coding and untranslated parts back to the exons that they were cut from."""
    e = V.kept_exons(spark, d).select("gene_id", "strand", "start", "end", "code")
    cod = S.codons(e.where("code = 'C'"))
    return S.infer_exons(S.infer_cds(e, cod), S.infer_utrs(e, cod))


@C.add("infer_introns", W("exons") + """ SELECT gene_id, e + 1 AS "start", nx - 1 AS "end" FROM (SELECT *, lead(s) OVER (PARTITION BY gene_id ORDER BY s) AS nx FROM exons) WHERE nx > e + 1""")
def _(spark, d):
    return S.introns(V.exons(spark, d), "gene_id", strict=True)


@C.add("add_introns", W("pred") + """ SELECT gene_id, e + 1 AS "start", nx - 1 AS "end" FROM (SELECT *, lead(s) OVER (PARTITION BY gene_id ORDER BY s, e) AS nx FROM pred) WHERE nx > e + 1""")
def _(spark, d):
    return S.introns(V.predicted(spark, d), "gene_id")


@C.add("inter_feature", W("aln") + """ SELECT aln_id, e + 1 AS "start", nx - 1 AS "end" FROM (SELECT *, lead(s) OVER (PARTITION BY aln_id ORDER BY s, e) AS nx FROM aln) WHERE nx > e + 1""")
def _(spark, d):
    return S.introns(V.alignments(spark, d), "aln_id")


@C.add("collapse_shared", W("feats") + f""",
x AS (SELECT DISTINCT file_id, seqid, strand, s, e, line_no, unnest({_VALUES.format(c="parent")}) AS p FROM feats WHERE type = 'exon' AND strand IS NOT NULL)
SELECT file_id, seqid, strand, s AS "start", e AS "end", string_agg(DISTINCT p, ',' ORDER BY p) AS parents, count(*) AS n FROM x GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    x = V.features(spark, d).where("type = 'exon' AND strand IS NOT NULL").select("file_id", "seqid", "strand", "start", "end", "line_no", F.explode(values_of("parent")).alias("p")).distinct()
    return S.shared(x, ["file_id", "seqid", "strand"], "p")


@C.add("infer_parent", W("feats") + f""" SELECT file_id, 'parent-' || coalesce(id, 'line' || line_no) AS id, 'gene' AS type, min(seqid) AS seqid, min(s) AS "start", max(e) AS "end", min(strand) AS strand
FROM feats WHERE len(coalesce({_VALUES.format(c="parent")}, [])) = 0 AND type IN ('mRNA', 'tRNA', 'rRNA', 'ncRNA') GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    return S.infer_parents(V.features(spark, d))


_MRNA = f"""
WITH {V.SQL["feats"]},
v AS (SELECT DISTINCT file_id, line_no, type, s, e, unnest({_VALUES.format(c="parent")}) AS p FROM feats WHERE parent IS NOT NULL),
m AS (SELECT f.file_id, f.id, any_value(f.accession) AS acc, min(f.s) AS s, max(f.e) AS e, min(v.p) AS gene FROM feats f JOIN v ON v.file_id = f.file_id AND v.line_no = f.line_no AND v.type = 'mRNA' WHERE f.type = 'mRNA' AND f.id IS NOT NULL GROUP BY ALL),
k AS (SELECT file_id, p AS id, count(*) FILTER (type = 'exon') AS n_exons, count(*) FILTER (type = 'CDS') AS n_cds, coalesce(sum(e - s + 1) FILTER (type = 'CDS'), 0) AS cds_length FROM v GROUP BY ALL),
i AS (SELECT file_id, p AS id, count(*) AS n_introns FROM v WHERE type = 'intron' GROUP BY ALL),
g AS (SELECT file_id, id AS gene, min(s) AS gs, max(e) AS ge FROM feats WHERE type = 'gene' AND id IS NOT NULL GROUP BY ALL),
t AS (SELECT m.file_id, m.id, m.gene, m.s, m.e, gs, ge, coalesce(n_exons, 0) AS n_exons, coalesce(n_cds, 0) AS n_cds, coalesce(n_introns, 0) AS n_introns, CAST(coalesce(cds_length, 0) AS BIGINT) AS cds_length
  FROM m JOIN g ON g.file_id = m.file_id AND g.gene = m.gene LEFT JOIN k ON k.file_id = m.file_id AND k.id = m.id LEFT JOIN i ON i.file_id = m.file_id AND i.id = m.id)
"""


def _transcripts(spark, d):
    f = V.features(spark, d)
    parts = f.where("parent IS NOT NULL").select("file_id", "line_no", "type", "start", "end", F.explode(values_of("parent")).alias("p")).distinct()
    m = f.where("type = 'mRNA' AND id IS NOT NULL").withColumn("p", F.explode(values_of("parent"))).groupBy("file_id", "id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("p").alias("gene"))
    n = F.col("end") - F.col("start") + 1
    k = parts.groupBy("file_id", F.col("p").alias("id")).agg(
        F.count_if(is_a("exon")).alias("n_exons"), F.count_if(F.col("type") == "CDS").alias("n_cds"), F.count_if(is_a("intron")).alias("n_introns"), F.sum(F.when(F.col("type") == "CDS", n)).alias("cds_length")
    )
    g = f.where("type = 'gene' AND id IS NOT NULL").groupBy("file_id", F.col("id").alias("gene")).agg(F.min("start").alias("g_start"), F.max("end").alias("g_end"))
    return m.join(g, ["file_id", "gene"]).join(k, ["file_id", "id"], "left").na.fill(0, ["n_exons", "n_cds", "n_introns", "cds_length"])


@C.add("gene_stream", _MRNA + " SELECT file_id, gene, count(*) AS n_valid FROM t WHERE n_cds > 0 AND n_exons = n_introns + 1 AND s >= gs AND e <= ge GROUP BY ALL")
def _(spark, d):
    return S.valid_transcripts(_transcripts(spark, d)).groupBy("file_id", "gene").agg(F.count(F.lit(1)).alias("n_valid"))


_REP = """ SELECT file_id, gene, id AS label, cds_length FROM (SELECT *, row_number() OVER (PARTITION BY file_id, gene ORDER BY cds_length DESC, CASE WHEN cds_length = 0 THEN -s ELSE 0 END, CASE WHEN cds_length = 0 THEN -e ELSE 0 END, id) AS rn FROM t) WHERE rn = 1"""


@C.add("mrna_rep", _MRNA + _REP)
def _(spark, d):
    t = _transcripts(spark, d).withColumn("label", F.col("id"))
    return S.representatives(t, ["file_id", "gene"])


@C.add("topk_1", _MRNA + " SELECT file_id, gene, max(cds_length) AS longest FROM t GROUP BY ALL")
def _(spark, d):
    return _transcripts(spark, d).groupBy("file_id", "gene").agg(F.max("cds_length").alias("longest"))


_CTX = """CASE WHEN {c}e < least(a1, z1) THEN CASE WHEN {c}strand = '-' THEN '3putr' ELSE '5putr' END WHEN {c}s > greatest(a2, z2) THEN CASE WHEN {c}strand = '-' THEN '5putr' ELSE '3putr' END ELSE 'cds' END"""


@C.add("exon_context", W("exons") + _COD + f""" SELECT x.gene_id, x.rn, CASE WHEN x.s <= a2 AND x.e >= a1 AND x.s <= z2 AND x.e >= z1 THEN 'complete' WHEN x.s <= a2 AND x.e >= a1 THEN 'start' WHEN x.s <= z2 AND x.e >= z1 THEN 'stop' ELSE {_CTX.format(c="x.")} END AS context
FROM exons x JOIN cod ON cod.gene_id = x.gene_id""")  # fmt: skip
def _(spark, d):
    c = _cod(spark, d).drop("strand")
    x = V.exons(spark, d).join(c, "gene_id")
    return x.select("gene_id", "rn", S.context(F.col("start"), F.col("end"), F.col("strand"), {k: F.col(k) for k in ("start_s", "start_e", "stop_s", "stop_e")}).alias("context"))


_INTRONS = """, intr AS (SELECT gene_id, seqid, strand, e + 1 AS s, nx - 1 AS e FROM (SELECT *, lead(s) OVER (PARTITION BY gene_id ORDER BY s) AS nx FROM exons) WHERE nx > e + 1)"""


def _introns(spark, d, e=None):
    e = V.exons(spark, d) if e is None else e
    own = e.groupBy("gene_id").agg(F.min("seqid").alias("seqid"), F.min("strand").alias("strand"))
    return S.introns(e, "gene_id").join(own, "gene_id")


@C.add("intron_context", W("exons") + _COD + _INTRONS + f""" SELECT x.gene_id, x.s AS "start", {_CTX.format(c="x.")} AS context FROM intr x JOIN cod ON cod.gene_id = x.gene_id""")
def _(spark, d):
    x = _introns(spark, d).join(_cod(spark, d).drop("strand"), "gene_id")
    return x.select("gene_id", "start", S.context(F.col("start"), F.col("end"), F.col("strand"), {k: F.col(k) for k in ("start_s", "start_e", "stop_s", "stop_e")}, whole=False).alias("context"))


# comparison

#: SQL: per base, by breakpoints; another way than the plan's.
_CMP = """,
spans AS (SELECT gene_id, e - s + 1 AS length, s, e FROM genes WHERE gene_id IN (SELECT gene_id FROM exons)),
duo AS (SELECT 'r' AS side, gene_id, s, e, code FROM exons UNION ALL SELECT 'p', gene_id, s, e, code FROM pred),
withi AS (SELECT side, gene_id, s, e, code FROM duo UNION ALL SELECT side, gene_id, e + 1, nx - 1, 'I' FROM (SELECT *, lead(s) OVER (PARTITION BY side, gene_id ORDER BY s, e) AS nx FROM duo) WHERE nx > e + 1),
cuts AS (SELECT gene_id, s AS x FROM withi UNION SELECT gene_id, e + 1 FROM withi UNION SELECT gene_id, s FROM spans UNION SELECT gene_id, e + 1 FROM spans),
pieces AS (SELECT gene_id, x AS a, lead(x) OVER (PARTITION BY gene_id ORDER BY x) AS b FROM cuts),
coded AS (SELECT p.gene_id, b - a AS n, coalesce(r.code, 'G') AS rc, coalesce(q.code, 'G') AS pc FROM pieces p
  LEFT JOIN withi r ON r.side = 'r' AND r.gene_id = p.gene_id AND r.s <= a AND r.e >= a LEFT JOIN withi q ON q.side = 'p' AND q.gene_id = p.gene_id AND q.s <= a AND q.e >= a WHERE b IS NOT NULL),
nuc AS (SELECT gene_id, CAST(sum(n) AS BIGINT) AS length,
  CAST(sum(n) FILTER (rc = 'C' AND pc = 'C') AS BIGINT) AS cds_tp, CAST(sum(n) FILTER (rc = 'C' AND pc <> 'C') AS BIGINT) AS cds_fn, CAST(sum(n) FILTER (rc <> 'C' AND pc = 'C') AS BIGINT) AS cds_fp, CAST(sum(n) FILTER (rc <> 'C' AND pc <> 'C') AS BIGINT) AS cds_tn,
  CAST(sum(n) FILTER (rc IN ('F','T') AND pc IN ('F','T')) AS BIGINT) AS utr_tp, CAST(sum(n) FILTER (rc IN ('F','T') AND pc NOT IN ('F','T')) AS BIGINT) AS utr_fn,
  CAST(sum(n) FILTER (rc NOT IN ('F','T') AND pc IN ('F','T')) AS BIGINT) AS utr_fp, CAST(sum(n) FILTER (rc NOT IN ('F','T') AND pc NOT IN ('F','T')) AS BIGINT) AS utr_tn, CAST(sum(n) FILTER (rc = pc) AS BIGINT) AS matches FROM coded GROUP BY 1),
nuc0 AS (SELECT gene_id, length, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("cds_tp", "cds_fn", "cds_fp", "cds_tn", "utr_tp", "utr_fn", "utr_fp", "utr_tn", "matches")) + """ FROM nuc),
st AS (SELECT gene_id, """ + ", ".join(f"""count(*) FILTER (kind = '{k}' AND inr AND inp) AS {k}_correct, count(*) FILTER (kind = '{k}' AND inr AND NOT inp) AS {k}_missing, count(*) FILTER (kind = '{k}' AND NOT inr AND inp) AS {k}_wrong""" for k in ("cds", "exon", "utr")) + """
  FROM (SELECT gene_id, kind, s, e, bool_or(side = 'r') AS inr, bool_or(side = 'p') AS inp FROM (SELECT side, gene_id, s, e, 'exon' AS kind FROM duo UNION ALL SELECT side, gene_id, s, e, CASE WHEN code = 'C' THEN 'cds' ELSE 'utr' END FROM duo) GROUP BY gene_id, kind, s, e) GROUP BY 1),
cls AS (SELECT n.*, st.* EXCLUDE (gene_id), CASE WHEN matches = length THEN 'perfect' WHEN cds_missing + cds_wrong = 0 AND exon_missing + exon_wrong = 0 THEN 'mislabeled' WHEN cds_missing + cds_wrong = 0 THEN 'CDS match'
  WHEN exon_missing + exon_wrong = 0 THEN 'exon match' WHEN utr_missing + utr_wrong = 0 AND utr_correct > 0 THEN 'UTR match' ELSE 'non-match' END AS class FROM nuc0 n JOIN st ON st.gene_id = n.gene_id)"""  # fmt: skip


def _spans(spark, d):
    have = V.exons(spark, d).select("gene_id").distinct()
    return V.genes(spark, d).join(have, "gene_id", "left_semi").select("gene_id", (F.col("end") - F.col("start") + 1).alias("length"))


def _nuc(spark, d, e=None):
    e = V.kept_exons(spark, d) if e is None else e
    return K.confusion(_spans(spark, d), e, V.predicted(spark, d, e))


def _structs(spark, d, e=None):
    e = V.kept_exons(spark, d) if e is None else e
    return K.structures(_spans(spark, d), e, V.predicted(spark, d, e))


def _classes(spark, d):
    e = V.kept_exons(spark, d)
    return _nuc(spark, d, e).join(_structs(spark, d, e), "gene_id").withColumn("class", K.classified())


@C.add("clique_model_vector", W("exons", "pred") + _CMP + """ SELECT gene_id, code, s AS "start", e AS "end" FROM withi WHERE side = 'r'""")
def _(spark, d):
    return K.segments(V.exons(spark, d))


@C.add("nuc_confusion", W("exons", "pred") + _CMP + " SELECT * FROM nuc0")
def _(spark, d):
    return _nuc(spark, d)


@C.add("struct_stats", W("exons", "pred") + _CMP + " SELECT * FROM st")
def _(spark, d):
    return _structs(spark, d)


@C.add("join_structure_match", W("exons", "pred") + """ SELECT coalesce(x.gene_id, p.gene_id) AS gene_id, coalesce(x.s, p.s) AS "start", coalesce(x.e, p.e) AS "end", CASE WHEN x.s IS NULL THEN 'wrong' WHEN p.s IS NULL THEN 'missing' ELSE 'correct' END AS outcome
FROM exons x FULL JOIN pred p ON p.gene_id = x.gene_id AND p.s = x.s AND p.e = x.e""")  # fmt: skip
def _(spark, d):
    a = V.exons(spark, d).select("gene_id", "start", "end").withColumn("r", F.lit(1))
    b = V.predicted(spark, d).select("gene_id", "start", "end").withColumn("p", F.lit(1))
    x = a.join(b, ["gene_id", "start", "end"], "full")
    return x.select("gene_id", "start", "end", F.when(F.col("r").isNull(), "wrong").when(F.col("p").isNull(), "missing").otherwise("correct").alias("outcome"))


def _bin_sql(c: str, m: str, w: str) -> str:
    sn, sp = f"({c} / nullif(({c} + {m})::DOUBLE, 0))", f"({c} / nullif(({c} + {w})::DOUBLE, 0))"
    return f"round({sn}, 6) AS sn, round({sp}, 6) AS sp, round(2 * {sn} * {sp} / nullif({sn} + {sp}, 0), 6) AS f1, round(1 - ({sn} + {sp}) / 2, 6) AS ed"


@C.add("stats_binary_resolve", W("exons", "pred") + _CMP + f" SELECT gene_id, {_bin_sql('exon_correct', 'exon_missing', 'exon_wrong')} FROM st")
def _(spark, d):
    x = K.binary(F.col("exon_correct"), F.col("exon_missing"), F.col("exon_wrong"))
    return _structs(spark, d).select("gene_id", *[F.round(v, 6).alias(k) for k, v in x.items()])


_SCALED = """round((cds_tp + cds_tn) / nullif((cds_tp + cds_fn + cds_fp + cds_tn)::DOUBLE, 0), 6) AS mc,
round((cds_tp::DOUBLE * cds_tn - cds_fn::DOUBLE * cds_fp) / nullif(sqrt((cds_tp + cds_fn)::DOUBLE * (cds_tn + cds_fp) * (cds_tp + cds_fp) * (cds_tn + cds_fn)), 0), 6) AS cc, """ + _bin_sql("cds_tp", "cds_fn", "cds_fp")


@C.add("stats_scaled_resolve", W("exons", "pred") + _CMP + f" SELECT gene_id, {_SCALED} FROM nuc0")
def _(spark, d):
    x = K.scaled(*[F.col(f"cds_{k}") for k in ("tp", "fn", "fp", "tn")])
    return _nuc(spark, d).select("gene_id", *[F.round(v, 6).alias(k) for k, v in x.items()])


@C.add("pair_classify", W("exons", "pred") + _CMP + " SELECT gene_id, class FROM cls")
def _(spark, d):
    return _classes(spark, d).select("gene_id", "class")


@C.add("pair_tolerance", W("genes") + " SELECT gene_id, round(pow(10.0, -ceil(log10(e - s + 1))), 9) AS tolerance FROM genes")
def _(spark, d):
    return V.genes(spark, d).select("gene_id", F.round(K.tolerance(F.col("end") - F.col("start") + 1), 9).alias("tolerance"))


@C.add("comparison_aggregate", W("exons", "pred") + _CMP + f""",
agg AS (SELECT g.seqid, CAST(sum(cds_tp) AS BIGINT) AS cds_tp, CAST(sum(cds_fn) AS BIGINT) AS cds_fn, CAST(sum(cds_fp) AS BIGINT) AS cds_fp, CAST(sum(cds_tn) AS BIGINT) AS cds_tn FROM nuc0 n JOIN genes g ON g.gene_id = n.gene_id GROUP BY ROLLUP (g.seqid))
SELECT seqid, cds_tp, cds_fn, cds_fp, cds_tn, {_SCALED} FROM agg""")  # fmt: skip
def _(spark, d):
    x = _nuc(spark, d).join(V.genes(spark, d).select("gene_id", "seqid"), "gene_id")
    names = [f"cds_{k}" for k in ("tp", "fn", "fp", "tn")]
    a = x.rollup("seqid").agg(*[F.sum(n).alias(n) for n in names])
    return a.select("seqid", *names, *[F.round(v, 6).alias(k) for k, v in K.scaled(*[F.col(n) for n in names]).items()])


@C.add("class_summary", W("exons", "pred") + _CMP + """,
c AS (SELECT gene_id, sum(e - s + 1) FILTER (side = 'r' AND code = 'C') AS rl, sum(e - s + 1) FILTER (side = 'p' AND code = 'C') AS pl, count(*) FILTER (side = 'r') AS rx, count(*) FILTER (side = 'p') AS px FROM duo GROUP BY 1)
SELECT class, count(*) AS n, CAST(sum(length) AS BIGINT) AS total_length, CAST(coalesce(sum(rl), 0) AS BIGINT) AS refr_cds, CAST(coalesce(sum(pl), 0) AS BIGINT) AS pred_cds, CAST(sum(rx) AS BIGINT) AS refr_exons, CAST(sum(px) AS BIGINT) AS pred_exons,
round(avg(length), 6) AS mean_length, round(coalesce(sum(rl), 0) / 3.0 / count(*), 6) AS mean_refr_aa FROM cls JOIN c ON c.gene_id = cls.gene_id GROUP BY class""")  # fmt: skip
def _(spark, d):
    n = F.col("end") - F.col("start") + 1
    side = lambda df, t: df.groupBy("gene_id").agg(F.coalesce(F.sum(F.when(F.col("code") == "C", n)), F.lit(0)).alias(f"{t}l"), F.count(F.lit(1)).alias(f"{t}x"))
    x = _classes(spark, d).join(side(V.exons(spark, d), "r"), "gene_id", "left").join(side(V.predicted(spark, d), "p"), "gene_id", "left").na.fill(0, ["rl", "rx", "pl", "px"])
    return x.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("total_length"), F.sum("rl").alias("refr_cds"), F.sum("pl").alias("pred_cds"), F.sum("rx").alias("refr_exons"), F.sum("px").alias("pred_exons"),
        F.round(F.avg("length"), 6).alias("mean_length"), F.round(F.sum("rl") / 3.0 / F.count(F.lit(1)), 6).alias("mean_refr_aa"),
    )


@C.add("run_info", W("exons", "pred") + _MERGED + """,
h AS (SELECT seqid, isle, bool_or(m2.gene_id IN (SELECT gene_id FROM exons)) AS r, bool_or(m2.gene_id IN (SELECT gene_id FROM pred)) AS p, count(*) AS n FROM m2 GROUP BY ALL)
SELECT count(*) AS n_loci, count(*) FILTER (r AND p) AS shared, count(*) FILTER (r AND NOT p) AS unique_refr, count(*) FILTER (p AND NOT r) AS unique_pred, CAST(sum(n) AS BIGINT) AS n_genes, round(sum(n) / count(*)::DOUBLE, 6) AS genes_per_locus FROM h""")  # fmt: skip
def _(spark, d):
    has = lambda df, t: df.select("gene_id").distinct().withColumn(t, F.lit(True))
    g = loci.with_locus(V.genes(spark, d)).join(has(V.exons(spark, d), "r"), "gene_id", "left").join(has(V.predicted(spark, d), "p"), "gene_id", "left").na.fill(False, ["r", "p"])
    h = g.groupBy("seqid", "locus_start").agg(F.max("r").alias("r"), F.max("p").alias("p"), F.count(F.lit(1)).alias("n"))
    r, p = F.col("r"), F.col("p")
    return h.agg(
        F.count(F.lit(1)).alias("n_loci"), F.count_if(r & p).alias("shared"), F.count_if(r & ~p).alias("unique_refr"), F.count_if(p & ~r).alias("unique_pred"), F.sum("n").alias("n_genes"),
        F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("genes_per_locus"),
    )


_COUNTS = """,
lc AS (SELECT m.seqid, m.isle, min(m.s) AS s, max(m.e) AS e, count(DISTINCT m.gene_id) AS genes FROM m2 m GROUP BY ALL),
b AS (SELECT 'r' AS side, gene_id, s, e, code FROM exons UNION ALL SELECT 'p', gene_id, s, e, code FROM pred),
lx AS (SELECT m.seqid, m.isle, """ + ", ".join(f"count(DISTINCT b.gene_id) FILTER (side = '{k}') AS {k}_mrnas, count(*) FILTER (side = '{k}') AS {k}_exons, CAST(coalesce(sum(b.e - b.s + 1) FILTER (side = '{k}' AND code = 'C'), 0) AS BIGINT) AS {k}_cds" for k in "rp") + """ FROM m2 m JOIN b ON b.gene_id = m.gene_id GROUP BY ALL),
lcx AS (SELECT lc.seqid, lc.s AS "start", lc.e AS "end", genes, """ + ", ".join(f"coalesce({k}_{x}, 0) AS {k}_{x}" for k in "rp" for x in ("mrnas", "exons", "cds")) + """ FROM lc LEFT JOIN lx ON lx.seqid = lc.seqid AND lx.isle = lc.isle)"""  # fmt: skip


def _locus_counts(spark, d):
    n = F.col("end") - F.col("start") + 1
    side = lambda df, t: df.groupBy("gene_id").agg(F.count(F.lit(1)).alias(f"{t}x"), F.coalesce(F.sum(F.when(F.col("code") == "C", n)), F.lit(0)).alias(f"{t}c"), F.lit(1).alias(f"{t}m"))
    g = loci.with_locus(V.genes(spark, d)).join(side(V.exons(spark, d), "r"), "gene_id", "left").join(side(V.predicted(spark, d), "p"), "gene_id", "left")
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    x = g.groupBy("seqid", "locus_start").agg(
        F.max("end").alias("end"), F.count(F.lit(1)).alias("genes"), z("rm").alias("r_mrnas"), z("rx").alias("r_exons"), z("rc").alias("r_cds"), z("pm").alias("p_mrnas"), z("px").alias("p_exons"), z("pc").alias("p_cds")
    )
    return x.withColumnRenamed("locus_start", "start")


@C.add("locus_counts", W("exons", "pred") + _MERGED + _COUNTS + " SELECT * FROM lcx")
def _(spark, d):
    return _locus_counts(spark, d)


@C.add("locus_ids", W("genes") + _MERGED + """ SELECT seqid, min(s) AS "start", string_agg(gene_id, ',' ORDER BY gene_id) AS gene_ids, string_agg('m' || gene_id, ',' ORDER BY gene_id) AS mrna_ids FROM m2 GROUP BY seqid, isle""")
def _(spark, d):
    g = loci.with_locus(V.genes(spark, d)).groupBy("seqid", F.col("locus_start").alias("start")).agg(F.array_sort(F.collect_list("gene_id")).alias("g"))
    return g.select("seqid", "start", F.array_join(F.transform("g", lambda x: x.cast("string")), ",").alias("gene_ids"), F.array_join(F.transform("g", lambda x: F.concat(F.lit("m"), x.cast("string"))), ",").alias("mrna_ids"))


@C.add("filter_locus", W("exons", "pred") + _MERGED + _COUNTS + """ SELECT seqid, "start", "end" FROM lcx WHERE "end" - "start" + 1 >= 1000 AND genes < 4 AND r_exons > 3 AND p_cds <= 400""")
def _(spark, d):
    from strandline.sources.readers import locus_filters

    rules = locus_filters("# a comment\nLocusLength >= 1000\nGeneCount < 4\nExonCount > 3 R\nCDSLength <= 400 P\nTranscriptCount <> 0\n")
    return _locus_counts(spark, d).where(rules).select("seqid", "start", "end")


@C.add("filter_max_transcripts", W("exons", "pred") + _MERGED + _COUNTS + """ SELECT seqid, "start", r_mrnas + p_mrnas AS n FROM lcx WHERE r_mrnas + p_mrnas <= 8""")
def _(spark, d):
    return _locus_counts(spark, d).select("seqid", "start", (F.col("r_mrnas") + F.col("p_mrnas")).alias("n")).where("n <= 8")


def _locus_parts(spark, d):
    part = F.struct("gene_id", "start", "end", "code")
    side = lambda df, t: df.groupBy("gene_id").agg(F.collect_list(part).alias(t))
    g = loci.with_locus(V.genes(spark, d)).join(side(V.exons(spark, d), "refr"), "gene_id", "left").join(side(V.predicted(spark, d), "pred"), "gene_id", "left")
    per = g.groupBy("seqid", "locus_start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("refr")).alias("refr"), F.flatten(F.collect_list("pred")).alias("pred"))
    return per.select(F.concat("seqid", F.lit(":"), "locus_start").alias("locus"), "n", F.col("locus_start").alias("start"), "end", "refr", "pred")


@C.add("locus_compare")
def locus_compare(spark, d):
    ship(spark)
    return K.selected_pairs(_locus_parts(spark, d).where("size(refr) > 0 AND size(pred) > 0"))


@C.add("pair_rank")
def _(spark, d):
    """The pairs of cliques of each locus, with their ranks in it."""
    ship(spark)
    return K.ranked_pairs(_locus_parts(spark, d).where("size(refr) > 0 AND size(pred) > 0"))


@C.add("pair_select_greedy")
def _(spark, d):
    return locus_compare(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_matches").alias("n_matches"))


@C.add("join_refr_pred_pairs", W("exons", "pred") + _MERGED + """,
rr AS (SELECT DISTINCT seqid, isle, x.gene_id FROM m2 JOIN (SELECT DISTINCT gene_id FROM exons) x ON x.gene_id = m2.gene_id), pp AS (SELECT DISTINCT seqid, isle, x.gene_id FROM m2 JOIN (SELECT DISTINCT gene_id FROM pred) x ON x.gene_id = m2.gene_id)
SELECT rr.gene_id AS refr, pp.gene_id AS pred FROM rr JOIN pp ON pp.seqid = rr.seqid AND pp.isle = rr.isle""")  # fmt: skip
def _(spark, d):
    """Transcripts of both sides in one locus; overlapping genes only, so that pairs stay few."""
    g = loci.with_locus(V.genes(spark, d)).select("gene_id", "seqid", "locus_start")
    r = g.join(V.exons(spark, d).select("gene_id").distinct(), "gene_id", "left_semi").withColumnRenamed("gene_id", "refr")
    p = g.join(V.predicted(spark, d).select("gene_id").distinct(), "gene_id", "left_semi").withColumnRenamed("gene_id", "pred")
    return r.join(p, ["seqid", "locus_start"]).select("refr", "pred")


_CLIQUES = W("exons") + _MERGED + """,
tr AS (SELECT m2.seqid, m2.isle, core.s AS locus_start, m2.gene_id, m2.s, m2.e, coalesce(x.n, 0) AS n_exons, coalesce(x.u, 0) AS n_utrs, coalesce(x.c, 0) AS cds_length FROM m2 JOIN core USING (seqid, isle)
  LEFT JOIN (SELECT gene_id, count(*) AS n, count(*) FILTER (code <> 'C') AS u, sum(e - s + 1) FILTER (code = 'C') AS c FROM exons GROUP BY 1) x ON x.gene_id = m2.gene_id),
nx AS (SELECT a.seqid, a.isle, a.e AS at, min(b.e) AS lim FROM (SELECT seqid, isle, e FROM tr UNION SELECT seqid, isle, -1 FROM tr) a JOIN tr b ON b.seqid = a.seqid AND b.isle = a.isle AND b.s > a.e GROUP BY ALL),
grow AS (SELECT DISTINCT seqid, isle, CAST(-1 AS BIGINT) AS at, CAST([] AS BIGINT[]) AS ids FROM tr
  UNION ALL SELECT g.seqid, g.isle, t.e, list_append(g.ids, t.gene_id) FROM grow g JOIN nx ON nx.seqid = g.seqid AND nx.isle = g.isle AND nx.at = g.at JOIN tr t ON t.seqid = g.seqid AND t.isle = g.isle AND t.s > g.at AND t.s <= nx.lim),
sets AS (SELECT seqid, isle, [gene_id] AS ids FROM tr UNION ALL SELECT g.seqid, g.isle, ids FROM grow g ANTI JOIN nx ON nx.seqid = g.seqid AND nx.isle = g.isle AND nx.at = g.at WHERE len(ids) > 1),
cl AS (SELECT seqid, isle, list_sort(ids) AS ids FROM sets),
told AS (SELECT c.seqid || ':' || any_value(t.locus_start) AS locus, CAST(len(c.ids) AS INTEGER) AS size, array_to_string(c.ids, ',') AS ids, CAST(sum(n_exons) AS BIGINT) AS num_exons, CAST(sum(n_utrs) AS BIGINT) AS num_utrs, CAST(sum(cds_length) AS BIGINT) AS cds_length
  FROM cl c JOIN tr t ON t.seqid = c.seqid AND t.isle = c.isle AND list_contains(c.ids, t.gene_id) GROUP BY c.seqid, c.isle, c.ids)"""


def _cliques(spark, d):
    ship(spark)
    n = F.col("end") - F.col("start") + 1
    x = V.exons(spark, d).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n_exons"), F.count_if(F.col("code") != "C").alias("n_utrs"), F.sum(F.when(F.col("code") == "C", n)).alias("cds_length"))
    g = loci.with_locus(V.genes(spark, d)).join(x, "gene_id", "left")
    g = g.groupBy("seqid", "locus_start").agg(F.collect_list(F.struct("gene_id", "start", "end", "n_exons", "n_utrs", "cds_length")).alias("transcripts"))
    return K.enumerated(g.select(F.concat("seqid", F.lit(":"), "locus_start").alias("locus"), "transcripts"))


@C.add("clique_enumerate", _CLIQUES + " SELECT locus, size, ids FROM told")
def _(spark, d):
    return _cliques(spark, d).select("locus", "size", "ids")


@C.add("clique_accessors", _CLIQUES + " SELECT locus, size, ids, num_exons, num_utrs, cds_length FROM told")
def _(spark, d):
    return _cliques(spark, d).select("locus", "size", "ids", "num_exons", "num_utrs", "cds_length")


# support

_COV = """,
cut AS (SELECT x.gene_id, greatest(x.s, a.s) AS s, least(x.e, a.e) AS e FROM exons x JOIN aln a ON a.seqid = x.seqid AND a.strand = x.strand AND a.s <= x.e AND a.e >= x.s),
c1 AS (SELECT *, max(e) OVER (PARTITION BY gene_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM cut),
c2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY gene_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM c1),
c3 AS (SELECT gene_id, sum(n) AS covered FROM (SELECT gene_id, i, max(e) - min(s) + 1 AS n FROM c2 GROUP BY ALL) GROUP BY 1),
cov AS (SELECT x.gene_id, CAST(coalesce(any_value(c3.covered), 0) AS BIGINT) AS covered, CAST(sum(x.e - x.s + 1) AS BIGINT) AS length FROM exons x LEFT JOIN c3 ON c3.gene_id = x.gene_id GROUP BY 1)"""
_GAPS = _INTRONS + """,
gap AS (SELECT DISTINCT a.seqid, a.e + 1 AS s, nx - 1 AS e FROM (SELECT *, lead(s) OVER (PARTITION BY aln_id ORDER BY s, e) AS nx FROM aln) a WHERE nx > a.e + 1),
conf AS (SELECT i.gene_id, count(*) AS n_introns, count(g.s) AS n_confirmed FROM intr i LEFT JOIN gap g ON g.seqid = i.seqid AND g.s = i.s AND g.e = i.e GROUP BY 1)"""


def _coverage(spark, d, e=None):
    e = V.kept_exons(spark, d) if e is None else e
    return support.coverage(e, V.alignments(spark, d, e))


def _confirmed(spark, d, e=None):
    e = V.kept_exons(spark, d) if e is None else e
    al = V.alignments(spark, d, e)
    gaps = S.introns(al, "aln_id").join(al.select("aln_id", "seqid").distinct(), "aln_id")
    return support.confirmed(_introns(spark, d, e), gaps)


@C.add("coverage", W("exons", "aln") + _COV + " SELECT gene_id, covered, length, round(covered / length::DOUBLE, 6) AS coverage FROM cov")
def _(spark, d):
    return _coverage(spark, d).withColumn("coverage", F.round("coverage", 6))


@C.add("join_intron_gap", W("exons", "aln") + _GAPS + " SELECT * FROM conf")
def _(spark, d):
    return _confirmed(spark, d)


@C.add("integrity", W("exons", "aln") + _COV + _GAPS + """,
len AS (SELECT gene_id, coalesce(sum(e - s + 1) FILTER (code = 'C'), 0) AS c, coalesce(sum(e - s + 1) FILTER (code = 'F'), 0) AS f, coalesce(sum(e - s + 1) FILTER (code = 'T'), 0) AS t FROM exons GROUP BY 1)
SELECT cov.gene_id, round(0.6::DOUBLE * least(1.0::DOUBLE, CASE WHEN conf.gene_id IS NULL THEN c / 400.0::DOUBLE ELSE n_confirmed / n_introns::DOUBLE END) + 0.3::DOUBLE * least(1.0::DOUBLE, covered / cov.length::DOUBLE) + 0.05::DOUBLE * least(1.0::DOUBLE, f / 200.0::DOUBLE) + 0.05::DOUBLE * least(1.0::DOUBLE, t / 100.0::DOUBLE) + 1e-9::DOUBLE, 6) AS integrity
FROM cov JOIN len ON len.gene_id = cov.gene_id LEFT JOIN conf ON conf.gene_id = cov.gene_id""")  # fmt: skip
def _(spark, d):
    n = F.col("end") - F.col("start") + 1
    e = V.kept_exons(spark, d)
    size = e.groupBy("gene_id").agg(*[F.coalesce(F.sum(F.when(F.col("code") == c, n)), F.lit(0)).alias(c) for c in "CFT"])
    x = _coverage(spark, d, e).join(size, "gene_id").join(_confirmed(spark, d, e), "gene_id", "left")
    cds, u5, u3 = support.EXPECTED
    a = F.when(F.col("n_introns").isNull(), F.col("C") / cds).otherwise(F.col("n_confirmed") / F.col("n_introns"))
    return x.select("gene_id", F.round(support.integrity(a, F.col("coverage"), F.col("F") / u5, F.col("T") / u3) + F.lit(1e-9), 6).alias("integrity"))
