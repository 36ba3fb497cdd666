"""Queries on features: types, filters, labels, trees, accessions, protein maps, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import attributes as A
from strandline.functions import sequence as Q
from strandline.functions.types import NAMES, TRANSCRIPTS, is_a
from strandline.operators import features as O
from strandline.operators.packed import values_of
from strandline.plans import views as V
from strandline.plans.catalog import Catalog
from strandline.plans.problems import _VALUES
from strandline.session import ship, table

C = Catalog()
W = V.with_views
_IN = lambda kinds: "(" + ", ".join("'" + k.replace("'", "''") + "'" for k in kinds) + ")"

#: SQL: links between features of a file, and the top-level features above each.
_TREE = f"""
WITH RECURSIVE {V.SQL["feats"]},
n AS (SELECT DISTINCT file_id, id FROM feats WHERE id IS NOT NULL),
v AS (SELECT DISTINCT file_id, line_no, id, type, unnest({_VALUES.format(c="parent")}) AS p FROM feats WHERE parent IS NOT NULL),
l AS (SELECT DISTINCT v.file_id, v.id AS c, v.p FROM v SEMI JOIN n ON v.file_id = n.file_id AND v.p = n.id WHERE v.id IS NOT NULL),
r AS (SELECT file_id, c, p FROM l UNION SELECT r.file_id, r.c, l.p FROM r JOIN l ON r.file_id = l.file_id AND r.p = l.c),
bad AS (SELECT DISTINCT x.file_id, x.c AS id FROM r x JOIN r y ON x.file_id = y.file_id AND x.p = y.c AND y.c = y.p UNION SELECT file_id, c FROM r WHERE c = p),
top AS (SELECT r.file_id, r.c AS id, r.p AS top FROM r ANTI JOIN l ON r.file_id = l.file_id AND r.p = l.c ANTI JOIN bad ON bad.file_id = r.file_id AND bad.id = r.c
  UNION ALL SELECT n.file_id, n.id, n.id FROM n ANTI JOIN l ON n.file_id = l.file_id AND n.id = l.c),
und AS (SELECT f.*, top.top FROM feats f JOIN top ON f.file_id = top.file_id AND f.id = top.id
  UNION ALL SELECT DISTINCT f.*, top.top FROM feats f JOIN v ON v.file_id = f.file_id AND v.line_no = f.line_no AND v.id IS NULL JOIN top ON top.file_id = v.file_id AND top.id = v.p WHERE f.id IS NULL)
"""


def _attr(key: str, c: str = "attributes") -> str:
    return f"nullif(trim(regexp_extract({c}, '(?:^|;)\\s*{key}=([^;\\n]+)', 1)), '')"


for _kind in NAMES:

    @C.add(f"typecheck_{_kind}", f"SELECT row_id, type FROM features WHERE type IN {_IN(NAMES[_kind])}")
    def _(spark, d, kind=_kind):
        return table(spark, d, "features").where(is_a(kind)).select("row_id", "type")


def _f(spark, d):
    ship(spark)
    return V.features(spark, d)


@C.add("select_by_type", _TREE + " SELECT file_id, top, line_no, s AS \"start\", e AS \"end\" FROM und WHERE type = 'exon'")
def _(spark, d):
    return O.under(_f(spark, d), is_a("exon")).select("file_id", "top", "line_no", "start", "end")


@C.add("select_by_type_str", _TREE + " SELECT file_id, top, line_no, type FROM und WHERE type = 'repeat_region'")
def _(spark, d):
    return O.under(_f(spark, d), F.col("type") == "repeat_region").select("file_id", "top", "line_no", "type")


@C.add("count_by_type", _TREE + " SELECT file_id, top, count(*) FILTER (type = 'exon') AS n_exons, count(*) FILTER (type = 'CDS') AS n_cds, count(*) AS n FROM und GROUP BY ALL")
def _(spark, d):
    return O.under(_f(spark, d), F.lit(True)).groupBy("file_id", "top").agg(F.count_if(is_a("exon")).alias("n_exons"), F.count_if(F.col("type") == "CDS").alias("n_cds"), F.count(F.lit(1)).alias("n"))


@C.add("filter_type", W("feats") + """ SELECT file_id, coalesce(id, 'line' || line_no) AS id, type, min(s) AS "start", max(e) AS "end", count(*) AS n_parts
FROM feats WHERE type IN ('gene', 'match', 'CDS') GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    f = V.features(spark, d).where("type IN ('gene', 'match', 'CDS')")
    return f.groupBy("file_id", F.coalesce("id", F.concat(F.lit("line"), "line_no")).alias("id"), "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_parts"))


@C.add("filter_attribute", _TREE + f""",
off AS (SELECT DISTINCT file_id, top FROM und WHERE {_attr("gene_biotype")} = 'ncRNA'),
gone AS (SELECT DISTINCT top.file_id, top.id FROM top SEMI JOIN off ON top.file_id = off.file_id AND top.top = off.top)
SELECT f.file_id, f.line_no FROM feats f ANTI JOIN gone ON f.file_id = gone.file_id AND f.id = gone.id
WHERE NOT (f.id IS NULL AND EXISTS (SELECT 1 FROM v JOIN gone g ON g.file_id = v.file_id AND g.id = v.p WHERE v.file_id = f.file_id AND v.line_no = f.line_no AND v.id IS NULL))""")  # fmt: skip
def _(spark, d):
    return O.without_trees(_f(spark, d), A.get("attributes", "gene_biotype") == "ncRNA").select("file_id", "line_no")


@C.add("filter_id", W("feats") + f""", w AS (SELECT DISTINCT file_id, unnest({_VALUES.format(c="parent")}) AS id FROM feats WHERE type = 'mRNA' AND accession IN (SELECT trim(MrnaID, ' ' || chr(9)) FROM ilocus_mrnas))
SELECT f.file_id, f.line_no, f.id FROM feats f SEMI JOIN w ON w.file_id = f.file_id AND w.id = f.id WHERE f.parent IS NULL""")  # fmt: skip
def _(spark, d):
    f = V.features(spark, d)
    known = table(spark, d, "ilocus_mrnas").select(F.btrim("MrnaID", F.lit(" \t")).alias("accession")).where("accession IS NOT NULL").distinct()
    wanted = f.where("type = 'mRNA'").join(known, "accession", "left_semi").select("file_id", F.explode(values_of("parent")).alias("id")).distinct()
    return f.where("parent IS NULL").join(wanted, ["file_id", "id"], "left_semi").select("file_id", "line_no", "id")


@C.add("filter_pattern", "SELECT line_id FROM raw_gff3 WHERE line IS NOT NULL AND NOT regexp_matches(line, 'odor receptor|(?:^|\\t)QW_00000[0-4]|draft')")
def _(spark, d):
    return table(spark, d, "raw_gff3").where(~F.col("line").rlike(r"odor receptor|(?:^|\t)QW_00000[0-4]|draft")).select("line_id")


@C.add("filter_defline", "SELECT file_id, seqid, count(*) AS n FROM sequences WHERE defline IS NOT NULL AND NOT (contains(defline, 'partial') OR contains(defline, 'isoform X')) GROUP BY ALL")
def _(spark, d):
    bad = F.array(F.lit("partial"), F.lit("isoform X"))
    return table(spark, d, "sequences").where("defline IS NOT NULL").where(~F.exists(bad, lambda p: F.contains(F.col("defline"), p))).groupBy("file_id", "seqid").agg(F.count(F.lit(1)).alias("n"))


@C.add("filter_lines_fixed", "SELECT row_id FROM features WHERE type IS NULL OR type NOT IN ('region', 'match', 'cDNA_match')")
def _(spark, d):
    return table(spark, d, "features").where("type IS NULL OR type NOT IN ('region', 'match', 'cDNA_match')").select("row_id")


@C.add("filter_pseudogenic_cds", _TREE + """ SELECT file_id, line_no FROM feats f WHERE type = 'CDS' AND NOT EXISTS
(SELECT 1 FROM v JOIN feats p ON p.file_id = v.file_id AND p.id = v.p WHERE p.type IN ('pseudogene', 'gene_segment') AND v.file_id = f.file_id AND v.line_no = f.line_no AND v.id IS NOT DISTINCT FROM f.id AND v.type = 'CDS')""")  # fmt: skip
def _(spark, d):
    f = V.features(spark, d).where("type = 'CDS'")
    kinds = V.features(spark, d).where("type IN ('pseudogene', 'gene_segment') AND id IS NOT NULL").select("file_id", F.col("id").alias("p")).distinct()
    hit = f.withColumn("p", F.explode(values_of("parent"))).join(kinds, ["file_id", "p"], "left_semi").select("file_id", "line_no", F.coalesce("id", F.lit("")).alias("_i")).distinct()
    return f.withColumn("_i", F.coalesce("id", F.lit(""))).join(hit, ["file_id", "line_no", "_i"], "left_anti").select("file_id", "line_no")


@C.add("fasta_select", "SELECT file_id, seqid, seq FROM sequences WHERE seqid IN (SELECT trim(ProteinID, ' ' || chr(9)) FROM protein2ilocus WHERE ProteinID IS NOT NULL)")
def _(spark, d):
    ids = table(spark, d, "protein2ilocus").select(F.btrim("ProteinID", F.lit(" \t")).alias("seqid")).where("seqid <> ''").distinct()
    return table(spark, d, "sequences").join(ids, "seqid", "left_semi").select("file_id", "seqid", "seq")


@C.add("feature_label", W("feats") + f""" SELECT file_id, line_no, coalesce(accession, {_attr("Name")}, id, type || ':' || seqid || '_' || s || '-' || e || coalesce(strand, '.')) AS label FROM feats""")
def _(spark, d):
    return V.features(spark, d).select("file_id", "line_no", O.labels().alias("label"))


@C.add("set_source", "SELECT row_id, 'strandline' AS source FROM features")
def _(spark, d):
    return table(spark, d, "features").withColumn("source", F.lit("strandline")).select("row_id", "source")


@C.add("remove_children", W("feats") + f" SELECT file_id, line_no, type FROM feats WHERE parent IS NULL OR len({_VALUES.format(c='parent')}) = 0")
def _(spark, d):
    return V.features(spark, d).where(F.size(values_of("parent")) == 0).select("file_id", "line_no", "type")


@C.add("remove_tree", _TREE + """, gone AS (SELECT top.file_id, top.id FROM top WHERE (file_id, top) IN (SELECT (file_id, id) FROM feats WHERE type = 'pseudogene'))
SELECT f.file_id, f.id FROM (SELECT DISTINCT file_id, id FROM feats WHERE id IS NOT NULL) f ANTI JOIN gone ON f.file_id = gone.file_id AND f.id = gone.id""")  # fmt: skip
def _(spark, d):
    return O.without_trees(_f(spark, d), is_a("pseudogene") & F.col("id").isNotNull()).where("id IS NOT NULL").select("file_id", "id").distinct()


_PSEUDO = f"(type IN ('gene', 'pseudogene') AND coalesce({_attr('gene_biotype')}, '') = 'ncRNA')"


@C.add("pseudogene_fix", _TREE.replace("attributes FROM features", "replace(attributes, 'gene_biotype=ncRNA', 'pseudo=true') AS attributes FROM features") + f""",
flag AS (SELECT DISTINCT file_id, id FROM feats WHERE type IN ('gene', 'pseudogene') AND {_attr("pseudo")} = 'true' AND id IS NOT NULL),
ins AS (SELECT DISTINCT und.file_id, und.line_no, und.id FROM und SEMI JOIN flag ON flag.file_id = und.file_id AND flag.id = und.top)
SELECT f.file_id, f.line_no, CASE WHEN f.type IN ('gene', 'pseudogene') AND {_attr("pseudo", "f.attributes")} = 'true' THEN 'pseudogene' WHEN ins.file_id IS NULL THEN f.type
  WHEN f.type IN ('mRNA', 'transcript') THEN 'pseudogenic_transcript' WHEN f.type = 'exon' THEN 'pseudogenic_exon' WHEN f.type = 'CDS' THEN 'pseudogenic_CDS' ELSE f.type END AS type
FROM feats f LEFT JOIN ins ON ins.file_id = f.file_id AND ins.line_no = f.line_no AND ins.id IS NOT DISTINCT FROM f.id""")  # fmt: skip
def _(spark, d):
    f = _f(spark, d).withColumn("attributes", F.replace("attributes", F.lit("gene_biotype=ncRNA"), F.lit("pseudo=true")))
    return O.pseudogenes_fixed(f).select("file_id", "line_no", "type")


_GENEID = "nullif(regexp_extract(attributes, 'GeneID:([^;,|/ \"'']+)', 1), '')"
_RULES = {
    "refseq": (_GENEID, f"coalesce({_attr('transcript_id')}, {_GENEID} || ':' || type)"),
    "crg": ("id", "id"),
    "tair": (_attr("Name"), _attr("Name")),
    "beebase": (_attr("Name"), _attr("Name")),
    "hymbase": (_attr("Name"), _attr("Name")),
    "pdom": (_attr("Name"), "id"),
    "am10": ("NULL", _attr("Name")),
    "local": (f"coalesce(accession, {_attr('Name')})", f"coalesce({_attr('protein_id')}, accession, {_attr('Name')})"),
}
for _source, (_g, _t) in _RULES.items():

    @C.add(f"format_accession_{_source}", W("feats") + f""",
x AS (SELECT *, {_VALUES.format(c="parent")}[1] AS up, CASE WHEN type LIKE '%gene_segment' THEN {_GENEID} WHEN type = 'gene' THEN {_g} WHEN type IN {_IN(TRANSCRIPTS)} THEN {_t} END AS own FROM feats),
y AS (SELECT file_id, id, min(own) AS theirs FROM x WHERE id IS NOT NULL AND own IS NOT NULL GROUP BY ALL)
SELECT x.file_id, x.line_no, x.type, coalesce(x.accession, x.own, CASE WHEN x.type IN ('exon', 'intron', 'CDS') THEN y.theirs END) AS found FROM x LEFT JOIN y ON y.file_id = x.file_id AND y.id = x.up""")  # fmt: skip
    def _(spark, d, source=_source):
        return O.accessions(V.features(spark, d), source)


@C.add("format_accession_genbank", W("feats") + f""",
x AS (SELECT *, {_VALUES.format(c="parent")}[1] AS up FROM feats),
g AS (SELECT file_id, id, min({_attr('Name')}) AS acc FROM feats WHERE type = 'gene' AND id IS NOT NULL GROUP BY ALL),
y AS (SELECT x.*, CASE WHEN type LIKE '%gene_segment' THEN {_GENEID} WHEN type = 'gene' THEN {_attr('Name')} WHEN type IN {_IN(TRANSCRIPTS)} THEN g.acc || '.' || type END AS own FROM x LEFT JOIN g ON g.file_id = x.file_id AND g.id = x.up),
z AS (SELECT file_id, id, min(own) AS theirs FROM y WHERE id IS NOT NULL AND own IS NOT NULL GROUP BY ALL)
SELECT y.file_id, y.line_no, y.type, coalesce(y.accession, y.own, CASE WHEN y.type IN ('exon', 'intron', 'CDS') THEN z.theirs END) AS found FROM y LEFT JOIN z ON z.file_id = y.file_id AND z.id = y.up""")  # fmt: skip
def _(spark, d):
    return O.accessions(V.features(spark, d), "genbank")


@C.add("format_prefix", W("feats") + " SELECT DISTINCT file_id, split_part(file_id, '.', 1) || '_' || seqid AS seqid FROM feats UNION SELECT DISTINCT file_id, label || '_' || seqid FROM regions WHERE seqid IS NOT NULL AND label IS NOT NULL")
def _(spark, d):
    f = V.features(spark, d).select("file_id", F.concat(F.substring_index("file_id", ".", 1), F.lit("_"), "seqid").alias("seqid"))
    r = table(spark, d, "regions").where("seqid IS NOT NULL AND label IS NOT NULL").select("file_id", F.concat("label", F.lit("_"), "seqid").alias("seqid"))
    return f.union(r).distinct()


@C.add("name_dup", W("feats") + f" SELECT file_id, line_no, coalesce({_attr('Name')}, id) AS name FROM feats WHERE coalesce({_attr('Name')}, id) IS NOT NULL")
def _(spark, d):
    return V.features(spark, d).select("file_id", "line_no", F.coalesce(A.get("attributes", "Name"), "id").alias("name")).where("name IS NOT NULL")


@C.add("align_convert", W("feats") + f""",
p AS (SELECT DISTINCT file_id, id, type FROM feats WHERE id IS NOT NULL AND type IN ('match', 'cDNA_match', 'EST_match', 'nucleotide_match', 'protein_match'))
SELECT f.file_id, f.line_no, p.id, p.type, f.seqid, f.s AS "start", f.e AS "end", f.strand FROM feats f JOIN p ON p.file_id = f.file_id AND p.id = {_VALUES.format(c="f.parent")}[1] WHERE f.type = 'match_part'""")  # fmt: skip
def _(spark, d):
    return O.aligned(V.features(spark, d))


@C.add("join_parent", _TREE + """ SELECT DISTINCT v.file_id, v.line_no, v.p AS parent_id, f.type AS parent_type FROM v JOIN (SELECT DISTINCT file_id, id, type FROM feats WHERE id IS NOT NULL) f ON f.file_id = v.file_id AND f.id = v.p""")
def _(spark, d):
    f = V.features(spark, d)
    p = f.where("id IS NOT NULL").select("file_id", F.col("id").alias("parent_id"), F.col("type").alias("parent_type")).distinct()
    return O.links(f).join(p, ["file_id", "parent_id"]).select("file_id", "line_no", "parent_id", "parent_type").distinct()


@C.add("join_ancestor", _TREE + " SELECT file_id, id, top FROM top")
def _(spark, d):
    return O.closure(_f(spark, d))


@C.add("intron_accession", W("feats") + f""",
p AS (SELECT file_id, id, min(accession) AS acc FROM feats WHERE id IS NOT NULL AND accession IS NOT NULL AND type IN {_IN(TRANSCRIPTS)} GROUP BY ALL)
SELECT f.file_id, f.line_no, p.acc AS accession FROM feats f LEFT JOIN p ON p.file_id = f.file_id AND p.id = {_VALUES.format(c="f.parent")}[1] WHERE f.type = 'intron'""")  # fmt: skip
def _(spark, d):
    f = V.features(spark, d)
    p = f.where(F.col("id").isNotNull() & F.col("accession").isNotNull() & F.col("type").isin(*TRANSCRIPTS)).groupBy("file_id", F.col("id").alias("p")).agg(F.min("accession").alias("acc"))
    x = f.where("type = 'intron'").select("file_id", "line_no", F.get(values_of("parent"), F.lit(0)).alias("p"))
    return x.join(p, ["file_id", "p"], "left").select("file_id", "line_no", F.col("acc").alias("accession"))


@C.add("gff3_profile", _TREE + """ SELECT type AS child, NULL::VARCHAR AS parent, count(*) AS n, count(*) FILTER (parent IS NULL) AS n_top FROM feats GROUP BY type
UNION ALL SELECT c.type, p.type, count(*), NULL FROM (SELECT DISTINCT file_id, line_no, type, id, s, e, seqid, source, score, strand, phase, accession, attributes, parent, unnest(""" + _VALUES.format(c="parent") + """) AS pp FROM feats) c
JOIN (SELECT DISTINCT file_id, id, type, accession FROM feats WHERE id IS NOT NULL) p ON p.file_id = c.file_id AND p.id = c.pp GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    return O.profile(V.features(spark, d))


@C.add("attr_get", W("feats") + f" SELECT file_id, line_no, {_attr('product')} AS product, {_attr('gene_biotype')} AS biotype FROM feats WHERE {_attr('product')} IS NOT NULL OR {_attr('gene_biotype')} IS NOT NULL")
def _(spark, d):
    x = V.features(spark, d).select("file_id", "line_no", A.get("attributes", "product").alias("product"), A.get("attributes", "gene_biotype").alias("biotype"))
    return x.where("product IS NOT NULL OR biotype IS NOT NULL")


@C.add("attr_map")
def _(spark, d):
    """Each pair of the attributes, decoded."""
    return V.features(spark, d).where("attributes IS NOT NULL").select("file_id", "line_no", F.explode(A.as_map("attributes")).alias("key", "value"))


@C.add("mrna_exons", _TREE + """ SELECT DISTINCT v.file_id, v.line_no, v.p AS mrna_id, f.s AS "start", f.e AS "end" FROM v JOIN feats f ON f.file_id = v.file_id AND f.line_no = v.line_no AND f.type = 'exon'
SEMI JOIN (SELECT file_id, id FROM feats WHERE type = 'mRNA') m ON m.file_id = v.file_id AND m.id = v.p WHERE v.type = 'exon'""")  # fmt: skip
def _(spark, d):
    f = V.features(spark, d)
    m = f.where("type = 'mRNA' AND id IS NOT NULL").select("file_id", F.col("id").alias("mrna_id")).distinct()
    x = f.where("type = 'exon'").select("file_id", "line_no", "start", "end", F.explode(values_of("parent")).alias("mrna_id"))
    return x.join(m, ["file_id", "mrna_id"], "left_semi").select("file_id", "line_no", "mrna_id", "start", "end").distinct()


@C.add("locus_pairwise_label", W("feats") + " SELECT file_id, CASE WHEN file_id LIKE '%.00000' THEN 'refr' ELSE 'pred' END AS origin, count(*) AS n FROM feats WHERE type = 'gene' GROUP BY ALL")
def _(spark, d):
    return V.features(spark, d).where("type = 'gene'").groupBy("file_id", F.when(F.endswith("file_id", F.lit(".00000")), "refr").otherwise("pred").alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@C.add("infer_regions", W("feats") + """,
i AS (SELECT file_id, seqid, min(s) AS s, max(e) AS e FROM feats GROUP BY ALL), g AS (SELECT file_id, seqid, min("start") AS s, max("end") AS e FROM regions WHERE file_id IS NOT NULL AND seqid IS NOT NULL AND "start" <= "end" GROUP BY ALL)
SELECT i.file_id, i.seqid, coalesce(g.s, i.s) AS "start", coalesce(g.e, i.e) AS "end", g.s IS NULL AS inferred FROM i LEFT JOIN g ON g.file_id = i.file_id AND g.seqid = i.seqid""")  # fmt: skip
def _(spark, d):
    i = V.features(spark, d).groupBy("file_id", "seqid").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    g = table(spark, d, "regions").where("file_id IS NOT NULL AND seqid IS NOT NULL AND start <= end").groupBy("file_id", "seqid").agg(F.min("start").alias("gs"), F.max("end").alias("ge"))
    return i.join(g, ["file_id", "seqid"], "left").select("file_id", "seqid", F.coalesce("gs", "s").alias("start"), F.coalesce("ge", "e").alias("end"), F.col("gs").isNull().alias("inferred"))


_TWO = """
WITH a AS (SELECT seqid, min("start") AS s, max("end") AS e FROM regions WHERE seqid IS NOT NULL AND "start" <= "end" AND ends_with(file_id, '0') GROUP BY 1),
b AS (SELECT seqid, min("start") AS s, max("end") AS e FROM regions WHERE seqid IS NOT NULL AND "start" <= "end" AND NOT ends_with(file_id, '0') GROUP BY 1)"""


def _two(spark, d):
    r = table(spark, d, "regions").where("seqid IS NOT NULL AND start <= end")
    side = lambda c: r.where(c).groupBy("seqid").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return side(F.endswith("file_id", F.lit("0"))), side(~F.endswith("file_id", F.lit("0")))


@C.add("copy_regions_pairwise", _TWO + ' SELECT coalesce(a.seqid, b.seqid) AS seqid, least(a.s, b.s) AS "start", greatest(a.e, b.e) AS "end" FROM a FULL JOIN b ON a.seqid = b.seqid')
def _(spark, d):
    a, b = _two(spark, d)
    both = a.join(b.select("seqid", F.col("s").alias("s2"), F.col("e").alias("e2")), "seqid", "full")
    return both.select("seqid", F.least("s", "s2").alias("start"), F.greatest("e", "e2").alias("end"))


@C.add("copy_regions", _TWO + ' SELECT seqid, s AS "start", e AS "end" FROM a UNION ALL SELECT seqid, s, e FROM b ANTI JOIN a ON a.seqid = b.seqid')
def _(spark, d):
    a, b = _two(spark, d)
    return a.unionByName(b.join(a, "seqid", "left_anti")).select("seqid", F.col("s").alias("start"), F.col("e").alias("end"))


@C.add("union_seqids", """SELECT DISTINCT seqid FROM (SELECT seqid FROM features UNION ALL SELECT seqid FROM locus) WHERE seqid IS NOT NULL""")
def _(spark, d):
    return table(spark, d, "features").select("seqid").union(table(spark, d, "locus").select("seqid")).where("seqid IS NOT NULL").distinct()


@C.add("union_streams", "SELECT seqid, \"start\", \"end\", 'feature' AS origin FROM features UNION ALL SELECT seqid, \"start\", \"end\", 'locus' FROM locus")
def _(spark, d):
    return table(spark, d, "features").select("seqid", "start", "end", F.lit("feature").alias("origin")).unionByName(table(spark, d, "locus").select("seqid", "start", "end", F.lit("locus").alias("origin")))


@C.add("uniq_lines", "SELECT file_id, line, min(line_no) AS line_no FROM raw_gff3 WHERE line IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "raw_gff3").where("line IS NOT NULL").groupBy("file_id", "line").agg(F.min("line_no").alias("line_no"))


@C.add("sort_children", _TREE + """ SELECT und.file_id, und.top, string_agg(und.s || '-' || und.e, ',' ORDER BY und.s, und.e, und.line_no) AS parts FROM und WHERE type = 'exon' GROUP BY ALL""")
def _(spark, d):
    x = O.under(_f(spark, d), is_a("exon")).groupBy("file_id", "top").agg(F.array_sort(F.collect_list(F.struct("start", "end", "line_no"))).alias("p"))
    return x.select("file_id", "top", F.array_join(F.transform("p", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",").alias("parts"))


@C.add("combined_length", _TREE + """ SELECT file_id, top, CAST(sum(e - s + 1) FILTER (type = 'exon') AS BIGINT) AS exon_length, CAST(sum(e - s + 1) FILTER (type = 'CDS') AS BIGINT) AS cds_length,
CAST(sum(e - s + 1) FILTER (type = 'five_prime_UTR') AS BIGINT) AS utr5_length FROM und WHERE type IN ('exon', 'CDS', 'five_prime_UTR') GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    n = lambda t: F.sum(F.when(F.col("type") == t, F.col("end") - F.col("start") + 1))
    x = O.under(_f(spark, d), F.col("type").isin("exon", "CDS", "five_prime_UTR"))
    return x.groupBy("file_id", "top").agg(n("exon").alias("exon_length"), n("CDS").alias("cds_length"), n("five_prime_UTR").alias("utr5_length"))


@C.add("cds_range", W("feats") + """ SELECT file_id, id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM feats WHERE type = 'CDS' AND id IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return V.features(spark, d).where("type = 'CDS' AND id IS NOT NULL").groupBy("file_id", "id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


# proteins

_TRIM = "nullif(trim({}, ' ' || chr(9)), '')"


def _proteins(spark, d):
    p = table(spark, d, "protein2ilocus")
    return p.withColumn("protein", F.btrim("ProteinID", F.lit(" \t"))).where("protein <> '' AND piLocusID IS NOT NULL")


@C.add("protein_ids", f"SELECT {_TRIM.format('ProteinID')} AS protein, min(row_id) AS first_row FROM protein2ilocus WHERE piLocusID IS NOT NULL AND {_TRIM.format('ProteinID')} IS NOT NULL GROUP BY 1")
def _(spark, d):
    return _proteins(spark, d).groupBy("protein").agg(F.min("row_id").alias("first_row"))


@C.add("protein_mapping", f"""WITH p AS (SELECT {_TRIM.format("ProteinID")} AS protein, arg_min(piLocusID, row_id) AS locus FROM protein2ilocus WHERE piLocusID IS NOT NULL AND {_TRIM.format("ProteinID")} IS NOT NULL GROUP BY 1)
SELECT protein, locus, l.seqid, l."start", l."end" FROM p JOIN (SELECT DISTINCT name, seqid, "start", "end" FROM locus WHERE name IS NOT NULL) l ON l.name = p.locus""")  # fmt: skip
def _(spark, d):
    p = _proteins(spark, d).groupBy("protein").agg(F.min_by("piLocusID", "row_id").alias("locus"))
    places = table(spark, d, "locus").where("name IS NOT NULL").select(F.col("name").alias("locus"), "seqid", "start", "end").distinct()
    return p.join(places, "locus").select("protein", "locus", "seqid", "start", "end")


@C.add("prot_reps", f"""SELECT DISTINCT {_TRIM.format("ProteinID")} AS protein, piLocusID AS locus FROM protein2ilocus WHERE piLocusID IN (SELECT piLocusID FROM ilocus_mrnas) AND {_TRIM.format("ProteinID")} IS NOT NULL""")
def _(spark, d):
    keep = table(spark, d, "ilocus_mrnas").select("piLocusID").where("piLocusID IS NOT NULL").distinct()
    return _proteins(spark, d).join(keep, "piLocusID", "left_semi").select("protein", F.col("piLocusID").alias("locus")).distinct()


@C.add("scan_prot_map", f"SELECT row_id, {_TRIM.format('ProteinID')} AS protein, piLocusID AS locus FROM protein2ilocus WHERE {_TRIM.format('ProteinID')} IS NOT NULL AND piLocusID IS NOT NULL")
def _(spark, d):
    return _proteins(spark, d).select("row_id", "protein", F.col("piLocusID").alias("locus"))


# sequences

_SEQ = "s AS (SELECT DISTINCT file_id, seqid, seq FROM sequences WHERE seqid IS NOT NULL AND seq IS NOT NULL)"
_N = "length(regexp_replace(upper(seq), '[^{}]', '', 'g'))"


def _seqs(spark, d):
    return table(spark, d, "sequences").where("seqid IS NOT NULL AND seq IS NOT NULL").select("file_id", "seqid", "seq").distinct()


@C.add("gc_content", f"WITH {_SEQ} SELECT file_id, seqid, seq, round(coalesce({_N.format('CGS')} / nullif({_N.format('ATWCGS')}, 0)::DOUBLE, 0), 6) AS gc FROM s")
def _(spark, d):
    return _seqs(spark, d).withColumn("gc", F.round(Q.gc_content(F.col("seq")), 6))


@C.add("gc_skew", f"WITH {_SEQ} SELECT file_id, seqid, seq, round(coalesce(({_N.format('G')} - {_N.format('C')}) / nullif({_N.format('CG')}, 0)::DOUBLE, 0), 6) AS skew FROM s")
def _(spark, d):
    return _seqs(spark, d).withColumn("skew", F.round(Q.gc_skew(F.col("seq")), 6))


@C.add("n_content", f"WITH {_SEQ} SELECT file_id, seqid, seq, round(coalesce({_N.format('NX')} / nullif(length(seq), 0)::DOUBLE, 0), 6) AS n FROM s")
def _(spark, d):
    return _seqs(spark, d).withColumn("n", F.round(Q.n_content(F.col("seq")), 6))


@C.add("subsequence", f"WITH {_SEQ} SELECT file_id, seqid, seq, CASE WHEN length(seq) >= 12 THEN seq[3:12] END AS part FROM s")
def _(spark, d):
    return _seqs(spark, d).withColumn("part", Q.subsequence(F.col("seq"), F.lit(3), F.lit(12)))


@C.add("reverse_complement", f"WITH {_SEQ} SELECT file_id, seqid, seq, reverse(translate(seq, 'ACGTUWSMKRYBDHVNacgtuwsmkrybdhvn', 'TGCAAWSKMYRVHDBNtgcaawskmyrvhdbn')) AS rc FROM s")
def _(spark, d):
    return _seqs(spark, d).withColumn("rc", Q.reverse_complement(F.col("seq")))


@C.add("multi_extract", f"""WITH {_SEQ} SELECT file_id, seqid, seq, CASE WHEN length(seq) >= 30 THEN seq[2:9] || seq[21:30] END AS forward,
CASE WHEN length(seq) >= 30 THEN reverse(translate(seq[21:30], 'ACGTUWSMKRYBDHVN', 'TGCAAWSKMYRVHDBN')) || reverse(translate(seq[2:9], 'ACGTUWSMKRYBDHVN', 'TGCAAWSKMYRVHDBN')) END AS backward FROM s WHERE seq = upper(seq)""")  # fmt: skip
def _(spark, d):
    part = lambda a, b: F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("end"))
    parts = F.array(part(21, 30), part(2, 9))
    x = _seqs(spark, d).where("seq = upper(seq)")
    return x.withColumn("forward", Q.spliced(F.col("seq"), parts, F.lit("+"))).withColumn("backward", Q.spliced(F.col("seq"), parts, F.lit("-")))


@C.add("atg_check", f"WITH {_SEQ} SELECT file_id, seqid, seq, starts_with(upper(seq), 'ATG') AS atg, starts_with(upper(seq), 'M') AS met FROM s")
def _(spark, d):
    up = F.upper("seq")
    return _seqs(spark, d).withColumn("atg", F.startswith(up, F.lit("ATG"))).withColumn("met", F.startswith(up, F.lit("M")))


@C.add("wrap_seq", f"WITH {_SEQ} SELECT file_id, seqid, rtrim(regexp_replace(seq, '(.{{70}})', '\\1' || chr(10), 'g'), chr(10)) AS wrapped FROM s")
def _(spark, d):
    return _seqs(spark, d).select("file_id", "seqid", Q.wrapped(F.col("seq"), 70).alias("wrapped"))


@C.add("sink_fasta", f"WITH {_SEQ} SELECT file_id, seqid, '>' || seqid || ' ' || file_id || chr(10) || rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS record FROM s WHERE file_id IS NOT NULL")
def _(spark, d):
    x = _seqs(spark, d).where("file_id IS NOT NULL")
    return x.select("file_id", "seqid", F.concat(F.lit(">"), "seqid", F.lit(" "), "file_id", F.lit("\n"), Q.wrapped(F.col("seq"), 80)).alias("record"))


@C.add("fasta_compare", """WITH a AS (SELECT DISTINCT file_id, seqid, seq FROM sequences WHERE withdrawn_at IS NULL), b AS (SELECT DISTINCT file_id, seqid, seq FROM sequences)
SELECT file_id, count(*) FILTER (side = 'b') AS only_b, count(*) FILTER (side = 'a') AS only_a FROM (SELECT *, 'b' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'a' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    s = table(spark, d, "sequences")
    b, a = s.select("file_id", "seqid", "seq").distinct(), s.where("withdrawn_at IS NULL").select("file_id", "seqid", "seq").distinct()
    x = b.exceptAll(a).withColumn("side", F.lit("b")).union(a.exceptAll(b).withColumn("side", F.lit("a")))
    return x.groupBy("file_id").agg(F.count_if(F.col("side") == "b").alias("only_b"), F.count_if(F.col("side") == "a").alias("only_a"))


@C.add("seq_join", """WITH p AS (SELECT DISTINCT trim(ProteinID, ' ' || chr(9)) AS seqid FROM protein2ilocus), s AS (SELECT seqid, max(length(seq)) AS len FROM sequences WHERE seqid IS NOT NULL GROUP BY 1)
SELECT p.seqid, s.len AS length, s.seqid IS NULL AS warned FROM p LEFT JOIN s ON s.seqid = p.seqid WHERE p.seqid <> ''""")  # fmt: skip
def _(spark, d):
    p = table(spark, d, "protein2ilocus").select(F.btrim("ProteinID", F.lit(" \t")).alias("seqid")).where("seqid <> ''").distinct()
    s = table(spark, d, "sequences").where("seqid IS NOT NULL").groupBy("seqid").agg(F.max(F.length("seq")).alias("length"), F.lit(True).alias("there"))
    return p.join(s, "seqid", "left").select("seqid", "length", F.col("there").isNull().alias("warned"))


@C.add("seq_region_fix", "SELECT seqid, CAST(1 AS BIGINT) AS \"start\", CAST(max(length(seq)) AS BIGINT) AS \"end\" FROM sequences WHERE seqid IS NOT NULL AND length(seq) > 0 GROUP BY 1")
def _(spark, d):
    return table(spark, d, "sequences").where("seqid IS NOT NULL AND length(seq) > 0").groupBy("seqid").agg(F.lit(1).cast("bigint").alias("start"), F.max(F.length("seq")).cast("bigint").alias("end"))


@C.add("sha1", f"WITH {_SEQ} SELECT file_id, seqid, sha1(seq) AS digest FROM s")
def _(spark, d):
    return _seqs(spark, d).select("file_id", "seqid", F.sha1("seq").alias("digest"))


@C.add("checksum_verify", f"WITH {_SEQ} SELECT seqid, count(DISTINCT sha1(seq)) = 1 AS same FROM s GROUP BY 1")
def _(spark, d):
    return _seqs(spark, d).groupBy("seqid").agg((F.countDistinct(F.sha1("seq")) == 1).alias("same"))


@C.add("string_compare", "SELECT DISTINCT seqid, seqid < 'QW' AS before FROM locus WHERE seqid IS NOT NULL")
def _(spark, d):
    return table(spark, d, "locus").where("seqid IS NOT NULL").select("seqid", (F.col("seqid") < "QW").alias("before")).distinct()


@C.add("half_split", "SELECT locus_id, CAST(ceil(left_overlap / 2.0) AS BIGINT) AS up, left_overlap // 2 AS down FROM locus WHERE left_overlap IS NOT NULL")
def _(spark, d):
    return table(spark, d, "locus").where("left_overlap IS NOT NULL").select("locus_id", F.ceil(F.col("left_overlap") / 2).alias("up"), F.floor(F.col("left_overlap") / 2).alias("down"))


@C.add("remainder", W("feats") + " SELECT file_id, line_no, CAST((e - s + 1 - phase) % 3 AS BIGINT) AS remainder FROM feats WHERE type = 'CDS' AND phase IS NOT NULL AND e - s + 1 >= phase")
def _(spark, d):
    x = V.features(spark, d).where("type = 'CDS' AND phase IS NOT NULL AND end - start + 1 >= phase")
    return x.select("file_id", "line_no", F.pmod(F.col("end") - F.col("start") + 1 - F.col("phase"), F.lit(3)).cast("bigint").alias("remainder"))


@C.add("format_comma", "SELECT DISTINCT seqid, \"end\", format('{:,}', \"end\") AS shown FROM regions WHERE \"end\" IS NOT NULL AND seqid IS NOT NULL")
def _(spark, d):
    return table(spark, d, "regions").where("end IS NOT NULL AND seqid IS NOT NULL").select("seqid", "end", F.format_number("end", 0).alias("shown")).distinct()


@C.add("printf_fmt", "SELECT locus_id, printf('%07d', n_children) AS a, printf('%.3f', effective_length / 8.0) AS b FROM locus WHERE n_children IS NOT NULL AND effective_length IS NOT NULL")
def _(spark, d):
    x = table(spark, d, "locus").where("n_children IS NOT NULL AND effective_length IS NOT NULL")
    return x.select("locus_id", F.format_string("%07d", "n_children").alias("a"), F.format_string("%.3f", F.col("effective_length") / F.lit(8.0)).alias("b"))


@C.add("glb2lcl", W("loci") + """, g AS (SELECT DISTINCT file_id, line_no, seqid, "start" AS s, "end" AS e FROM features WHERE type = 'gene' AND "start" <= "end" AND file_id IS NOT NULL AND seqid IS NOT NULL)
SELECT g.file_id, g.line_no, l.name AS seqid, g.s - (l.s - 1) AS "start", g.e - (l.s - 1) AS "end", l.seqid || '_' || l.s || '-' || l.e AS ilocus_pos
FROM g JOIN loci l ON l.file_id = g.file_id AND l.seqid = g.seqid AND l.s <= g.s AND l.e >= g.e WHERE l.name IS NOT NULL""")  # fmt: skip
def glb2lcl(spark, d):
    from strandline.operators import intervals

    g = V.features(spark, d).where("type = 'gene'").select("file_id", "line_no", "seqid", "start", "end").distinct()
    l = V.loci(spark, d).where("name IS NOT NULL AND file_id IS NOT NULL").select("file_id", "seqid", "start", "end", "name")  # noqa: E741
    x = intervals.overlap_join(g, l, ["file_id", "seqid"], prefix="l_").where("l_start <= start AND l_end >= end")
    off = F.col("l_start") - 1
    place = F.concat("seqid", F.lit("_"), "l_start", F.lit("-"), "l_end")
    return x.select("file_id", "line_no", F.col("l_name").alias("seqid"), (F.col("start") - off).alias("start"), (F.col("end") - off).alias("end"), place.alias("ilocus_pos"))


@C.add("lcl2glb", W("loci") + """, g AS (SELECT DISTINCT file_id, line_no, seqid, "start" AS s, "end" AS e FROM features WHERE type = 'gene' AND "start" <= "end" AND file_id IS NOT NULL AND seqid IS NOT NULL)
SELECT DISTINCT g.file_id, g.line_no, g.seqid, g.s AS "start", g.e AS "end" FROM g JOIN loci l ON l.file_id = g.file_id AND l.seqid = g.seqid AND l.s <= g.s AND l.e >= g.e WHERE l.name IS NOT NULL""")  # fmt: skip
def _(spark, d):
    x = glb2lcl(spark, d)
    off = F.regexp_extract("ilocus_pos", r"_(\d+)-\d+$", 1).cast("bigint") - 1
    return x.select("file_id", "line_no", F.regexp_extract("ilocus_pos", r"^(.+)_\d+-\d+$", 1).alias("seqid"), (F.col("start") + off).alias("start"), (F.col("end") + off).alias("end")).distinct()
