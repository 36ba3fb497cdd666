"""Queries of the data problems 1 to 6 over the domain tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import hierarchy, hotkeys, orphans, packed, periods
from strandline.session import ship, table
from strandline.sources import gff3_rows

XREF = {"attributes": ("dbxref", ["Dbxref", "db_xref"])}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return hotkeys.top_k_per_key(table(spark, d, "locus"), "seqid", "effective_length", "locus_id", 3)


def p1_rollup(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.rollup_per_key(
        table(spark, d, "locus"),
        "seqid",
        n_rows=F.count(F.lit(1)),
        n_measured=F.count("effective_length"),
        sum_effective=F.sum("effective_length"),
        max_effective=F.max("effective_length"),
        first_start=F.min("start"),
        last_end=F.max("end"),
        n_gene_loci=F.count_if(F.col("n_children") > 0),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return hierarchy.depths(table(spark, d, "features"), "file_id", "id", "parent", least=4)


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return hierarchy.nested_sets(table(spark, d, "features"), "file_id", "id", "parent")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return hierarchy.descendants(table(spark, d, "features"), "file_id", "id", "parent")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return gff3_rows.rejected(table(spark, d, "raw_gff3"), "line_id")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return gff3_rows.loaded(table(spark, d, "raw_gff3"), ["line_id", "file_id", "line_no"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return packed.split_packed(table(spark, d, "features"), ["row_id"], {"parent": "parent"}, XREF, least=2).select("row_id", "field", "pos", "value")


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every packed field, single and bracketed ones too, with its flag."""
    ship(spark)
    return packed.split_packed(table(spark, d, "features"), ["row_id"], {"parent": "parent"}, XREF, brackets=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return periods.periods_and_gaps(table(spark, d, "locus"), ["file_id", "seqid"], "locus_id", "start", "end")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    f, prot, mrna, seqs = (table(spark, d, n) for n in ("features", "protein2ilocus", "ilocus_mrnas", "sequences"))
    one = lambda c: F.array(F.btrim(F.col(c), F.lit(" \t")))
    refs = [
        orphans.references(f.where("parent is not null"), "features", 1, F.col("row_id"), packed.values_of("parent"), F.col("loaded_at"), F.col("file_id")),
        orphans.references(prot, "protein2ilocus", 2, F.col("row_id"), one("ProteinID"), F.col("loaded_at")),
        orphans.references(mrna, "ilocus_mrnas", 3, F.col("row_id"), one("MrnaID"), F.col("loaded_at")),
    ]
    tgts = [
        orphans.targets(f, 1, F.col("id"), F.col("loaded_at"), F.col("withdrawn_at"), F.col("file_id")),
        orphans.targets(seqs, 2, F.col("seqid"), F.col("loaded_at"), F.col("withdrawn_at")),
        orphans.targets(f.where("type = 'mRNA'"), 3, F.col("accession"), F.col("loaded_at"), F.col("withdrawn_at")),
    ]
    return orphans.orphans(refs, tgts)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_rollup, p2_found, p2_paths, p2_descendants, p3_found, p3_loaded, p4_found, p4_values, p5_found, p6_found, p6_report)}

_VALUES = r"""list_filter(list_transform(regexp_extract_all({c}, '"[^"]*"|''[^'']*''|[^ \t,;|/]+'),
  lambda t: CASE WHEN length(t) >= 2 AND ((starts_with(t, '"') AND ends_with(t, '"')) OR (starts_with(t, '''') AND ends_with(t, ''''))) THEN t[2:-2] ELSE t END), lambda t: t <> '')"""

_P6 = rf"""
WITH refs AS (
  SELECT DISTINCT 'features' AS tbl, row_id, file_id AS scope, unnest({_VALUES.format(c="parent")}) AS ref, loaded_at AS at FROM features WHERE parent IS NOT NULL
  UNION ALL SELECT 'protein2ilocus', row_id, '', trim(ProteinID, ' ' || chr(9)), loaded_at FROM protein2ilocus
  UNION ALL SELECT 'ilocus_mrnas', row_id, '', trim(MrnaID, ' ' || chr(9)), loaded_at FROM ilocus_mrnas
), targets AS (
  SELECT 'features' AS tbl, file_id AS scope, id AS ref, loaded_at, withdrawn_at FROM features WHERE id IS NOT NULL
  UNION ALL SELECT 'protein2ilocus', '', seqid, loaded_at, withdrawn_at FROM sequences WHERE seqid IS NOT NULL
  UNION ALL SELECT 'ilocus_mrnas', '', accession, loaded_at, withdrawn_at FROM features WHERE accession IS NOT NULL AND type = 'mRNA'
), valid AS (
  SELECT tbl, scope, ref, min(loaded_at) AS f, max(coalesce(withdrawn_at, TIMESTAMP '9999-12-31')) AS u FROM targets GROUP BY ALL
), judged AS (
  SELECT r.tbl, r.row_id, r.ref, strftime(r.at, '%Y-%m') AS period,
    CASE WHEN v.f IS NULL THEN 'missing' WHEN v.f > r.at THEN 'late' WHEN v.u <= r.at THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN valid v ON r.tbl = v.tbl AND coalesce(r.scope, '') = coalesce(v.scope, '') AND r.ref = v.ref
  WHERE r.ref IS NOT NULL AND r.ref <> ''
), found AS (SELECT * FROM judged WHERE reason IS NOT NULL)
"""

_P2 = rf"""
WITH RECURSIVE n AS (SELECT DISTINCT coalesce(file_id, '') AS f, id FROM features WHERE id IS NOT NULL),
v AS (SELECT DISTINCT coalesce(file_id, '') AS f, id AS c, unnest({_VALUES.format(c="parent")}) AS p FROM features WHERE id IS NOT NULL AND parent IS NOT NULL),
l AS (SELECT v.f, v.c, v.p FROM v SEMI JOIN n ON v.f = n.f AND v.p = n.id),
r AS (SELECT f, c, p FROM l UNION SELECT r.f, r.c, l.p FROM r JOIN l ON r.f = l.f AND r.p = l.c),
cyc AS (SELECT DISTINCT f, c AS id FROM r WHERE c = p),
bad AS (SELECT f, id FROM cyc UNION SELECT r.f, r.c FROM r SEMI JOIN cyc ON r.f = cyc.f AND r.p = cyc.id),
"""

_P3 = r"""
WITH a AS (SELECT line_id, regexp_replace(line, '\r$', '') AS l FROM raw_gff3 WHERE line IS NOT NULL),
b AS (SELECT line_id, string_split(l, chr(9)) AS c FROM a WHERE trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '' AND NOT starts_with(l, '#')),
d AS (SELECT *, CASE WHEN len(c) = 9 AND trim(c[9]) <> '.' THEN array_to_string(list_transform(string_split(c[9], '"'), lambda x, i: CASE WHEN i % 2 = 0 THEN translate(x, ';=', chr(1) || chr(2)) ELSE x END), '"') ELSE '' END AS m FROM b),
e AS (SELECT *, list_filter(list_transform(string_split(m, ';'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM d),
f AS (SELECT *, list_transform(ps, lambda p: CASE WHEN contains(p, '=') THEN trim(split_part(p, '=', 1)) END) AS ks, list_transform(ps, lambda p: CASE WHEN contains(p, '=') THEN p[position('=' IN p) + 1:] END) AS vs FROM e)
SELECT line_id, reason FROM (SELECT line_id, CASE WHEN len(c) <> 9 THEN 'columns'
  WHEN contains(array_to_string(c[1:8], ' '), '"') OR len(list_filter(range(1, len(ps) + 1), lambda i: contains(ps[i], '"') AND (ks[i] IS NULL OR contains(ks[i], '"') OR NOT regexp_matches(vs[i], '^"([^"]|"")*"$')))) > 0 THEN 'quoting'
  WHEN len(list_filter(c, lambda x: trim(x) = '')) > 0 OR NOT regexp_matches(c[4], '^[0-9]+$') OR NOT regexp_matches(c[5], '^[0-9]+$') OR TRY_CAST(c[4] AS HUGEINT) < 1 OR TRY_CAST(c[4] AS HUGEINT) > TRY_CAST(c[5] AS HUGEINT)
    OR NOT regexp_matches(c[6], '^(\.|[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)$') OR c[7] NOT IN ('+', '-', '.', '?') OR c[8] NOT IN ('0', '1', '2', '.') OR (c[3] = 'CDS' AND c[8] = '.')
    OR regexp_matches(regexp_replace(c[9], '%[0-9A-Fa-f]{2}', '', 'g'), '%') OR (trim(c[9]) <> '.' AND len(ps) = 0)
    OR len(list_filter(range(1, len(ps) + 1), lambda i: ks[i] IS NULL OR ks[i] = '' OR trim(vs[i]) IN ('', '""') OR (ks[i] = 'accession' AND NOT regexp_matches(trim(vs[i], '"'), '^[A-Z]{2}_[0-9]+\.[0-9]+$')))) > 0 THEN 'value' END AS reason FROM f)
WHERE reason IS NOT NULL"""

_P4 = rf"""
WITH v AS (
  SELECT row_id, 'parent' AS field, {_VALUES.format(c="parent")} AS vs FROM features WHERE parent IS NOT NULL
  UNION ALL SELECT row_id, 'dbxref', flatten(list_transform(list_filter(regexp_extract_all(attributes, '(?:"[^"]*"|''[^'']*''|[^;"''])+'), lambda x: regexp_matches(lower(x), '^\s*(dbxref|db_xref)\s*[= ]')),
    lambda x: {_VALUES.format(c="regexp_replace(x, '^[^A-Za-z]*[A-Za-z_]+[ ]*[= ][ ]*', '')")})) FROM features WHERE attributes ILIKE '%xref%')
SELECT row_id, field, CAST(pos AS INTEGER) AS pos, vs[pos] AS value FROM (SELECT row_id, field, vs, unnest(range(1, len(vs) + 1)) AS pos FROM v WHERE len(vs) >= 2)"""

_TOKENS = r"""regexp_extract_all({c}, '"[^"]*"|''[^'']*''|\[[^\]]*\]|[^ \t,;|/]+')"""
_FLAGGED = """list_filter(list_transform({t}, lambda t: CASE
  WHEN length(t) >= 2 AND ((starts_with(t, '"') AND ends_with(t, '"')) OR (starts_with(t, '\'\'') AND ends_with(t, '\'\'')) OR (starts_with(t, '[') AND ends_with(t, ']'))) THEN {{'v': t[2:-2], 'f': NULL::VARCHAR}}
  WHEN t[1] IN ('"', '\'\'', '[') THEN {{'v': t, 'f': 'unclosed'}} ELSE {{'v': t, 'f': NULL}} END), lambda x: x.v <> '')"""
_P4_VALUES = rf"""
WITH v AS (
  SELECT row_id, 'parent' AS field, {_FLAGGED.format(t=_TOKENS.format(c="parent"))} AS vs FROM features WHERE parent IS NOT NULL
  UNION ALL SELECT row_id, 'dbxref', flatten(list_transform(list_filter(regexp_extract_all(attributes, '(?:"[^"]*"|''[^'']*''|[^;"''])+'), lambda x: regexp_matches(lower(x), '^\s*(dbxref|db_xref)\s*[= ]')),
    lambda x: {_FLAGGED.format(t=_TOKENS.format(c="regexp_replace(x, '^[^A-Za-z]*[A-Za-z_]+[ ]*[= ][ ]*', '')"))})) FROM features WHERE attributes ILIKE '%xref%')
SELECT row_id, field, CAST(pos AS INTEGER) AS pos, vs[pos].v AS value, vs[pos].f AS flag FROM (SELECT row_id, field, vs, unnest(range(1, len(vs) + 1)) AS pos FROM v)"""

_UNQUOTED = """CASE WHEN {v} LIKE '"%"' AND length({v}) >= 2 THEN replace({v}[2:-2], '""', '"') ELSE {v} END"""
_ATTRIBUTE = "translate(" + _UNQUOTED.format(v="trim(vs[list_position(ks, '{k}')])") + ", chr(1) || chr(2), ';=') AS {n}"
_P3_LOADED = _P3[: _P3.index("SELECT line_id, reason FROM (")] + """SELECT f.line_id, file_id, line_no, c[1] AS seqid, nullif(c[2], '.') AS source, c[3] AS type, TRY_CAST(c[4] AS BIGINT) AS "start", TRY_CAST(c[5] AS BIGINT) AS "end",
  TRY_CAST(nullif(c[6], '.') AS DOUBLE) AS score, c[7] AS strand, TRY_CAST(nullif(c[8], '.') AS TINYINT) AS phase, nullif(c[9], '.') AS attributes, """ + ", ".join(_ATTRIBUTE.replace("{k}", k).replace("{n}", k.lower()) for k in ("ID", "Parent", "accession")) + """
FROM f JOIN (SELECT line_id, file_id, line_no FROM raw_gff3) k ON k.line_id = f.line_id ANTI JOIN (""" + _P3.strip() + """) bad ON bad.line_id = f.line_id"""

ORACLE = {
    "p3_found": _P3,
    "p3_loaded": _P3_LOADED,
    "p4_values": _P4_VALUES,
    "p4_found": _P4,
    "p2_found": _P2
    + """
ok AS (SELECT l.* FROM l ANTI JOIN bad ON l.f = bad.f AND l.c = bad.id),
d AS (SELECT f, c, p, 1 AS k FROM ok UNION SELECT d.f, d.c, ok.p, d.k + 1 FROM d JOIN ok ON d.f = ok.f AND d.p = ok.c)
SELECT nullif(f, '') AS file_id, c AS feature_id, p AS root_id, CAST(max(k) AS INTEGER) AS depth
FROM d ANTI JOIN l ON d.f = l.f AND d.p = l.c GROUP BY ALL HAVING max(k) >= 4
UNION ALL
SELECT nullif(a.f, ''), a.c, min(a.p), -1 FROM r a JOIN r b ON a.f = b.f AND a.c = b.p AND a.p = b.c
WHERE (a.f, a.c) IN (SELECT (f, id) FROM cyc) GROUP BY a.f, a.c""",
    "p2_descendants": _P2
    + """
ok AS (SELECT l.* FROM l ANTI JOIN bad ON l.f = bad.f AND l.c = bad.id),
d AS (SELECT f, c, p, 1 AS k FROM ok UNION SELECT d.f, d.c, ok.p, d.k + 1 FROM d JOIN ok ON d.f = ok.f AND d.p = ok.c)
SELECT nullif(f, '') AS file_id, p AS feature_id, c AS descendant_id, CAST(min(k) AS INTEGER) AS distance FROM d GROUP BY ALL""",

    "p1_found": """
SELECT seqid, locus_id FROM (
  SELECT seqid, locus_id, row_number() OVER (PARTITION BY seqid ORDER BY effective_length DESC, locus_id) AS rn
  FROM (SELECT DISTINCT seqid, locus_id, effective_length FROM locus WHERE seqid IS NOT NULL AND effective_length IS NOT NULL))
WHERE rn <= 3""",
    "p1_rollup": """
SELECT seqid, count(*) AS n_rows, count(effective_length) AS n_measured, CAST(sum(effective_length) AS BIGINT) AS sum_effective,
  max(effective_length) AS max_effective, min("start") AS first_start, max("end") AS last_end, count(*) FILTER (n_children > 0) AS n_gene_loci
FROM locus WHERE seqid IS NOT NULL GROUP BY seqid""",
    "p5_found": """
WITH l AS (SELECT DISTINCT file_id, seqid, locus_id, "start" AS s, "end" AS e FROM locus WHERE seqid IS NOT NULL AND "start" <= "end"),
m AS (SELECT *, max(e) OVER (PARTITION BY file_id, seqid ORDER BY s, e, locus_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM l),
n AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, seqid ORDER BY s, e, locus_id) AS isle FROM m),
p AS (SELECT file_id, seqid, isle, min(s) AS s, max(e) AS e, count(*) AS k FROM n GROUP BY ALL)
SELECT file_id, seqid, 'period' AS kind, s AS "start", e AS "end" FROM p WHERE k >= 2
UNION ALL
SELECT file_id, seqid, 'gap', pe + 1, s - 1 FROM (SELECT *, lag(e) OVER (PARTITION BY file_id, seqid ORDER BY s) AS pe FROM p) WHERE s - 1 >= pe + 1""",
    "p6_found": _P6 + "SELECT tbl, row_id, ref, period, reason FROM found",
    "p6_report": _P6 + "SELECT tbl, period, reason, count(*) AS n_refs, count(DISTINCT ref) AS n_values FROM found GROUP BY ALL",
}
