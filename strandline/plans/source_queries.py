"""Queries on scans, sinks, adapters, reports and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import sequence as Q
from strandline.operators import clusters as P
from strandline.operators import compare as K
from strandline.plans import model_queries as M
from strandline.plans import views as V
from strandline.plans.catalog import Catalog
from strandline.plans.feature_queries import _TRIM
from strandline.plans.problems import _VALUES
from strandline.session import new_path, table
from strandline.sources import adapters, readers, reports
from strandline.streaming import sessions as T

C = Catalog()
W = V.with_views


def _lines(spark, d):
    return table(spark, d, "raw_gff3").where("line IS NOT NULL AND file_id IS NOT NULL").select(F.col("file_id").alias("file"), "line_no", "line")


_L = "l AS (SELECT file_id AS file, line_no, line FROM raw_gff3 WHERE line IS NOT NULL AND file_id IS NOT NULL)"
_T = "split_part(line, chr(9), 3)"


@C.add("scan_regions", r"""SELECT line_id, regexp_extract(line, '^##sequence-region\s+(\S+)\s+(\d+)\s+(\d+)', 1) AS seqid, CAST(regexp_extract(line, '^##sequence-region\s+(\S+)\s+(\d+)\s+(\d+)', 2) AS BIGINT) AS "start",
CAST(regexp_extract(line, '^##sequence-region\s+(\S+)\s+(\d+)\s+(\d+)', 3) AS BIGINT) AS "end" FROM raw_gff3 WHERE regexp_matches(line, '^##sequence-region\s+(\S+)\s+(\d+)\s+(\d+)')""")  # fmt: skip
def _(spark, d):
    return readers.regions(table(spark, d, "raw_gff3"), ["line_id"])


@C.add("scan_id_list", r"SELECT file, regexp_extract(trim(line, ' ' || chr(9) || chr(13)), '^(\S+)', 1) AS id FROM (WITH " + _L + r" SELECT * FROM l) WHERE regexp_extract(trim(line, ' ' || chr(9) || chr(13)), '^(\S+)', 1) <> ''")
def _(spark, d):
    x = _lines(spark, d).withColumn("line", F.btrim("line", F.lit(" \t\r")))
    return x.select("file", F.get(F.split("line", r"\s+"), F.lit(0)).alias("id")).where("id <> ''")


@C.add("scan_fasta", """SELECT DISTINCT coalesce(file_id, '') AS file, seqid, upper(seq) AS seq FROM sequences WHERE seqid IS NOT NULL AND length(seq) > 0 AND seq NOT LIKE '%>%'""")
def _(spark, d):
    """Sequences written as wrapped FASTA lines and read again."""
    s = table(spark, d, "sequences").where("seqid IS NOT NULL AND length(seq) > 0 AND NOT contains(seq, '>')").select(F.coalesce("file_id", F.lit("")).alias("file_id"), "seqid", F.upper("seq").alias("seq")).distinct()
    text = F.concat(F.lit(">"), "seqid", F.lit(" written\n"), Q.wrapped(F.col("seq"), 60))
    s = s.withColumn("_k", F.xxhash64("file_id", "seqid", "seq"))
    lines = s.select(F.concat("file_id", F.lit("/"), "_k").alias("file"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return readers.fasta(lines).select(F.regexp_replace("file", "/[^/]*$", "").alias("file"), "seqid", "seq")


_CLS = f"""SELECT 'f' AS file, CAST(row_id // 8 AS VARCHAR) AS cluster_id, CAST(row_id % 8 AS INTEGER) AS idx, CAST(100 + row_id % 50 AS INTEGER) AS length, split_part(file_id, '.', 1) AS species, {_TRIM.format("ProteinID")} AS accession
FROM protein2ilocus WHERE {_TRIM.format("ProteinID")} IS NOT NULL AND file_id IS NOT NULL AND ProteinID NOT LIKE '%|%' AND trim(ProteinID) NOT LIKE '% %'"""


def _cluster_lines(spark, d):
    p = table(spark, d, "protein2ilocus").withColumn("p", F.btrim("ProteinID", F.lit(" \t"))).where("p <> '' AND file_id IS NOT NULL AND NOT contains(ProteinID, '|') AND NOT contains(btrim(ProteinID), ' ')")
    cid = F.floor(F.col("row_id") / 8)
    body = p.select(F.lit("f").alias("file"), (F.col("row_id") * 2 + 1).alias("line_no"), F.concat(F.pmod("row_id", F.lit(8)).cast("string"), F.lit("\t"), (F.pmod("row_id", F.lit(50)) + 100).cast("string"), F.lit("aa, >gnl|"), F.substring_index("file_id", ".", 1), F.lit("|"), "p", F.lit("... *")).alias("line"))
    head = p.select(cid.alias("c")).distinct().select(F.lit("f").alias("file"), (F.col("c") * 16).alias("line_no"), F.concat(F.lit(">Cluster "), "c").alias("line"))
    return body.unionByName(head)


@C.add("scan_cdhit", _CLS)
def scan_cdhit(spark, d):
    return readers.clusters(_cluster_lines(spark, d)).select("file", "cluster_id", "idx", "length", "species", "accession")


_MAP = f"""(SELECT {_TRIM.format("ProteinID")} AS protein, arg_min(piLocusID, row_id) AS locus FROM protein2ilocus WHERE piLocusID IS NOT NULL AND {_TRIM.format("ProteinID")} IS NOT NULL GROUP BY 1)"""


def _mapping(spark, d):
    p = table(spark, d, "protein2ilocus").withColumn("protein", F.btrim("ProteinID", F.lit(" \t"))).where("protein <> '' AND piLocusID IS NOT NULL")
    return p.groupBy("protein").agg(F.min_by("piLocusID", "row_id").alias("locus"))


@C.add("cluster_join", f"SELECT c.cluster_id, c.accession, m.locus FROM ({_CLS}) c JOIN {_MAP} m ON m.protein = c.accession")
def _(spark, d):
    return scan_cdhit(spark, d).join(_mapping(spark, d).withColumnRenamed("protein", "accession"), "accession").select("cluster_id", "accession", "locus")


@C.add("hiloci", f"""SELECT c.cluster_id, count(DISTINCT m.locus) AS n_loci, count(DISTINCT c.species) AS n_species, string_agg(DISTINCT m.locus, ',' ORDER BY m.locus) AS loci, string_agg(DISTINCT c.species, ',' ORDER BY c.species) AS species
FROM ({_CLS}) c JOIN {_MAP} m ON m.protein = c.accession GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return P.cluster_loci(scan_cdhit(spark, d), _mapping(spark, d))


@C.add("protein_cluster")
def _(spark, d):
    return P.by_sequence(table(spark, d, "sequences").select("seqid", "seq"))


@C.add("scan_tsv", W("loci") + " SELECT locus_id, seqid, s AS \"start\", e AS \"end\", ilocus_type FROM loci WHERE ilocus_type IS NOT NULL")
def _(spark, d):
    """Loci written as a tab-separated file, and scanned again under a schema."""
    path = new_path(spark, "tsv")
    readers.write_tsv(V.loci(spark, d).where("ilocus_type IS NOT NULL").select("locus_id", "seqid", "start", "end", "ilocus_type"), path)
    return readers.read_tsv(spark, path, "locus_id bigint, seqid string, start bigint, end bigint, ilocus_type string")


@C.add("sink_tsv", W("loci") + """ SELECT locus_id, concat_ws(chr(9), seqid, s, e, coalesce(ilocus_type, 'NA'), len) AS line FROM loci""")
def _(spark, d):
    """Loci written as a tab-separated file; its lines, read as they stand."""
    path = new_path(spark, "tsv")
    readers.write_tsv(V.loci(spark, d).select("locus_id", "seqid", "start", "end", F.coalesce("ilocus_type", F.lit("NA")).alias("ilocus_type"), "length"), path)
    text = spark.read.text(path).where("NOT startswith(value, 'locus_id\t')")
    tab = F.instr("value", "\t")
    return text.select(F.substring("value", F.lit(1), tab - 1).cast("bigint").alias("locus_id"), F.substring("value", tab + 1, F.length("value")).alias("line"))


@C.add("sink_gff3")
def _(spark, d):
    return readers.gff3_text(V.features(spark, d))


@C.add("sink_clique_gff3", W("exons") + """ SELECT gene_id, seqid || chr(9) || 'strandline' || chr(9) || CASE code WHEN 'C' THEN 'CDS' WHEN 'F' THEN 'five_prime_UTR' ELSE 'three_prime_UTR' END || chr(9) || s || chr(9) || e || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'Parent=m' || gene_id AS line FROM exons""")
def _(spark, d):
    kind = F.when(F.col("code") == "C", "CDS").when(F.col("code") == "F", "five_prime_UTR").otherwise("three_prime_UTR")
    line = F.concat_ws("\t", "seqid", F.lit("strandline"), kind, "start", "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit("Parent=m"), "gene_id"))
    return V.exons(spark, d).select("gene_id", line.alias("line"))


# adapters


@C.add("adapter_refseq", f"WITH {_L} SELECT * FROM l WHERE {_T} NOT IN ('region', 'match', 'cDNA_match') AND NOT starts_with(line, '##species') AND NOT regexp_matches(line, 'ab\"c|lost')")
def _(spark, d):
    return adapters.normalised(_lines(spark, d), "refseq", exclude=['ab"c', "lost"])


@C.add("adapter_genbank", f"WITH {_L} SELECT * FROM l WHERE {_T} NOT IN ('region', 'match', 'cDNA_match') AND NOT starts_with(line, '##species')")
def _(spark, d):
    return adapters.normalised(_lines(spark, d), "genbank")


_HYM = f"""WITH {_L}, u AS (SELECT file, rtrim(line, chr(13)) AS line, min(line_no) AS line_no FROM l WHERE {_T} <> 'region' GROUP BY file, l.line)
SELECT file, line_no, CASE WHEN regexp_extract(line, '(?:^|\\t|;)\\s*ID=([^;\\n]+)', 1) <> '' AND NOT regexp_matches(line, '(?:\\t|;)\\s*Name=') THEN regexp_replace(line, ';$', '') || ';Name=' || trim(regexp_extract(line, '(?:^|\\t|;)\\s*ID=([^;\\n]+)', 1)) ELSE line END AS line FROM u"""
for _s in ("hymbase", "beebase"):

    @C.add(f"adapter_{_s}", _HYM)
    def _(spark, d, source=_s):
        return adapters.normalised(_lines(spark, d), source)


@C.add("adapter_crg", f"""WITH {_L}, x AS (SELECT file, line_no, replace(line, 'QC_', 'scaffold_') AS line FROM l)
SELECT file, line_no, regexp_replace(regexp_replace(line, '^([^\\t]*\\t[^\\t]*\\t)transcript\\t', '\\1mRNA' || chr(9)), '^(.*?)scaffold_?', '\\1TestScf_') AS line FROM x""")  # fmt: skip
def _(spark, d):
    return adapters.normalised(_lines(spark, d).withColumn("line", F.replace("line", F.lit("QC_"), F.lit("scaffold_"))), "crg", "Test")


@C.add("adapter_tair", f"WITH {_L} SELECT file, line_no, regexp_replace(replace(line, 'Dbxref', 'Index'), '^(.*?)Index=', '\\1index=') AS line FROM l")
def _(spark, d):
    return adapters.normalised(_lines(spark, d).withColumn("line", F.replace("line", F.lit("Dbxref"), F.lit("Index"))), "tair")


_GLEAN = """g AS (SELECT 'f' AS file, gene_id * 100 + rn AS line_no, concat_ws(chr(9), seqid, 'glean', CASE WHEN rn = 1 THEN 'mRNA' ELSE 'CDS' END, s, e, '.', strand, '.', 'GenePrediction G' || gene_id) AS line, gene_id, rn FROM exons)"""


@C.add("adapter_am10", W("exons") + "," + _GLEAN + " SELECT file, line_no, substr(line, 1, length(line) - length('GenePrediction G' || gene_id)) || CASE WHEN rn = 1 THEN 'ID=G' || gene_id || ';Name=G' || gene_id ELSE 'ID=G' || gene_id || '-CDS;Parent=G' || gene_id || ';Name=G' || gene_id END AS line FROM g")
def glean(spark, d):
    x = V.exons(spark, d)
    line = F.concat_ws("\t", "seqid", F.lit("glean"), F.when(F.col("rn") == 1, "mRNA").otherwise("CDS"), "start", "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit("GenePrediction G"), "gene_id"))
    return adapters.normalised(x.select(F.lit("f").alias("file"), (F.col("gene_id") * 100 + F.col("rn")).alias("line_no"), line.alias("line")), "am10")


@C.add("glean_to_gff3", C.oracle["adapter_am10"])
def _(spark, d):
    return glean(spark, d)


@C.add("adapter_pdom", f"WITH {_L} SELECT * FROM l")
def _(spark, d):
    return adapters.normalised(_lines(spark, d), "pdom")


@C.add("adapter_local", f"WITH {_L} SELECT * FROM l WHERE trim(line, ' ') <> ''")
def _(spark, d):
    return adapters.normalised(_lines(spark, d), "local")


@C.add("fasta_headers", "SELECT DISTINCT seqid, '>' || seqid || ' gnl|' || file_id || '|' || seqid || ' p' AS line FROM sequences WHERE seqid IS NOT NULL AND file_id IS NOT NULL AND seqid NOT LIKE '% %'")
def _(spark, d):
    s = table(spark, d, "sequences").where("seqid IS NOT NULL AND file_id IS NOT NULL AND NOT contains(seqid, ' ')").select("seqid", F.concat(F.lit(">gnl|"), "file_id", F.lit("|"), "seqid", F.lit(" p")).alias("line")).distinct()
    return adapters.headers(s)


def _attr_sql(key: str) -> str:
    return f"nullif(regexp_extract(attributes, '(?:^|;)\\s*{key}=([^;\\n]+)', 1), '')"


_PROT = {
    "refseq": ("CDS", _attr_sql("protein_id")),
    "genbank": ("CDS", _attr_sql("protein_id")),
    "crg": ("CDS", r"nullif(regexp_extract(attributes, '(?:^|;)\s*Target=(\S+)', 1), '')"),
    "hymbase": ("mRNA", f"replace({_attr_sql('Name')}, '-RA', '-PA')"),
    "beebase": ("mRNA", f"replace({_attr_sql('Name')}, '-RA', '-PA')"),
    "local": ("mRNA", f"coalesce({_attr_sql('protein_id')}, {_attr_sql('Name')})"),
    "tair": ("mRNA", _attr_sql("Name")),
    "am10": ("mRNA", _attr_sql("Name")),
    "pdom": ("mRNA", _attr_sql("Name")),
}
#: What a source's features would look like, made from the test data: crg names a protein by Target.
_AS_SQL = {"crg": "replace(attributes, 'protein_id=', 'Target=')", "hymbase": "replace(attributes, '.1;', '-RA;')"}


def _feats_of(spark, d, source):
    f = V.features(spark, d)
    if source == "crg":
        return f.withColumn("attributes", F.replace("attributes", F.lit("protein_id="), F.lit("Target=")))
    if source == "hymbase":
        return f.withColumn("attributes", F.replace("attributes", F.lit(".1;"), F.lit("-RA;")))
    return f


for _s, (_t, _sql) in _PROT.items():
    _of = W("feats") + f", fs AS (SELECT * REPLACE ({_AS_SQL.get(_s, 'attributes')} AS attributes) FROM feats)"

    @C.add(f"protein_ids_{_s}", _of + f" SELECT file_id, {_sql} AS protein, min(line_no) AS first_line FROM fs WHERE type = '{_t}' AND {_sql} IS NOT NULL GROUP BY ALL")
    def _(spark, d, source=_s):
        return adapters.protein_ids(_feats_of(spark, d, source), source)

    _up = f"{_VALUES.format(c='parent')}[1]"
    _skip = " AND NOT contains(attributes, 'exception=rearrangement required for product')" if _s in ("refseq", "genbank") else ""
    _step = "JOIN m ON m.file_id = p.file_id AND m.id = p.up" if _t == "CDS" else ""

    @C.add(f"protein_mapping_{_s}", _of + f""",
p AS (SELECT file_id, {_sql} AS protein, arg_min({_up}, (line_no, id)) FILTER (true) AS up FROM fs WHERE type = '{_t}' AND {_sql} IS NOT NULL{_skip} GROUP BY ALL),
m AS (SELECT file_id, id, arg_min({_up}, (line_no, id)) AS gene FROM fs WHERE type = 'mRNA' AND id IS NOT NULL GROUP BY ALL),
g AS (SELECT file_id, id AS gene, min((seqid, s, e)) AS at FROM fs WHERE type = 'gene' AND id IS NOT NULL GROUP BY ALL),
gl AS (SELECT DISTINCT file_id, seqid, "start" AS s, "end" AS e, name FROM locus WHERE name IS NOT NULL AND seqid IS NOT NULL AND "start" <= "end" AND ilocus_type IN ('siLocus', 'ciLocus', 'niLocus')),
gg AS (SELECT g.file_id, g.gene, arg_min(l.name, (l.e - l.s, l.s, l.name)) AS locus FROM g JOIN gl l ON l.file_id = g.file_id AND l.seqid = g.at[1] AND l.s <= g.at[2] AND l.e >= g.at[3] GROUP BY ALL)
SELECT p.file_id, p.protein, gg.locus FROM p {_step} JOIN gg ON gg.file_id = p.file_id AND gg.gene = {'m.gene' if _t == 'CDS' else 'p.up'}""")  # fmt: skip
    def _(spark, d, source=_s):
        f = _feats_of(spark, d, source)
        gene_loci = V.loci(spark, d).where("name IS NOT NULL AND ilocus_type IN ('siLocus', 'ciLocus', 'niLocus')").select("file_id", "seqid", "start", "end", "name").distinct()
        return adapters.protein_map(f, adapters.contained_loci(f, gene_loci), source)


# reports


def _reported(spark, d):
    x = M._classes(spark, d).join(V.genes(spark, d).select("gene_id", "seqid", "start", "end"), "gene_id")
    st = K.scaled(*[F.col(f"cds_{k}") for k in ("tp", "fn", "fp", "tn")])
    return x.select("*", *[v.alias(k) for k, v in st.items()])


@C.add("report_text")
def _(spark, d):
    return reports.text(_reported(spark, d))


@C.add("report_summary")
def _(spark, d):
    return reports.summary_lines(M.C.queries["class_summary"](spark, d).select("class", "n"))


@C.add("report_html")
def _(spark, d):
    return reports.html(_reported(spark, d)).select("path", "page")


@C.add("report_index", W("exons", "pred") + M._CMP + " SELECT g.seqid, count(*) AS n, count(*) FILTER (class = 'perfect') AS n_perfect FROM cls JOIN genes g ON g.gene_id = cls.gene_id GROUP BY 1")
def _(spark, d):
    return reports.html_index(_reported(spark, d))


@C.add("report_png", W("genes") + " SELECT gene_id, CAST(least(greatest((e - s + 1) * 0.05::DOUBLE, 650), 10000) AS INTEGER) AS width FROM genes")
def _(spark, d):
    return V.genes(spark, d).select("gene_id", reports.graphic_width(F.col("end") - F.col("start") + 1).alias("width"))


@C.add("report_csv", W("exons", "pred") + M._CMP + " SELECT gene_id, concat_ws(',', gene_id, class, matches, length) AS line FROM cls")
def _(spark, d):
    return M._classes(spark, d).select("gene_id", F.concat_ws(",", "gene_id", "class", "matches", "length").alias("line"))


@C.add("stream_sessions", """WITH x AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
y AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM x)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS "start", count(*) AS n, round(sum(value) + 1e-9, 4) AS value FROM y GROUP BY user_id, i""")  # fmt: skip
def _(spark, d):
    x = T.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return x.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n", F.round(F.col("value") + 1e-9, 4).alias("value"))
