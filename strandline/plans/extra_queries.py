"""Further scans, parts of the refinement, small functions, and the whole programs as plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import attributes as A
from strandline.functions import sequence as Q
from strandline.operators import features as O
from strandline.operators import loci, structure
from strandline.operators.packed import values_of
from strandline.plans import loci_queries as L
from strandline.plans import model_queries as M
from strandline.plans import problems as P
from strandline.plans import views as V
from strandline.plans.catalog import Catalog
from strandline.plans.feature_queries import _TREE, _attr
from strandline.plans.problems import _P3, _VALUES
from strandline.plans.summary_queries import MOTIF, with_sequence
from strandline.session import new_path, ship, table
from strandline.sources import readers
from strandline.sources.registry import Registry

C = Catalog()
W = V.with_views


@C.add("scan_gff3", f"""WITH bad AS ({_P3}), x AS (SELECT line_id, string_split(regexp_replace(line, '\\r$', ''), chr(9)) AS c FROM raw_gff3
WHERE line IS NOT NULL AND trim(line, ' ' || chr(9) || chr(13)) <> '' AND NOT starts_with(line, '#') AND line_id NOT IN (SELECT line_id FROM bad))
SELECT line_id, c[1] AS seqid, c[3] AS type, CAST(c[4] AS BIGINT) AS "start", CAST(c[5] AS BIGINT) AS "end", TRY_CAST(c[6] AS DOUBLE) AS score, c[7] AS strand, TRY_CAST(c[8] AS TINYINT) AS phase FROM x""")  # fmt: skip
def _(spark, d):
    return P.p3_loaded(spark, d).select("line_id", "seqid", "type", "start", "end", "score", "strand", "phase")


@C.add("scan_gzip", "SELECT line, count(*) AS n FROM (SELECT rtrim(line, chr(13)) AS line FROM raw_gff3 WHERE line IS NOT NULL AND line <> '') GROUP BY 1")
def _(spark, d):
    """Lines written compressed, and read again."""
    path = new_path(spark, "gz")
    table(spark, d, "raw_gff3").where("line IS NOT NULL AND line <> ''").select(F.rtrim("line", F.lit("\r")).alias("value")).write.option("compression", "gzip").text(path)
    return readers.lines_of(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@C.add("scan_filter_file", """SELECT * FROM (VALUES ('LocusLength', '>=', 1000, NULL), ('GeneCount', '<', 4, NULL), ('ExonCount', '>', 3, 'R'), ('TranscriptCount', '<>', 0, NULL)) t(metric, op, value, source)""")
def _(spark, d):
    """A filter file, scanned; it has a line a rule, whatever the data."""
    path = new_path(spark, "filter")
    lines = ["# rules", "", "LocusLength >= 1000", "GeneCount < 4", "ExonCount > 3 R", "TranscriptCount <> 0"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    rules = readers.filter_rules("\n".join(r.line for r in readers.lines_of(spark, path).orderBy("line_no").collect()))
    return spark.createDataFrame(rules, "metric string, op string, value int, source string")


@C.add("registry", """SELECT source, count(*) AS n, string_agg(label, ',' ORDER BY label) AS labels FROM genomes WHERE label IS NOT NULL AND species IS NOT NULL
AND source IN ('refseq', 'genbank', 'hymbase', 'beebase', 'crg', 'tair', 'am10', 'pdom', 'local') GROUP BY 1""")  # fmt: skip
def _(spark, d):
    r = Registry.of(table(spark, d, "genomes").collect())  # configurations: a few rows, whatever the data
    by = {s: r.labels(s) for s in {g["source"] for g in r.genomes.values()}}
    return spark.createDataFrame([(s, len(x), ",".join(x)) for s, x in sorted(by.items())], "source string, n bigint, labels string")


@C.add("mem_source", "SELECT * FROM (VALUES ('s', 1, 5), ('s', 9, 12), ('t', 2, 2)) v(seqid, \"start\", \"end\")")
def _(spark, d):
    return spark.createDataFrame([("s", 1, 5), ("s", 9, 12), ("t", 2, 2)], "seqid string, start int, end int")


# refinement, by part


def _refined(spark, d):
    ship(spark)
    return loci.refined(V.genes(spark, d), V.exons(spark, d), V.regions(spark, d))


@C.add("refine_intron_gene", L.refined_sql("SELECT seqid, locus_start, array_to_string(list_transform(gs, lambda x: x.id), ',') AS genes FROM part WHERE exception = 'intron-gene'"))
def _(spark, d):
    return _refined(spark, d).where("exception = 'intron-gene'").select("seqid", "locus_start", "genes")


@C.add("refine_resolve_bins", L.refined_sql("SELECT seqid, locus_start, count(*) AS n_parts, CAST(sum(n_genes) AS BIGINT) AS n_genes FROM part GROUP BY ALL"))
def _(spark, d):
    return _refined(spark, d).groupBy("seqid", "locus_start").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_genes").alias("n_genes"))


@C.add("refine_extend", L.refined_sql("""SELECT seqid, locus_start, CAST(part AS INTEGER) AS part, s AS "start", e AS "end", CAST(effective_length AS BIGINT) AS effective_length,
  CAST(liil AS BIGINT) AS liil, CAST(riil AS BIGINT) AS riil, exception FROM part"""))
def _(spark, d):
    return _refined(spark, d).select("seqid", "locus_start", "part", "start", "end", "effective_length", "liil", "riil", "exception")


@C.add("set_range", W("exons") + ' SELECT gene_id, min(s) AS "start", max(e) AS "end", min(s) <= max(e) AS sound FROM exons GROUP BY 1')
def _(spark, d):
    x = V.exons(spark, d).groupBy("gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return x.withColumn("sound", F.col("start") <= F.col("end"))


@C.add("splice_complexity", W("genes") + " SELECT gene_id, -1.0::DOUBLE AS complexity FROM genes")
def _(spark, d):
    """A placeholder, as in what it stands for: always -1."""
    return V.genes(spark, d).select("gene_id", F.lit(-1.0).alias("complexity"))


@C.add("attr_regex", W("feats") + r""" SELECT file_id, line_no, nullif(regexp_extract(attributes, 'GeneID:([0-9]+)', 1), '') AS gene FROM feats WHERE regexp_matches(attributes, 'GeneID:[0-9]+')""")
def _(spark, d):
    x = V.features(spark, d).select("file_id", "line_no", F.regexp_extract("attributes", r"GeneID:([0-9]+)", 1).alias("gene"))
    return x.where("gene <> ''")


@C.add("feature_type_of_pseudo", W("feats") + f""", x AS (SELECT file_id, {_VALUES.format(c="parent")}[1] AS p, type, s, e, line_no FROM feats WHERE parent IS NOT NULL)
SELECT file_id, p AS container, arg_min(type, (s, e, line_no, type)) AS type FROM x WHERE p IS NOT NULL GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    x = V.features(spark, d).where("parent IS NOT NULL").withColumn("p", F.get(values_of("parent"), F.lit(0))).where("p IS NOT NULL")
    return x.groupBy("file_id", F.col("p").alias("container")).agg(F.min_by("type", F.struct("start", "end", "line_no", "type")).alias("type"))


# whole programs


@C.add("pipeline_tidy", _TREE + f""", off AS (SELECT DISTINCT file_id, top FROM und WHERE {_attr("gene_biotype")} = 'ncRNA'),
gone AS (SELECT DISTINCT top.file_id, top.id FROM top SEMI JOIN off ON top.file_id = off.file_id AND top.top = off.top),
kept AS (SELECT f.* FROM feats f ANTI JOIN gone ON f.file_id = gone.file_id AND f.id = gone.id
  WHERE NOT (f.id IS NULL AND EXISTS (SELECT 1 FROM v JOIN gone g ON g.file_id = v.file_id AND g.id = v.p WHERE v.file_id = f.file_id AND v.line_no = f.line_no AND v.id IS NULL)))
SELECT file_id, type, count(*) AS n FROM (SELECT file_id, type FROM kept UNION ALL
  SELECT file_id, 'gene' FROM (SELECT DISTINCT file_id, coalesce(id, 'line' || line_no) AS k FROM kept WHERE len(coalesce({_VALUES.format(c="parent")}, [])) = 0 AND type IN ('mRNA', 'tRNA', 'rRNA', 'ncRNA'))) GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    """Trees with an unwanted attribute go, and transcripts without a parent get one: counts by type."""
    ship(spark)
    kept = O.without_trees(V.features(spark, d), A.get("attributes", "gene_biotype") == "ncRNA")
    both = kept.select("file_id", "type").unionByName(structure.infer_parents(kept).select("file_id", "type"))
    return both.groupBy("file_id", "type").agg(F.count(F.lit(1)).alias("n"))


@C.add("pipeline_representatives", M._MRNA + """, r AS (SELECT file_id, gene, id, row_number() OVER (PARTITION BY file_id, gene ORDER BY cds_length DESC, CASE WHEN cds_length = 0 THEN -s ELSE 0 END, CASE WHEN cds_length = 0 THEN -e ELSE 0 END, id) AS rn FROM t)
SELECT r.file_id, r.gene, r.id AS mrna, count(v.line_no) AS n_parts FROM r LEFT JOIN v ON v.file_id = r.file_id AND v.p = r.id WHERE rn = 1 GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    """Each gene with its representative transcript and what hangs on it."""
    t = M._transcripts(spark, d).withColumn("label", F.col("id"))
    best = structure.representatives(t, ["file_id", "gene"]).select("file_id", "gene", F.col("label").alias("mrna"))
    parts = V.features(spark, d).where("parent IS NOT NULL").select("file_id", "line_no", "type", "start", "end", F.explode(values_of("parent")).alias("mrna")).distinct()
    n = parts.groupBy("file_id", "mrna").agg(F.count(F.lit(1)).alias("n_parts"))
    return best.join(n, ["file_id", "mrna"], "left").select("file_id", "gene", "mrna", F.coalesce("n_parts", F.lit(0)).alias("n_parts"))


@C.add("pipeline_extract", W("genes") + f""" SELECT gene_id, '>g' || gene_id || ' ' || seqid || '_' || s || '-' || e || strand AS defline, CASE WHEN strand = '-' THEN reverse(translate(q, 'ACGTUWSMKRYBDHVN', 'TGCAAWSKMYRVHDBN')) ELSE q END AS seq
FROM (SELECT *, substr(repeat('{MOTIF}', CAST((e - s) // {len(MOTIF)} + 2 AS INTEGER)), (s - 1) % {len(MOTIF)} + 1, e - s + 1) AS q FROM genes)""")  # fmt: skip
def _(spark, d):
    """Sequences of genes, turned where they lie on the reverse strand, with their headers."""
    x = with_sequence(V.genes(spark, d))
    seq = F.when(F.col("strand") == "-", Q.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return x.select("gene_id", F.concat(F.lit(">g"), "gene_id", F.lit(" "), "seqid", F.lit("_"), "start", F.lit("-"), "end", "strand").alias("defline"), seq.alias("seq"))


@C.add("pipeline_loci", W("genes") + L._extended() + f" SELECT kind, exception, count(*) AS n, CAST(sum(\"end\" - \"start\" + 1) AS BIGINT) AS bases FROM ({L._all(500)}) GROUP BY ALL")
def _(spark, d):
    x = L.locus_extend(spark, d)
    return x.groupBy("kind", "exception").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


@C.add("pipeline_canonical", W("exons") + M._COD + """ SELECT type, count(*) AS n FROM (SELECT 'exon' AS type FROM exons UNION ALL SELECT 'CDS' FROM cds UNION ALL SELECT CASE WHEN before = (strand <> '-') THEN 'five_prime_UTR' ELSE 'three_prime_UTR' END FROM utr
UNION ALL SELECT 'start_codon' FROM cod UNION ALL SELECT 'stop_codon' FROM cod UNION ALL SELECT 'intron' FROM (SELECT *, lead(s) OVER (PARTITION BY gene_id ORDER BY s) AS nx FROM exons) WHERE nx > e + 1) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    """Everything that can be inferred about the genes, counted by type."""
    kind = lambda df, t: df.select(F.lit(t).alias("type"))
    cod = M._cod(spark, d)
    all_ = kind(V.exons(spark, d), "exon").union(kind(M._cds(spark, d), "CDS")).union(M._utrs(spark, d).select("type")).union(kind(cod, "start_codon")).union(kind(cod, "stop_codon")).union(kind(M._introns(spark, d), "intron"))
    return all_.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


