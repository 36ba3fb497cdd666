"""Structure, comparison, support and sequence operators on small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import attributes as A
from strandline.functions import sequence as Q
from strandline.operators import clusters, compare, structure, summaries, support
from strandline.operators import features as O
from strandline.operators import loci as loci_ops
from strandline.sources import adapters, readers, reports


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def parts(spark, *xs):
    return spark.createDataFrame([(g, "s", st, a, b, c) for g, st, a, b, c in xs], "gene_id int, seqid string, strand string, start bigint, end bigint, code string")


def test_structure_round_trip(spark):
    exons = parts(spark, (1, "+", 10, 50, "F"), (1, "+", 60, 99, "C"), (1, "+", 120, 190, "C"), (2, "-", 10, 50, "C"), (2, "-", 70, 99, "C"))
    cod = spark.createDataFrame([(1, "+", 70, 72, 150, 152), (2, "-", 90, 92, 20, 22)], "gene_id int, strand string, start_s bigint, start_e bigint, stop_s bigint, stop_e bigint")
    cds, utrs = structure.infer_cds(exons, cod), structure.infer_utrs(exons, cod)
    assert rows(cds) == [(1, "+", 120, 152), (1, "+", 70, 99), (2, "-", 20, 50), (2, "-", 70, 92)]
    assert rows(utrs.select("gene_id", "type", "start", "end")) == [
        (1, "five_prime_UTR", 10, 50), (1, "five_prime_UTR", 60, 69), (1, "three_prime_UTR", 153, 190), (2, "five_prime_UTR", 93, 99), (2, "three_prime_UTR", 10, 19)
    ]
    assert rows(structure.infer_exons(cds, utrs)) == rows(exons.select("gene_id", "start", "end"))
    assert rows(structure.phases(cds).select("gene_id", "start", "phase")) == [(1, 120, 0), (1, 70, 0), (2, 20, (3 - 23 % 3) % 3), (2, 70, 0)]
    assert rows(structure.introns(exons, "gene_id")) == [(1, 100, 119), (1, 51, 59), (2, 51, 69)]
    assert rows(structure.codons(exons.where("code = 'C'"))) == [(1, "+", 60, 62, 188, 190), (2, "-", 97, 99, 10, 12)]


def test_strict_introns(spark):
    p = parts(spark, (1, "+", 1, 5, "C"), (1, "+", 6, 9, "C"), (1, "+", 20, 30, "C"))
    assert rows(structure.introns(p, "gene_id", strict=True)) == []
    assert rows(structure.introns(p, "gene_id")) == [(1, 10, 19)]


def test_representatives(spark):
    t = spark.createDataFrame([("g", "b", 30, 1, 9), ("g", "a", 30, 5, 9), ("h", "x", 0, 1, 9), ("h", "y", 0, 4, 9)], "gene string, label string, cds_length bigint, start bigint, end bigint")
    assert rows(structure.representatives(t, ["gene"])) == [("g", "a", 30), ("h", "y", 0)]


def vector(ps, lo, hi):
    v = {x: "G" for x in range(lo, hi + 1)}
    ps = sorted(ps)
    for (_, e, _), (s, _, _) in zip(ps, ps[1:]):
        for x in range(e + 1, s):
            v[x] = "I"
    for s, e, c in ps:
        for x in range(s, e + 1):
            v[x] = c
    return [v[x] for x in range(lo, hi + 1)]


def test_confusion_equals_base_by_base(spark):
    r = [(5, 10, "F"), (15, 30, "C"), (31, 35, "T"), (60, 70, "T")]
    p = [(3, 10, "F"), (12, 30, "C"), (33, 40, "C"), (60, 66, "F")]
    spans = spark.createDataFrame([(1, 100)], "gene_id int, length bigint")
    got = compare.confusion(spans, parts(spark, *[(1, "+", *x) for x in r]), parts(spark, *[(1, "+", *x) for x in p])).first()
    a, b = vector(r, 1, 100), vector(p, 1, 100)
    for k, codes in (("cds", "C"), ("utr", "FT")):
        x = [(m in codes, n in codes) for m, n in zip(a, b)]
        assert [got[f"{k}_{c}"] for c in ("tp", "fn", "fp", "tn")] == [x.count(y) for y in ((True, True), (True, False), (False, True), (False, False))]
    assert got.matches == sum(m == n for m, n in zip(a, b))
    st = compare.structures(spans, parts(spark, *[(1, "+", *x) for x in r]), parts(spark, *[(1, "+", *x) for x in p])).first()
    assert (st.exon_correct, st.exon_missing, st.exon_wrong) == (0, 3, 4)


def test_statistics(spark):
    one = spark.range(1)
    s = compare.scaled(*[F.lit(x) for x in (870, 0, 0, 2240)])
    assert one.select(*[v.alias(k) for k, v in s.items()]).first().asDict() == {"mc": 1.0, "cc": 1.0, "sn": 1.0, "sp": 1.0, "f1": 1.0, "ed": 0.0}
    u = one.select(*[v.alias(k) for k, v in compare.scaled(*[F.lit(x) for x in (337, 11, 131, 2631)]).items()]).first()
    assert math.isclose(u.cc, 0.811995, abs_tol=1e-6)
    none = one.select(*[v.alias(k) for k, v in compare.binary(F.lit(0), F.lit(0), F.lit(0)).items()]).first()
    assert list(none) == [None] * 4
    assert [one.select(compare.tolerance(F.lit(n))).first()[0] for n in (1, 9, 10, 11, 4226)] == pytest.approx([1, 0.1, 0.1, 0.01, 0.0001])


def brute(ts):
    from itertools import combinations

    fine = lambda c: all(a[2] < b[1] or b[2] < a[1] for a, b in combinations(c, 2))
    sets = [frozenset(c) for n in range(2, len(ts) + 1) for c in combinations(ts, n) if fine(c)]
    top = [c for c in sets if not any(c < d for d in sets)]
    return sorted([[t[0]] for t in ts] + [sorted(t[0] for t in c) for c in top])


def test_cliques():
    import random

    rnd = random.Random(3)
    for _ in range(60):
        ts = [(i, s := rnd.randrange(40), s + rnd.randrange(1, 15)) for i in range(rnd.randrange(1, 8))]
        assert sorted(sorted(c) for c in compare.cliques(ts)) == brute(ts)


def test_pairs():
    p = lambda g, s, e: {"gene_id": g, "start": s, "end": e, "code": "C"}
    out = compare.pairs_of({"locus": "l", "start": 1, "end": 100, "refr": [p(1, 10, 20), p(2, 40, 50)], "pred": [p(3, 10, 20), p(4, 40, 50), p(5, 12, 45)]})
    assert (out[0]["refr"], out[0]["pred"], out[0]["n_matches"]) == ("1,2", "3,4", 100)
    assert [(o["kind"], o["pred"]) for o in out[1:]] == [("unique-pred", "5")]


def test_pairs_by_structure_before_agreement():
    def p(g, *xs):
        return [{"gene_id": g, "start": s, "end": e, "code": c} for s, e, c in xs]

    def best(refr, *preds):
        out = compare.pairs_of({"locus": "l", "start": 1, "end": 1000, "refr": refr, "pred": [x for q in preds for x in q]})
        return [(o["refr"], o["pred"], o["kind"]) for o in out]

    # the same coding parts with other untranslated ones, against one base less of the coding parts: that agrees on more bases
    refr = p(1, (100, 199, "F"), (200, 299, "C"), (400, 500, "C"))
    cds, near = p(2, (200, 299, "C"), (400, 500, "C"), (501, 700, "T")), p(3, (100, 199, "F"), (200, 299, "C"), (400, 499, "C"))
    assert best(refr, near, cds) == [("1", "2", "pair"), (None, "3", "unique-pred")]
    # the same exons, all coded otherwise, against one base less
    exons = p(4, (100, 299, "C"), (400, 450, "C"), (451, 500, "T"))
    assert best(refr, near, exons) == [("1", "4", "pair"), (None, "3", "unique-pred")]
    # neither: the coding parts decide, then the untranslated ones; 5 agrees on more bases than 6, but shares less of the coding parts
    more, cc = p(5, (100, 199, "F"), (200, 280, "C"), (400, 490, "C")), p(6, (202, 299, "C"), (400, 500, "C"), (520, 700, "T"))
    assert best(refr, more, cc) == [("1", "6", "pair"), (None, "5", "unique-pred")]
    # an undefined correlation comes last: 7 has no coding part
    assert best(refr, p(7, (100, 198, "F")), p(8, (100, 110, "C"), (900, 1000, "C")))[0] == ("1", "8", "pair")


def test_ranked_pairs(spark):
    refr = [(1, 100, 199, "F"), (1, 200, 299, "C"), (1, 400, 500, "C")]
    pred = [
        (2, 100, 199, "F"), (2, 200, 299, "C"), (2, 400, 500, "C"), (3, 100, 299, "C"), (3, 400, 500, "C"), (4, 200, 299, "C"), (4, 400, 500, "C"),
        (5, 100, 199, "C"), (5, 200, 299, "F"), (5, 400, 500, "C"), (6, 100, 199, "F"), (6, 200, 280, "C"), (6, 400, 490, "C"), (7, 202, 299, "C"), (7, 400, 500, "C"), (7, 520, 700, "T"),
    ]
    part = "array<struct<gene_id:int,start:bigint,end:bigint,code:string>>"
    loci = spark.createDataFrame([(n, 7, 1, 1000, refr, pred) for n in ("l", "m")], f"locus string, n int, start bigint, end bigint, refr {part}, pred {part}")
    got = [(r.locus, r["rank"], r.pred, r.perfect, r.cds_match, r.exon_match) for r in compare.ranked_pairs(loci).orderBy("locus", "rank").collect()]
    # perfect, the same coding parts, the same exons (3 by its correlation before 5), then by correlation; ranks begin anew in each locus
    want = [("2", True, True, True), ("4", False, True, False), ("3", False, False, True), ("5", False, False, True), ("7", False, False, False), ("6", False, False, False)]
    assert got == [(n, k, *x) for n in ("l", "m") for k, x in enumerate(want, 1)]
    # loci above the limit aren't compared, but say so; 0 is no limit
    for most, skipped in ((6, True), (7, False), (0, False)):
        assert {r.locus for r in compare.ranked_pairs(loci, most).where("skipped").collect()} == ({"l", "m"} if skipped else set())
        assert {r.locus for r in compare.selected_pairs(loci, most).where("kind = 'skipped'").collect()} == ({"l", "m"} if skipped else set())


def test_cliques_with_their_counts(spark):
    t = "array<struct<gene_id:bigint,start:bigint,end:bigint,n_exons:bigint,n_utrs:bigint,cds_length:bigint>>"
    loci = spark.createDataFrame([("l", [(1, 1, 10, 2, 1, 5), (2, 5, 20, 3, 0, 9), (3, 12, 30, 1, 1, None)])], f"locus string, transcripts {t}")
    got = sorted(tuple(r) for r in compare.enumerated(loci).collect())
    assert got == [("l", 1, "1", 2, 1, 5, False), ("l", 1, "2", 3, 0, 9, False), ("l", 1, "3", 1, 1, 0, False), ("l", 2, "1,3", 3, 2, 5, False)]
    assert sorted((r.ids, r.skipped) for r in compare.enumerated(loci, 2).collect()) == [("1", True), ("2", True), ("3", True)]
    assert compare.enumerated(loci, 0).count() == 4 and compare.enumerated(loci.where("false")).collect() == []


def test_protein_maps(spark):
    from strandline.sources import adapters

    f = spark.createDataFrame([
        ("f", 1, "locus", "l1", None, "Name=L-1"), ("f", 2, "gene", "g1", "l1", ""), ("f", 3, "mRNA", "m1", "g1", "Name=X-RA"), ("f", 4, "CDS", "c1", "m1", "protein_id=P1;exception=none"),
        ("f", 5, "CDS", "c1", "m9", "protein_id=P1"), ("f", 6, "CDS", "c2", "m1", "protein_id=P2;exception=rearrangement required for product"), ("f", 7, "CDS", "c3", "lost", "protein_id=P3"),
        ("f", 8, "gene", "g2", None, ""), ("f", 9, "mRNA", "m2", "g2", "Name=Y"), ("f", 10, "CDS", "c4", "m2", "protein_id=P4"), ("g", 1, "CDS", "c1", "m1", "protein_id=P1"), ("f", 11, "CDS", None, None, None),
    ], "file_id string, line_no bigint, type string, id string, parent string, attributes string")
    links = adapters.linked_loci(f, F.regexp_extract("attributes", "Name=([^;]+)", 1))
    assert [tuple(r) for r in links.collect()] == [("f", "g1", "L-1")]
    assert [tuple(r) for r in adapters.protein_map(f, links, "refseq").collect()] == [("f", "P1", "L-1")]
    assert [tuple(r) for r in adapters.protein_map(f, links, "hymbase").collect()] == [("f", "X-PA", "L-1")]
    assert sorted(tuple(r) for r in adapters.protein_ids(f, "refseq").collect()) == [("f", "P1", 4), ("f", "P2", 6), ("f", "P3", 7), ("f", "P4", 10), ("g", "P1", 1)]
    assert adapters.protein_map(f.where("false"), links, "tair").collect() == []


def test_accessions_of_genbank_pass_on(spark):
    f = spark.createDataFrame([(1, "gene", "g1", None, "Name=A7"), (2, "mRNA", "m1", "g1", ""), (3, "exon", "e1", "m1", ""), (4, "CDS", "c1", "nowhere", "")], "line_no bigint, type string, id string, parent string, attributes string")
    f = f.withColumn("file_id", F.lit("f")).withColumn("accession", F.lit(None).cast("string"))
    got = {r.line_no: r.found for r in O.accessions(f, "genbank").collect()}
    assert got == {1: "A7", 2: "A7.mRNA", 3: "A7.mRNA", 4: None}


def test_sequences_without_genes(spark):
    r = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "seqid string, start bigint, end bigint")
    g = spark.createDataFrame([("a",), ("a",)], "seqid string")
    assert [(x.seqid, x.end, x.ilocus_type) for x in loci_ops.without_genes(r, g).collect()] == [("b", 20, "fiLocus")]


def test_written_tables_can_be_removed(spark):
    import os

    from strandline import session

    session.clean(spark)
    df = session.written(spark.range(3), "test")
    assert df.count() == 3 and session.clean(spark) == 1 and session.clean(spark) == 0
    assert not [x for x in os.listdir(session.shared_dir(spark).removeprefix("file://")) if x.startswith("strandline-test-")]


def test_a_cluster_needs_a_shared_folder():
    from strandline import session

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        return type("O", (), {"getOrElse": staticmethod(lambda x: None), "isDefined": staticmethod(lambda: False)})

                return S

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(k, d=None):
                return d

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_pair_counts_equal_base_by_base():
    import random

    rnd = random.Random(5)
    for _ in range(200):
        sides = []
        for _ in range(2):
            at, ps = rnd.randrange(1, 6), []
            while at < 50:
                ps.append((at, e := min(60, at + rnd.randrange(8)), rnd.choice("CCFT")))
                at = e + rnd.choice((1, 1, 4))
            sides.append(ps)
        a, b = (vector(ps, 1, 60) for ps in sides)
        row = {"start": 1, "end": 60} | {side: [{"gene_id": 1, "start": s, "end": e, "code": c} for s, e, c in ps] for side, ps in zip(("refr", "pred"), sides)}
        (got,) = compare._ordered(compare._sides(row), 60)
        assert got["n_matches"] == sum(m == n for m, n in zip(a, b))
        for k, codes in (("cds", "C"), ("exon", "CFT")):
            assert got[f"{k}_match"] == ([m in codes for m in a] == [n in codes for n in b])
        for k, codes in (("cds_cc", "C"), ("utr_cc", "FT")):
            x = [(m in codes, n in codes) for m, n in zip(a, b)]
            tp, fn, fp, tn = (x.count(y) for y in ((True, True), (True, False), (False, True), (False, False)))
            d = math.sqrt((tp + fn) * (tn + fp) * (tp + fp) * (tn + fn))
            assert got[k] == (pytest.approx((tp * tn - fn * fp) / d) if d else None)


def test_support(spark):
    e = parts(spark, (1, "+", 1, 100, "C"), (1, "+", 201, 300, "C"), (2, "-", 1, 100, "C"))
    al = spark.createDataFrame([("s", "+", 51, 80), ("s", "+", 71, 120), ("s", "+", 290, 400), ("s", "-", 500, 600)], "seqid string, strand string, start bigint, end bigint")
    assert rows(support.coverage(e, al)) == [(1, 61, 200, 0.305), (2, 0, 100, 0.0)]
    i = spark.createDataFrame([(1, "s", 101, 200), (1, "s", 301, 309)], "gene_id int, seqid string, start bigint, end bigint")
    gaps = spark.createDataFrame([("s", 101, 200), ("s", 101, 200)], "seqid string, start bigint, end bigint")
    assert rows(support.confirmed(i, gaps)) == [(1, 2, 1)]
    with pytest.raises(ValueError):
        support.integrity(F.lit(1), F.lit(1), F.lit(1), F.lit(1), (0.5, 0.1, 0.1, 0.1))


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTN",), ("acgsw",), ("NNXX",), ("",), (None,)], "seq string")
    got = df.select(Q.gc_content(F.col("seq")), Q.gc_skew(F.col("seq")), Q.n_content(F.col("seq")), Q.reverse_complement(F.col("seq")), Q.letter_counts(F.col("seq")).alias("n")).collect()
    assert [tuple(r)[:4] for r in got[:4]] == [(0.5, 0.0, 0.2, "NACGT"), (0.6, 0.0, 0.0, "wscgt"), (0.0, 0.0, 1.0, "XXNN"), (0.0, 0.0, 0.0, "")]
    assert [tuple(r.n) for r in got] == [(1, 1, 0, 2, 1), (1, 1, 1, 2, 0), (0, 0, 0, 0, 4), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]
    one = spark.createDataFrame([("AACCGGTT", [(5, 6), (1, 2)])], "seq string, p array<struct<start:bigint,end:bigint>>")
    assert tuple(one.select(Q.spliced(F.col("seq"), F.col("p"), F.lit("+")), Q.spliced(F.col("seq"), F.col("p"), F.lit("-")), Q.wrapped(F.col("seq"), 3), Q.subsequence(F.col("seq"), F.lit(7), F.lit(9))).first()) == ("AAGG", "CCTT", "AAC\nCGG\nTT", None)


def test_attributes(spark):
    df = spark.createDataFrame([("ID=a;Name=x%20y; Note=z;Name=w",), ("xName=1",), (None,)], "attributes string")
    assert [r[0] for r in df.select(A.get("attributes", "Name")).collect()] == ["x%20y", None, None]
    assert df.select(A.as_map("attributes")).first()[0] == {"ID": "a", "Name": "x y", "Note": "z"}
    assert df.select(A.without("attributes", "Name")).first()[0].startswith("ID=a;")


def test_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.fa").write_text(">one first\nACG\nT\n>two\n\nGG\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">three\r\nAAA\r\n")
    got = readers.fasta(readers.lines_of(spark, str(tmp_path / "*.fa*")))
    assert rows(got.select("seqid", "defline", "seq")) == [("one", "one first", "ACGT"), ("three", "three", "AAA"), ("two", "two", "GG")]
    (tmp_path / "c.clstr").write_text(">Cluster 0\n0\t120aa, >gnl|Abc|P1.1... *\n1\t90aa, >gnl|Def|P2.1... at 80%\n>Cluster 1\n0\t50aa, >gnl|Abc|P3.1... *\n")
    got = readers.clusters(readers.lines_of(spark, str(tmp_path / "c.clstr")))
    assert rows(got.select("cluster_id", "idx", "length", "species", "accession")) == [("0", 0, 120, "Abc", "P1.1"), ("0", 1, 90, "Def", "P2.1"), ("1", 0, 50, "Abc", "P3.1")]
    readers.write_tsv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "t"))
    assert rows(readers.read_tsv(spark, str(tmp_path / "t"), "a int, b string")) == [(1, "x")]
    (tmp_path / "x.gff3").write_text("##gff-version 3\n##sequence-region s 1 99\ns\tq\tgene\t5\t9\t.\t+\t.\tID=g1\n")
    from strandline.sources import gff3_rows

    lines = readers.lines_of(spark, str(tmp_path / "x.gff3"))
    assert rows(readers.regions(lines)) == [("s", 1, 99)]
    f = gff3_rows.loaded(lines.withColumn("k", F.lit(1)), ["k"])
    assert [r.value for r in readers.gff3_text(f.withColumn("attributes", F.lit(None).cast("string"))).collect()] == ["s\tq\tgene\t5\t9\t.\t+\t.\tID=g1"]


def test_filter_file():
    with pytest.raises(ValueError):
        readers.locus_filters("LocusSize > 3")
    with pytest.raises(ValueError):
        readers.locus_filters("GeneCount >> 3")


def test_adapters(spark):
    lines = spark.createDataFrame([("f", 1, "scaffold_7\tx\ttranscript\t1\t2\t.\t+\t.\tID=a"), ("f", 2, "scaffold_7\tx\tregion\t1\t2\t.\t+\t.\tID=b"), ("f", 3, "")], "file string, line_no bigint, line string")
    assert rows(adapters.normalised(lines, "crg", "Ab").select("line"))[1][0].startswith("AbScf_7\tx\tmRNA")
    assert [r.line_no for r in adapters.normalised(lines, "refseq").collect()] == [1, 3]
    assert sorted(r.line_no for r in adapters.normalised(lines, "local").collect()) == [1, 2]
    assert any(r.line.endswith("ID=a;Name=a") for r in adapters.normalised(lines, "hymbase").collect())
    with pytest.raises(ValueError):
        adapters.normalised(lines, "nowhere")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "s<", 5, 9, "perfect", 5, 5, 1.0, None, 1.0, 0.0, 1, 0, 0)], "gene_id int, seqid string, start bigint, end bigint, class string, matches bigint, length bigint, sn double, sp double, f1 double, ed double, exon_correct bigint, exon_missing bigint, exon_wrong bigint")
    assert "CDS specificity             --" in reports.text(df).first().block
    pages = reports.html(df.withColumn("seqid", F.lit("s")))
    reports.write_pages(pages, str(tmp_path))
    assert "<td>perfect</td>" in (tmp_path / "s" / "5-9.html").read_text()
    assert rows(reports.summary_lines(spark.createDataFrame([("a", 3), ("b", 1)], "class string, n bigint")))[0][1].endswith("( 75.0%)")


def test_clusters(spark):
    base = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVV"
    near = base[:20] + "W" + base[21:]
    df = spark.createDataFrame([("a", base), ("b", near), ("c", base), ("d", "PPPPPGGGGGHHHHHLLLLLCCCCC"), ("e", None), ("f", "")], "seqid string, seq string")
    got = {r.seqid: r.cluster_id for r in clusters.by_sequence(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_clusters_equal_brute_force(spark):
    import random

    rnd = random.Random(7)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    some = lambda n: "".join(rnd.choices(letters, k=n))
    seqs = {"".join(rnd.choice(letters) if rnd.random() < rate else c for c in base) for n, rate in ((300, 0.04), (300, 0.055), (60, 0.06)) for _ in range(8) for base in [some(n)] for _ in range(5)}
    seqs |= {some(n) for n in range(1, 12)} | {"MKV", "MKVL", "MKVLA", "MKVLAT", "MKVLATR", "A" * 30, "A" * 9}
    data = {f"p{i:03}": s for i, s in enumerate(rnd.sample(sorted(seqs), len(seqs)))}
    grams = {i: {s[j : j + 5] for j in range(max(1, len(s) - 4))} for i, s in data.items()}
    want = {i: i for i in data}
    pairs = [(a, b) for a in data for b in data if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.5]
    for _ in data:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = {r.seqid: r.cluster_id for r in clusters.by_sequence(spark.createDataFrame(list(data.items()), "seqid string, seq string")).collect()}
    assert len(pairs) > 50
    assert got == want


def test_summaries(spark):
    pts = spark.createDataFrame([("x", 1.0, 1.0)] * 9 + [("x", 100.0, 100.0)], "species string, sigma double, phi double")
    assert rows(summaries.centroids(pts)) == [("x", 1.0, 1.0)]


def test_sessions_on_a_stream(spark, tmp_path):
    import datetime as dt

    from strandline.streaming.sessions import sessions

    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    data = [(1, t(0), 1.0), (1, t(5), 2.0), (1, t(40), 4.0), (2, t(3), 8.0)]
    df = spark.createDataFrame(data, "user_id bigint, ts timestamp, value double")
    df.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, t(600), 0.0)], df.schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    whole = rows(sessions(df).select("user_id", "n", "value"))
    assert rows(spark.sql("select user_id, n, value from sessions_out where user_id < 9")) == whole == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 8.0)]
