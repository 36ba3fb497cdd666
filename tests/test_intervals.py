"""Windows along lines, interval joins and loci on small cases, with cells far smaller than the data."""

import random

from pyspark.sql import functions as F

from strandline.operators import intervals, lines, loci


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(spark, n=400, seed=1, scale=3000):
    rnd = random.Random(seed)
    data = [(rnd.choice(["hot"] * 5 + ["a", "b"]), s := rnd.randrange(1, scale), s + rnd.choice([0, 3, 10, 40, 300]), i, rnd.choice("+-.")) for i in range(n)]
    return data, spark.createDataFrame(data, "seqid string, start bigint, end bigint, gene_id bigint, strand string").repartition(5)


def test_islands(spark):
    data, df = some(spark)
    want = []
    for k in {d[0] for d in data}:
        reach, isle = 0, 0
        for q, s, e, i, _ in sorted((d for d in data if d[0] == k), key=lambda d: d[1:4]):
            if s > reach:
                isle = s
            reach = max(reach, e)
            want.append((q, i, isle))
    for cell in (7, 100, 1 << 20):
        assert rows(lines.islands(df, ["seqid"], "start", "end", cell=cell).select("seqid", "gene_id", "island")) == sorted(want, key=str)


def test_neighbours_and_numbers(spark):
    data, df = some(spark, seed=2)
    order = {k: sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[3])) for k in {d[0] for d in data}}
    want = [(k, x[3], p[3] if p else None, n[3] if n else None) for k, v in order.items() for p, x, n in zip([None, *v], v, [*v[1:], None])]
    serial = [(d[3], i) for i, d in enumerate((d for k in sorted(order) for d in order[k]), 1)]
    for cell in (11, 500, 1 << 20):
        got = lines.neighbours(df, ["seqid"], ["start", "gene_id"], ["gene_id"], cell=cell).select("seqid", "gene_id", "prev_gene_id", "next_gene_id")
        assert rows(got) == sorted(want, key=str)
        assert rows(lines.numbered(df, ["seqid"], ["start", "gene_id"], cell=cell).select("gene_id", "serial")) == sorted(serial, key=str)


def test_carried(spark):
    data, df = some(spark, seed=3)
    want = []
    for k in {d[0] for d in data}:
        last = None
        for d in sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[3])):
            last = d[3] if d[4] == "." else last
            want.append((d[3], last))
    for cell in (13, 1 << 20):
        got = lines.carried(df, ["seqid"], ["start", "gene_id"], F.col("strand") == ".", "c", cell=cell).select("gene_id", "c.gene_id")
        assert rows(got) == sorted(want, key=str)


def test_overlap_join(spark):
    a, x = some(spark, 150, 4)
    b, y = some(spark, 150, 5)
    want = sorted((p[3], q[3]) for p in a for q in b if p[0] == q[0] and p[1] <= q[2] and p[2] >= q[1])
    for width in (5, 64, 100_000):
        assert sorted(tuple(r) for r in intervals.overlap_join(x, y, ["seqid"], width=width).select("gene_id", "b_gene_id").collect()) == want


def test_empty(spark):
    _, df = some(spark)
    none = df.where("false")
    regions = spark.createDataFrame([("a", 1, 5000)], "seqid string, start bigint, end bigint")
    assert rows(loci.merged(none)) == [] and rows(loci.extended(loci.merged(none), regions)) == [] and rows(intervals.union(none, ["seqid"])) == []


def test_every_base_is_in_one_locus(spark):
    """Effective lengths of all loci of a sequence add up to its length, whatever the gaps."""
    rnd = random.Random(6)
    data, at = [], 0
    for i in range(120):
        at += rnd.choice([1, 30, 90, 130, 190, 210, 280, 305, 500, 900])
        data.append(("s", at, at + (n := rnd.choice([10, 80, 200])), i, rnd.choice("+-")))
        at += n
    df = spark.createDataFrame(data, "seqid string, start bigint, end bigint, gene_id bigint, strand string")
    for size in (at + 1, at + 150, at + 5000):
        reg = spark.createDataFrame([("s", 1, size)], "seqid string, start bigint, end bigint")
        x = loci.extended(loci.merged(df), reg, 100)
        n = loci.effective_length(F.col("start"), F.col("end"), F.col("left_overlap"), F.col("right_overlap"))
        # loci that lap over two neighbours share more than pairs; none are that short here but by chance
        total = x.agg(F.sum(n)).first()[0]
        assert abs(total - size) <= size * 0.02


def gene(i, s, e, cs=None, ce=None, ex=()):
    return {"gene_id": i, "start": s, "end": e, "cs": cs, "ce": ce, "exons": [{"s": a, "e": b} for a, b in ex]}


ROW = {"start": 1, "end": 3000, "left_overlap": 10, "right_overlap": 5, "liil": 7, "riil": 9}
WHOLE = 3000 - 5 - 2


def refined(*genes):
    got = loci.refine(ROW | {"genes": list(genes)})
    assert min(p["start"] for p in got) == 1 and max(p["end"] for p in got) == 3000
    return [(p["type"], p.get("exception"), p.get("effective"), p.get("liil"), p.get("riil")) for p in got]


def test_refinement_of_two():
    inner = gene(2, 1000, 1500, 1000, 1500, [(1000, 1500)])
    assert refined(gene(1, 600, 2400, 600, 2400, [(600, 800), (2000, 2400)]), inner) == [("ciLocus", None, WHOLE, None, None), ("siLocus", "intron-gene", None, None, None)]
    # an exon is in the way: one bin of two genes
    assert refined(gene(1, 600, 2400, 600, 2400, [(600, 1100), (2000, 2400)]), inner) == [("ciLocus", "complex-overlap-2", WHOLE, None, None)]
    # coding ranges apart, both coding
    assert refined(gene(1, 600, 1400, 600, 900), gene(2, 1300, 2400, 1500, 2400)) == [("siLocus", "gene-overlap-gene", WHOLE, None, 0), ("siLocus", None, None, 0, None)]
    # one coding: both have a length, and the overlap is shared
    got = loci.refine(ROW | {"genes": [gene(1, 600, 1400, ex=[(600, 1400)]), gene(2, 1300, 2400, 1350, 2400, [(1300, 2400)])]})
    assert [(p["type"], p.get("exception"), p["liil"], p["riil"]) for p in got] == [("niLocus", "gene-overlap-gene", 7, 0), ("siLocus", None, 0, 9)]
    assert sum(p["effective"] for p in got) == WHOLE and [(p["start"], p["end"]) for p in got] == [(1, 1900), (800, 3000)]
    # one coding, within the other: what is said of the pair stands at the one that contains
    assert refined(gene(1, 100, 2900, 100, 2900), gene(2, 1300, 1400)) == [("siLocus", "gene-contain-gene", WHOLE, 7, 9), ("niLocus", None, 0, 0, 0)]


def test_refinement_of_many():
    three = [gene(1, 600, 1400, 600, 1400), gene(2, 1300, 2400, 1350, 2400), gene(3, 2390, 2500, 2395, 2500)]
    assert refined(*three) == [("ciLocus", "complex-overlap-3", WHOLE, None, None)]
    # bins of two and one: all genes of the locus are counted
    assert refined(*three[:2], gene(3, 2350, 2500, 2450, 2500)) == [("ciLocus", "complex-overlap-3", WHOLE, None, 0), ("siLocus", None, None, 0, None)]
    # three loci of like status get no lengths beside
    assert refined(gene(1, 600, 1400, 600, 900), gene(2, 1300, 2400, 1500, 1900), gene(3, 2300, 2500, 2450, 2500)) == [("siLocus", None, WHOLE, None, None), ("siLocus", None, None, None, None), ("siLocus", None, None, None, None)]
    # mixed: the one that ends last has what lies to the right
    assert refined(gene(1, 600, 1400, 600, 900), gene(2, 700, 2450), gene(3, 1500, 1900, 1500, 1900)) == [("siLocus", "complex-overlap-3", WHOLE, 7, None), ("niLocus", None, None, 0, 9), ("siLocus", None, None, 0, 0)]
    # the first ends last
    assert refined(gene(1, 600, 2450, 600, 900), gene(2, 700, 1400), gene(3, 1500, 1900, 1500, 1900))[0] == ("siLocus", "complex-overlap-3", WHOLE, 7, 9)


def test_bins_are_a_fold():
    """Only the last bin is open: a coding gene after a non-coding one begins a new bin though it meets the coding one before."""
    genes = [gene(1, 600, 2000, 600, 2000), gene(2, 700, 900), gene(3, 800, 1900, 800, 1900)]
    assert [[g["gene_id"] for g in b] for b in loci.bins_of(genes)] == [[1], [2], [3]]
    assert [[g["gene_id"] for g in b] for b in loci.bins_of(genes, by_cds=False)] == [[1, 2, 3]]
