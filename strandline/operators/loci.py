"""Loci: merging of overlapping genes, extension by delta, the stretches between, refinement and merged loci."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import lines
from strandline.session import written

GENE_TYPES = ("siLocus", "ciLocus", "niLocus")


def orientation(left: Column, right: Column) -> Column:
    """FF, FR, RF or RR of the strands of two flanking genes; whatever is neither + nor - counts as RR."""
    return (
        F.when((left == "+") & (right == "+"), "FF").when((left == "+") & (right == "-"), "FR").when((left == "-") & (right == "+"), "RF").otherwise("RR")
    )


def with_locus(genes: DataFrame) -> DataFrame:
    """Genes with ``locus_start``, which names the locus on the sequence: overlapping genes share it, on any strand."""
    return lines.islands(genes, ["seqid"], "start", "end", into="locus_start")


def merged(genes: DataFrame, /, **more: Column) -> DataFrame:
    """seqid, start, end, n_genes and the strand of the first gene of each locus, and ``more`` aggregates of its genes."""
    g = with_locus(genes)
    return g.groupBy("seqid", "locus_start").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_genes"), F.min(F.struct("start", "end", "gene_id", "strand")).getField("strand").alias("strand"),
        *[v.alias(k) for k, v in more.items()],
    ).drop("locus_start")


def extended(loci: DataFrame, regions: DataFrame, delta: int = 500, endmode: int = 0, skip_ii: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Loci stretched by delta, with the intergenic (ii) and end (fi) loci between and around them.

    seqid, start, end, core_start, core_end, kind (gene, ii, fi), n_genes, left_overlap, right_overlap, liil, riil, exception,
    orient. The gap before a locus decides: up to one delta, up to two, up to three, or more. ``endmode``: -1 leaves out end
    loci, 1 leaves out intergenic ones, 0 gives both. Columns named in ``keep`` go with the gene loci, and are null elsewhere.

    The loci are written once first: finding neighbours reads them twice, and would find the islands anew each time.
    """
    loci = written(loci, "core")
    reg = regions.select("seqid", F.col("start").alias("S"), F.col("end").alias("E"))
    x = lines.neighbours(loci, ["seqid"], ["start", "end"], ["start", "end", "strand"]).join(reg, "seqid")
    d = F.lit(delta)
    s, e, p, n, S, E = (F.col(c) for c in ("start", "end", "prev_end", "next_start", "S", "E"))

    def case(before: Column, after: Column) -> Column:
        return F.when(before + d >= after, "A").when(before + 2 * d >= after, "B").when(before + 3 * d >= after, "C").otherwise("D")

    x = x.withColumn("lc", F.when(p.isNull(), "-").otherwise(case(p, s))).withColumn("rc", F.when(n.isNull(), "-").otherwise(case(e, n)))

    def left(before: Column, at: Column, kind: Column) -> Column:
        return F.when(kind == "C", F.floor((before + at) / 2) + 1).when((kind == "A") & (S + d > at), S).otherwise(at - d)

    x = x.withColumn("ns", F.when(F.col("lc") == "-", F.when(s >= S + 2 * d, s - d).otherwise(S)).otherwise(left(p, s, F.col("lc"))).cast("bigint"))
    x = x.withColumn(
        "ne",
        F.when(F.col("rc") == "-", F.when((E > 2 * d) & (e <= E - 2 * d), e + d).otherwise(E)).when(F.col("rc") == "C", F.floor((e + n) / 2)).otherwise(F.least(e + d, E)).cast("bigint"),
    )
    shared = lambda kind, before, at: F.when(kind == "A", F.least(before + d, E) - left(before, at, kind) + 1).when(kind == "B", before - at + 2 * d + 1)
    ends, inner = endmode >= 0 and not skip_ii, endmode <= 0 and not skip_ii
    gap = lambda before, at: (at - d - 1) - (before + d + 1) + 1
    il = lambda kind, before, at: F.when(kind.isin("A", "B", "C"), 0).when((kind == "D") & F.lit(inner) & (gap(before, at) > 0), gap(before, at)).cast("bigint")
    x = (
        x.withColumn("lo", F.coalesce(shared(F.col("lc"), p, s), F.lit(0)).cast("bigint"))
        .withColumn("ro", F.coalesce(shared(F.col("rc"), e, n), F.lit(0)).cast("bigint"))
        .withColumn("li", il(F.col("lc"), p, s))
        .withColumn("ri", il(F.col("rc"), e, n))
        .withColumn("ex", F.when(F.col("rc") == "A", "delta-overlap-gene").when(F.col("rc") == "B", "delta-overlap-delta").when(F.col("rc") == "C", "delta-re-extend"))
        .withColumn("fg", F.when(F.col("rc") != "-", orientation(F.col("strand"), F.col("next_strand"))))
    )
    none = F.lit(None).cast("bigint")
    row = lambda kind, a, b, **k: F.struct(
        F.lit(kind).alias("kind"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end"),
        *[k.get(c, none).cast("bigint").alias(c) for c in ("core_start", "core_end", "n_genes", "left_overlap", "right_overlap", "liil", "riil")],
        k.get("exception", F.lit(None)).cast("string").alias("exception"), k.get("orient", F.lit(None)).cast("string").alias("orient"),
        *[(F.col(c) if kind == "gene" else F.lit(None).cast(loci.schema[c].dataType)).alias(c) for c in keep],
    )
    gene = row("gene", F.col("ns"), F.col("ne"), core_start=s, core_end=e, n_genes=F.col("n_genes"), left_overlap=F.col("lo"), right_overlap=F.col("ro"), liil=F.col("li"), riil=F.col("ri"), exception=F.col("ex"))
    fi_l = F.when(F.lit(ends) & (F.col("lc") == "-") & (s >= S + 2 * d) & (s - d - 1 > 0) & (s - d - 1 >= S), row("fi", S, s - d - 1))
    ii = F.when(F.lit(inner) & (F.col("rc") == "D") & (gap(e, n) > 0), row("ii", e + d + 1, n - d - 1, orient=F.col("fg")))
    fi_r = F.when(F.lit(ends) & (F.col("rc") == "-") & (E > 2 * d) & (e <= E - 2 * d) & (e + d + 1 <= E), row("fi", e + d + 1, E))
    out = x.select("seqid", F.explode(F.filter(F.array(fi_l, gene, ii, fi_r), lambda r: r.isNotNull())).alias("r"))
    return out.select("seqid", "r.*")


def effective_length(start: Column, end: Column, left: Column, right: Column) -> Column:
    """Length without the halves of what is shared with the neighbours: rounded up on the left, down on the right."""
    return (end - start + 1 - F.ceil(F.coalesce(left, F.lit(0)) / 2) - F.floor(F.coalesce(right, F.lit(0)) / 2)).cast("bigint")


def classified(kind: Column, n_genes: Column, coding: Column) -> Column:
    """fi, ii, si, ni or ci locus from the kind, the number of genes, and whether any gene codes."""
    return F.when(kind == "fi", "fiLocus").when(kind == "ii", "iiLocus").when(~coding, "niLocus").when(n_genes > 1, "ciLocus").otherwise("siLocus")


def inner_lengths(loci: DataFrame, delta: int = 500) -> DataFrame:
    """seqid, length, orient of what lies between neighbouring loci, 0 where nothing does; NA for each further gene of a locus
    that isn't the first."""
    x = lines.neighbours(loci, ["seqid"], ["start", "end"], ["end", "strand"])
    gap = F.col("start") - F.col("prev_end") - 2 * delta - 1
    between = F.struct(F.when(F.col("prev_end") + 3 * delta >= F.col("start"), 0).otherwise(gap).cast("bigint").alias("length"), orientation(F.col("prev_strand"), F.col("strand")).alias("orient"))
    further = F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("length"), F.lit("NA").alias("orient")), (F.col("n_genes") - 1).cast("int"))
    return x.where("prev_end IS NOT NULL").select("seqid", F.explode(F.concat(F.array(between), further)).alias("r")).select("seqid", "r.*")


def without_genes(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """Sequences without any gene, each as one end locus."""
    return regions.join(genes.select("seqid").distinct(), "seqid", "left_anti").select("seqid", "start", "end", F.lit("fiLocus").alias("ilocus_type"), F.lit(True).alias("unannot"))


def merged_loci(loci: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of neighbouring single-gene and non-coding loci become one merged locus; any other locus ends a run.

    keys, start, end, ilocus_type, n_merged, gene_count, effective_length. A run of one keeps its type.
    """
    can = F.col("ilocus_type").isin("siLocus", "niLocus") & (F.coalesce("iilocus_exception", F.lit("")) != "intron-gene")
    order = ["start", "end", "locus_id"]
    x = loci.withColumn("_can", F.coalesce(can, F.lit(False)))
    x = lines.carried(x, keys, order, ~F.col("_can"), "_stop")
    runs = x.groupBy(*keys, "_can", "_stop").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_merged"), F.min("ilocus_type").alias("_type"),
        F.sum(F.coalesce("n_children", F.lit(0))).cast("bigint").alias("gene_count"), F.sum(F.coalesce("effective_length", F.lit(0))).cast("bigint").alias("effective_length"),
    )
    kind = F.when(F.col("_can") & (F.col("n_merged") > 1), "miLocus").otherwise(F.col("_type"))
    return runs.select(*keys, "start", "end", kind.alias("ilocus_type"), "n_merged", "gene_count", "effective_length")


# refinement

_GENE = "array<struct<start:bigint,end:bigint,gene_id:bigint,cs:bigint,ce:bigint,exons:array<struct<s:bigint,e:bigint>>>>"
_REFINED = (
    "seqid string, locus_start bigint, part int, start bigint, end bigint, n_genes int, ilocus_type string, effective_length bigint, exception string, liil bigint, riil bigint, genes string"
)


def _meets(a: dict, b: dict, by_cds: bool, least: int) -> bool:
    """Whether two genes of one sequence overlap: by full ranges, or by coding ranges if asked for."""
    size = lambda s1, e1, s2, e2: min(e1, e2) - max(s1, s2) + 1
    if by_cds:
        if (a["cs"] is None) != (b["cs"] is None):
            return False
        if a["cs"] is not None and (a["start"], a["end"]) != (b["start"], b["end"]):
            return size(a["cs"], a["ce"], b["cs"], b["ce"]) >= least
    return size(a["start"], a["end"], b["start"], b["end"]) >= least


def bins_of(genes: list[dict], by_cds: bool = True, least: int = 1) -> list[list[dict]]:
    """Greedy bins in order of position: a gene joins the open bin if it overlaps any of its members, else opens the next."""
    bins: list[list[dict]] = []
    for g in sorted(genes, key=lambda g: (g["start"], g["end"], g["gene_id"])):
        if bins and any(_meets(g, o, by_cds, least) for o in bins[-1]):
            bins[-1].append(g)
        else:
            bins.append([g])
    return bins


def in_intron(outer: dict, inner: dict) -> bool:
    """Whether a gene lies within another that has two exons or more, and touches none of them."""
    within = outer["start"] <= inner["start"] and inner["end"] <= outer["end"]
    return within and len(outer["exons"]) >= 2 and not any(x["s"] <= inner["end"] and x["e"] >= inner["start"] for x in outer["exons"])


def refine(row: dict, delta: int = 500, by_cds: bool = True, least: int = 1) -> list[dict]:
    """The loci that an extended locus with several genes falls into, in order of their genes' positions.

    A bin of two genes, the second within an intron of the first, gives a locus each. Loci reach delta beyond their genes but not
    past the locus they come from; the first and the one that ends last close what gaps remain. Effective lengths, and the
    lengths of the stretches left and right (liil, riil), are null where the rules give none.
    """
    S, E, lo, ro = row["start"], row["end"], row["left_overlap"] or 0, row["right_overlap"] or 0
    parts: list[dict] = []
    for b in bins_of(row["genes"], by_cds, least):
        if len(b) == 2 and in_intron(b[0], b[1]):
            parts += [{"genes": [b[0]], "type": "ciLocus"}, {"genes": [b[1]], "exception": "intron-gene"}]
        else:
            parts.append({"genes": b})
    for p in parts:
        p["at"] = min(g["start"] for g in p["genes"]), max(g["end"] for g in p["genes"])
    parts.sort(key=lambda p: (p["at"], p["genes"][0]["gene_id"]))
    for p in parts:
        start, end = p["at"]
        p["start"] = S if S + delta > start else start - delta
        p["end"] = E if end + delta > E else end + delta
        p["coding"] = any(g["cs"] is not None for g in p["genes"])
    n_parts = len(parts)
    first, last = parts[0], max(reversed(parts), key=lambda p: p["end"])
    first["start"], last["end"] = S, E
    first["effective"] = E - S + 1 - -(-lo // 2) - ro // 2
    crowded = f"complex-overlap-{len(row['genes'])}"
    apart = n_parts == 2 and parts[1].get("exception") != "intron-gene"
    if len({p["coding"] for p in parts}) == 1:
        if apart:
            first |= {"exception": "gene-overlap-gene", "riil": 0}
            parts[1]["liil"] = 0
        for p in parts:
            several = p["coding"] and len(p["genes"]) > 1
            if several:
                p["exception"] = crowded
            p.setdefault("type", "niLocus" if not p["coding"] else "ciLocus" if several else "siLocus")
    elif n_parts == 2:
        for p in parts:
            p["type"] = "siLocus" if p["coding"] else "niLocus"
        a, b = parts
        if b["end"] <= a["end"] and a["start"] <= b["start"]:
            b["effective"] = 0
            if apart:
                a |= {"exception": "gene-contain-gene", "liil": row["liil"], "riil": row["riil"]}
                b |= {"liil": 0, "riil": 0}
        else:
            shared = a["end"] - b["start"] + 1
            a["effective"] = a["end"] - a["start"] + 1 - -(-lo // 2) - shared // 2
            b["effective"] = b["end"] - b["start"] + 1 - -(-shared // 2) - ro // 2
            if apart:
                a |= {"exception": "gene-overlap-gene", "liil": row["liil"], "riil": 0}
                b |= {"liil": 0, "riil": row["riil"]}
    else:
        right = max(parts, key=lambda p: p["end"])  # of several that end there, the first
        for p in parts:
            p.setdefault("type", "niLocus" if not p["coding"] else "siLocus" if len(p["genes"]) == 1 else "ciLocus")
            if p is not first:
                p |= {"liil": 0, "riil": row["riil"] if p is right else 0}
        first |= {"exception": crowded, "liil": row["liil"]} | ({"riil": row["riil"]} if first is right else {})
    return parts


def _refiner(delta: int, by_cds: bool, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                for k, p in enumerate(refine(row, delta, by_cds, least), 1):
                    out.append(
                        {"seqid": row["seqid"], "locus_start": row["locus_start"], "part": k, "start": p["start"], "end": p["end"], "n_genes": len(p["genes"]), "ilocus_type": p["type"],
                         "effective_length": p.get("effective"), "exception": p.get("exception"), "liil": p.get("liil"), "riil": p.get("riil"), "genes": ",".join(str(g["gene_id"]) for g in p["genes"])}
                    )
            names = [x.strip().split(" ")[0] for x in _REFINED.split(",")]
            kinds = [pa.string() if x.strip().endswith("string") else pa.int32() if x.strip().endswith(" int") else pa.int64() for x in _REFINED.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names)

    return run


def refined(genes: DataFrame, exons: DataFrame, regions: DataFrame, delta: int = 500, by_cds: bool = True, least: int = 1) -> DataFrame:
    """Loci of two genes and more, refined: one row a resulting locus. The fold over the genes of a locus is sequential; only
    they are gathered, as one array a locus."""
    x = exons.groupBy("gene_id").agg(
        F.min(F.when(F.col("code") == "C", F.col("start"))).alias("cs"), F.max(F.when(F.col("code") == "C", F.col("end"))).alias("ce"), F.sort_array(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))).alias("exons")
    )
    g = genes.join(x, "gene_id", "left").withColumn("exons", F.coalesce("exons", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    of = F.sort_array(F.collect_list(F.struct("start", "end", "gene_id", "cs", "ce", "exons")))
    core = merged(g, genes=F.when(F.count(F.lit(1)) > 1, of))
    rows = extended(core, regions, delta, keep=("genes",)).where("kind = 'gene' AND genes IS NOT NULL")
    return rows.select("seqid", F.col("core_start").alias("locus_start"), "start", "end", "left_overlap", "right_overlap", "liil", "riil", "genes").mapInArrow(_refiner(delta, by_cds, least), _REFINED)
