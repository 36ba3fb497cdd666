"""Comparison of two annotations of the same genes: segments, confusion counts, structures, statistics, classes.

Model vectors are kept run-length encoded: segments of one code each, never single bases. C is coding, F and T are 5' and 3'
untranslated, I is an intron, and what no segment covers is G.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(parts: DataFrame, key: str = "gene_id") -> DataFrame:
    """key, start, end, code: parts of one code that adjoin are one segment; the gaps between exons are introns."""
    w = Window.partitionBy(key).orderBy("start", "end")
    x = parts.select(key, "start", "end", "code").withColumn("_e", F.lag("end").over(w)).withColumn("_c", F.lag("code").over(w))
    x = x.withColumn("_i", F.sum(F.when((F.col("_e") + 1 == F.col("start")) & (F.col("_c") == F.col("code")), 0).otherwise(1)).over(w))
    runs = x.groupBy(key, "_i", "code").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")
    gaps = x.where(F.col("start") > F.col("_e") + 1).select(key, F.lit("I").alias("code"), (F.col("_e") + 1).alias("start"), (F.col("start") - 1).alias("end"))
    return runs.unionByName(gaps)


def confusion(spans: DataFrame, refr: DataFrame, pred: DataFrame, key: str = "gene_id") -> DataFrame:
    """Per-base counts of each key: length, cds and utr tp, fn, fp, tn, and the bases on which both codes agree.

    Only overlapping pairs of segments are measured; everything with G follows from the lengths.
    """
    r = segments(refr, key)
    p = segments(pred, key).select(key, F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("code").alias("pc"))
    n = F.least("end", "pe") - F.greatest("start", "ps") + 1
    both = r.join(p, key).withColumn("n", n).where("n > 0")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    utr = lambda c: F.col(c).isin("F", "T")
    b = both.groupBy(key).agg(of((F.col("code") == "C") & (F.col("pc") == "C")).alias("cc"), of(utr("code") & utr("pc")).alias("uu"), of(F.col("code") == F.col("pc")).alias("same"), F.sum("n").alias("any"))
    size = lambda df, tag: df.withColumn("n", F.col("end") - F.col("start") + 1).groupBy(key).agg(of(F.col("code") == "C").alias(f"{tag}c"), of(utr("code")).alias(f"{tag}u"), F.sum("n").alias(f"{tag}n"))
    x = spans.join(b, key, "left").join(size(r, "r"), key, "left").join(size(p.select(key, F.col("ps").alias("start"), F.col("pe").alias("end"), F.col("pc").alias("code")), "p"), key, "left")
    x = x.na.fill(0, ["cc", "uu", "same", "any", "rc", "ru", "rn", "pc", "pu", "pn"])
    c = F.col
    out = x.select(
        key, "length", c("cc").alias("cds_tp"), (c("rc") - c("cc")).alias("cds_fn"), (c("pc") - c("cc")).alias("cds_fp"), (c("length") - c("rc") - c("pc") + c("cc")).alias("cds_tn"),
        c("uu").alias("utr_tp"), (c("ru") - c("uu")).alias("utr_fn"), (c("pu") - c("uu")).alias("utr_fp"), (c("length") - c("ru") - c("pu") + c("uu")).alias("utr_tn"),
        (c("same") + c("length") - c("rn") - c("pn") + c("any")).alias("matches"),
    )
    return out


def _blocks(parts: DataFrame, codes: list[str], key: str) -> DataFrame:
    """Runs of any of the codes, as ranges."""
    w = Window.partitionBy(key).orderBy("start", "end")
    x = parts.where(F.col("code").isin(*codes)).select(key, "start", "end").withColumn("_e", F.lag("end").over(w))
    x = x.withColumn("_i", F.sum(F.when(F.col("_e") + 1 == F.col("start"), 0).otherwise(1)).over(w))
    return x.groupBy(key, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def structures(spans: DataFrame, refr: DataFrame, pred: DataFrame, key: str = "gene_id") -> DataFrame:
    """Correct, missing and wrong structures of each kind: only exactly equal ranges are correct."""
    kinds = {"cds": ["C"], "exon": ["C", "F", "T"], "utr": ["F", "T"]}
    tagged = [
        _blocks(parts, codes, key).select(key, F.lit(kind).alias("_k"), "start", "end", F.lit(side).alias("_s"))
        for kind, codes in kinds.items() for parts, side in ((refr, "r"), (pred, "p"))
    ]
    # a full outer join of both sides, as one aggregate: a range that only one side has is missing or wrong
    both = reduce(DataFrame.unionByName, tagged).groupBy(key, "_k", "start", "end").agg(F.bool_or(F.col("_s") == "r").alias("_r"), F.bool_or(F.col("_s") == "p").alias("_p"))
    r, p = F.col("_r"), F.col("_p")
    n = both.groupBy(key).agg(
        *[F.count_if((F.col("_k") == k) & hit).alias(f"{k}_{name}") for k in kinds for name, hit in (("correct", r & p), ("missing", ~p), ("wrong", ~r))]
    )
    return spans.select(key).join(n, key, "left").na.fill(0)


def binary(correct: Column, missing: Column, wrong: Column) -> dict[str, Column]:
    """Sensitivity, specificity (which here is precision), F1 and edit distance; null where undefined."""
    c, m, w = (x.cast("double") for x in (correct, missing, wrong))
    sn, sp = F.try_divide(c, c + m), F.try_divide(c, c + w)
    return {"sn": sn, "sp": sp, "f1": F.try_divide(2 * sn * sp, sn + sp), "ed": 1 - (sn + sp) / 2}


def scaled(tp: Column, fn: Column, fp: Column, tn: Column) -> dict[str, Column]:
    """Matching and correlation coefficients, sensitivity, specificity (precision), F1 and edit distance; null where undefined."""
    a, b, c, d = (x.cast("double") for x in (tp, fn, fp, tn))
    sn, sp = F.try_divide(a, a + b), F.try_divide(a, a + c)
    cc = F.try_divide(a * d - b * c, F.sqrt((a + b) * (d + c) * (a + c) * (d + b)))
    return {"mc": F.try_divide(a + d, a + b + c + d), "cc": cc, "sn": sn, "sp": sp, "f1": F.try_divide(2 * sn * sp, sn + sp), "ed": 1 - (sn + sp) / 2}


def tolerance(length: Column) -> Column:
    """The largest power of ten that is at most 1 / length."""
    return F.pow(F.lit(10.0), -F.ceil(F.log10(length.cast("double"))))


def classified() -> Column:
    """Class of a pair from its counts; perfect is decided on whole bases."""
    ok = lambda k: (F.col(f"{k}_missing") == 0) & (F.col(f"{k}_wrong") == 0)
    some_utr = (F.col("utr_correct") + F.col("utr_missing") + F.col("utr_wrong")) > 0
    return (
        F.when(F.col("matches") == F.col("length"), "perfect").when(ok("cds") & ok("exon"), "mislabeled").when(ok("cds"), "CDS match").when(ok("exon"), "exon match")
        .when(ok("utr") & some_utr, "UTR match").otherwise("non-match")
    )


# cliques


def cliques(transcripts: list[tuple[int, int, int]]) -> list[list[int]]:
    """Every transcript alone, and every largest possible set of two or more that don't overlap: (id, start, end) to ids.

    Ranges in order of their ends; each set is grown to the right by a range that leaves no room for another in between.
    """
    ts = sorted(transcripts, key=lambda t: (t[1], t[2], t[0]))
    n = len(ts)
    found = [[t[0]] for t in ts]

    def grow(picked: list[int], end: int) -> None:
        after = [k for k in range(n) if ts[k][1] > end]
        if not after:
            if len(picked) > 1:
                found.append([ts[k][0] for k in picked])
            return
        first = min(ts[k][2] for k in after)
        for k in after:  # one that begins past the first end would leave room for it
            if ts[k][1] <= first:
                grow([*picked, k], ts[k][2])

    if n > 1:
        grow([], -(1 << 62))
    return found


_PAIRS = "locus string, refr string, pred string, n_matches bigint, length bigint, rank int, kind string"


def _code_at(parts: list[dict], lo: int, hi: int) -> list[tuple[int, int, str]]:
    out, at = [], None
    for p in sorted(parts, key=lambda p: (p["start"], p["end"])):
        if at is not None and p["start"] > at + 1:
            out.append((at + 1, p["start"] - 1, "I"))
        out.append((p["start"], p["end"], p["code"]))
        at = p["end"]
    return out


def _laid(segs: list[tuple[int, int, str]], lo: int, hi: int) -> list[tuple[int, int, str]]:
    """Segments in order, within lo..hi and disjoint: of two on the same bases the first stands."""
    out: list[tuple[int, int, str]] = []
    at = lo - 1
    for s, e, c in sorted(segs):
        s, e = max(s, at + 1), min(e, hi)
        if s <= e:
            out.append((s, e, c))
            at = e
    return out


def _runs(segs: list[tuple[int, int, str]], codes: str) -> list[tuple[int, int]]:
    """Runs of any of the codes, as ranges; segments that adjoin are one run."""
    out: list[tuple[int, int]] = []
    for s, e, c in segs:
        if c in codes:
            if out and out[-1][1] + 1 == s:
                out[-1] = (out[-1][0], e)
            else:
                out.append((s, e))
    return out


def _cc(tp: int, r: int, p: int, length: int) -> float | None:
    """Correlation coefficient of r and p bases of a code, tp of them shared; None where undefined."""
    under = r * (length - p) * p * (length - r)
    return (tp * (length - r - p + tp) - (r - tp) * (p - tp)) / math.sqrt(under) if under else None


def _alike(values: list[float | None], within: float) -> list[int]:
    """The place of each value, highest first and undefined ones last; values closer than ``within`` to their neighbour share one.

    Where being that close is transitive, this is the reference's order; elsewhere the reference has none.
    """
    order = sorted({-2.0 if v is None else v for v in values}, reverse=True)
    place, n = {}, 0
    for k, v in enumerate(order):
        n += k > 0 and not order[k - 1] - v < within
        place[v] = n
    return [place[-2.0 if v is None else v] for v in values]


def _by_place(pairs: list[dict], heads: tuple[str, ...], value: str, to: str, within: float) -> None:
    """Sets ``to``: places of the values among the pairs with equal heads."""
    groups: dict[tuple, list[dict]] = {}
    for x in pairs:
        groups.setdefault(tuple(x[h] for h in heads), []).append(x)
    for group in groups.values():
        for x, n in zip(group, _alike([x[value] for x in group], within)):
            x[to] = n


def _sides(row: dict) -> list[dict[tuple[int, ...], list[tuple[int, int, str]]]]:
    """The cliques of both sides with their segments: ids to segments."""
    lo, hi = row["start"], row["end"]
    sides = []
    for side in ("refr", "pred"):
        by: dict[int, list[dict]] = {}
        for p in row[side] or []:
            by.setdefault(p["gene_id"], []).append(p)
        ranges = [(g, min(p["start"] for p in ps), max(p["end"] for p in ps)) for g, ps in by.items()]
        segs = {}
        for clique in cliques(ranges):
            segs[tuple(sorted(clique))] = _laid([s for g in clique for s in _code_at(by[g], lo, hi)], lo, hi)
        sides.append(segs)
    return sides


def _shared(a: list[tuple[int, int, str]], b: list[tuple[int, int, str]]) -> tuple[int, int, int, int]:
    """Bases that two lists of disjoint segments in order both cover: any, of the same code, both coding, both untranslated."""
    i = j = both = same = cds = utr = 0
    while i < len(a) and j < len(b):
        n = min(a[i][1], b[j][1]) - max(a[i][0], b[j][0]) + 1
        if n > 0:
            c, d = a[i][2], b[j][2]
            both, same, cds, utr = both + n, same + n * (c == d), cds + n * (c == d == "C"), utr + n * (c in "FT" and d in "FT")
        if a[i][1] <= b[j][1]:
            i += 1
        else:
            j += 1
    return both, same, cds, utr


def _ordered(sides: list[dict[tuple[int, ...], list[tuple[int, int, str]]]], length: int) -> list[dict]:
    """All pairs of cliques, best first: perfect, then CDS structure match, exon structure match, CDS correlation, UTR correlation
    and identity. Undefined correlations come last; those that differ by less than the tolerance of the locus count as equal.
    Pairs that are alike in all of these come by the number of their transcripts, then by ids."""
    of = lambda segs, codes: sum(e - s + 1 for s, e, c in segs if c in codes)
    told = [{k: (v, _runs(v, "C"), _runs(v, "CFT"), of(v, "C"), of(v, "FT"), of(v, "CFTI")) for k, v in side.items()} for side in sides]
    pairs = []
    for r, (a, r_cds, r_exons, rc, ru, rn) in told[0].items():
        for p, (b, p_cds, p_exons, pc, pu, pn) in told[1].items():
            both, same, cds, utr = _shared(a, b)
            n = same + length - rn - pn + both
            pairs.append({
                "refr": r, "pred": p, "n_matches": n, "perfect": n == length, "cds_match": r_cds == p_cds, "exon_match": r_exons == p_exons,
                "cds_cc": _cc(cds, rc, pc, length), "utr_cc": _cc(utr, ru, pu, length),
            })
    # perfect pairs are alike in the reference, whatever else they share
    for x in pairs:
        x["_head"] = (0,) if x["perfect"] else (1, not x["cds_match"], not x["exon_match"])
    within = 1.0
    while within > 1 / length:
        within /= 10
    _by_place(pairs, ("_head",), "cds_cc", "_cds", within)
    _by_place(pairs, ("_head", "_cds"), "utr_cc", "_utr", within)
    return sorted(pairs, key=lambda x: (x["_head"], *(() if x["perfect"] else (x["_cds"], x["_utr"], -x["n_matches"])), -len(x["refr"]) - len(x["pred"]), x["refr"], x["pred"]))


def pairs_of(row: dict) -> list[dict]:
    """Pairs of cliques of one locus, best first; each transcript is taken once, what is left over is unique to its side."""
    lo, hi = row["start"], row["end"]
    sides = _sides(row)
    used_r: set[int] = set()
    used_p: set[int] = set()
    out = []
    name = lambda c: ",".join(map(str, c))
    for x in _ordered(sides, hi - lo + 1):
        r, p = x["refr"], x["pred"]
        if used_r.isdisjoint(r) and used_p.isdisjoint(p):
            used_r |= set(r)
            used_p |= set(p)
            out.append({"refr": name(r), "pred": name(p), "n_matches": x["n_matches"], "kind": "pair"})
    left = lambda segs, used: [c for c in segs if len(c) == 1 and used.isdisjoint(c)]
    out += [{"refr": name(c), "pred": None, "n_matches": None, "kind": "unique-refr"} for c in left(sides[0], used_r)]
    out += [{"refr": None, "pred": name(c), "n_matches": None, "kind": "unique-pred"} for c in left(sides[1], used_p)]
    for k, o in enumerate(out, 1):
        o |= {"locus": row["locus"], "length": hi - lo + 1, "rank": k}
    return out


def _each(f, names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [o for row in b.to_pylist() for o in f(row)]
            yield pa.RecordBatch.from_arrays([pa.array([o.get(n) for o in out], k) for n, k in zip(names, kinds)], names)

    return run


#: Transcripts of a locus up to which its cliques are enumerated, unless another number is given; their number grows exponentially.
MAX_TRANSCRIPTS = 32


def _few(f, most: int):
    """The rows that ``f`` gives for a locus, or one row that says it was skipped if it has more than ``most`` transcripts."""
    return lambda row: [{"locus": row["locus"], "length": row["end"] - row["start"] + 1, "kind": "skipped", "skipped": True}] if most and row["n"] > most else f(row)


def selected_pairs(loci: DataFrame, most: int = MAX_TRANSCRIPTS) -> DataFrame:
    """loci: locus, n (transcripts), start, end, refr and pred (arrays of parts with gene_id, start, end, code); one row a
    reported pair. A locus of more than ``most`` transcripts gives one row of kind ``skipped``; 0 compares all loci."""
    names = [x.strip().split(" ")[0] for x in _PAIRS.split(",")]
    kinds = [pa.string() if x.strip().endswith("string") else pa.int32() if x.strip().endswith(" int") else pa.int64() for x in _PAIRS.split(",")]
    return loci.mapInArrow(_each(_few(pairs_of, most), names, kinds), _PAIRS)


_RANKED = {"locus": "string", "refr": "string", "pred": "string", "perfect": "boolean", "cds_match": "boolean", "exon_match": "boolean", "cds_cc": "double", "utr_cc": "double", "n_matches": "bigint", "length": "bigint", "rank": "int", "skipped": "boolean"}


def ranked_pairs(loci: DataFrame, most: int = MAX_TRANSCRIPTS) -> DataFrame:
    """loci as for selected_pairs; every pair of cliques of a locus with what it is ranked by, and its rank in the locus."""

    def rows(row: dict) -> list[dict]:
        length = row["end"] - row["start"] + 1
        name = lambda c: ",".join(map(str, c))
        return [x | {"locus": row["locus"], "refr": name(x["refr"]), "pred": name(x["pred"]), "length": length, "rank": k, "skipped": False} for k, x in enumerate(_ordered(_sides(row), length), 1)]

    kinds = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
    return loci.mapInArrow(_each(_few(rows, most), list(_RANKED), [kinds[t] for t in _RANKED.values()]), ", ".join(f"{n} {t}" for n, t in _RANKED.items()))


_CLIQUES = {"locus": pa.string(), "size": pa.int32(), "ids": pa.string(), "num_exons": pa.int64(), "num_utrs": pa.int64(), "cds_length": pa.int64(), "skipped": pa.bool_()}


def enumerated(loci: DataFrame, most: int = MAX_TRANSCRIPTS) -> DataFrame:
    """locus, transcripts (array of gene_id, start, end, n_exons, n_utrs, cds_length): one row a clique, with its size, its ids,
    and the exons, UTR segments and coding bases of all its transcripts. Of a locus with more than ``most`` transcripts (0: no
    limit) only the single transcripts come out, marked as skipped."""

    def rows(row: dict) -> list[dict]:
        by = {t["gene_id"]: t for t in row["transcripts"]}
        skipped = bool(most) and len(by) > most
        found = [[i] for i in by] if skipped else cliques([(t["gene_id"], t["start"], t["end"]) for t in by.values()])
        total = lambda c, k: sum(by[i][k] or 0 for i in c)
        return [
            {"locus": row["locus"], "size": len(c), "ids": ",".join(map(str, sorted(c))), "num_exons": total(c, "n_exons"), "num_utrs": total(c, "n_utrs"), "cds_length": total(c, "cds_length"), "skipped": skipped}
            for c in found
        ]

    kinds = "locus string, size int, ids string, num_exons bigint, num_utrs bigint, cds_length bigint, skipped boolean"
    return loci.mapInArrow(_each(rows, list(_CLIQUES), list(_CLIQUES.values())), kinds)
