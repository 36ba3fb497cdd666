"""Continuous periods and gaps of overlapping, nested, touching or separate integer intervals, by dyadic blocks.

Positions are doubled, so that a base p is the block [2p, 2p+1): intervals that share a base cover a common position, while
intervals that only touch leave the odd position between them free. The line of each key is cut into cells of 2**CELL
doubled positions. Within a cell, every piece is decomposed into its canonical dyadic blocks; blocks covered by an ancestor
are removed, sibling pairs are merged upward, and adjacent blocks are joined to runs. Each interval weighs one on one of its
blocks; weights move with the blocks, so that a run knows how many intervals made it. The operation is idempotent and
mergeable: it runs on each partition before the shuffle, and once more on each cell. What crosses cells is settled on one
row a cell, never on all rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Levels of a cell: 2**21 doubled positions, about a million bases.
CELL = 21
#: Rows that are folded at once.
FOLD_ROWS = 200_000


def blocks_of(a: np.ndarray, b: np.ndarray, w: np.ndarray, top: int = CELL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical dyadic blocks (start, level, weight) of half-open [a, b); the first block of an interval bears its weight."""
    starts, levels, weights = [], [], []
    lo, hi, left = a.copy(), b.copy(), w.copy()
    for level in range(top + 1):
        if not len(lo):
            break
        last = level == top
        for odd, at in ((((lo & 1) == 1) | last, "lo"), (((hi & 1) == 1) & ~np.bool_(last), "hi")):
            take = odd & (lo < hi)
            x = lo[take] if at == "lo" else hi[take] - 1
            starts.append(x << level)
            levels.append(np.full(len(x), level, np.int64))
            weights.append(left[take])
            left[take] = 0
            if at == "lo":
                lo = lo + take
            else:
                hi = hi - take
        keep = lo < hi
        lo, hi, left = lo[keep] >> 1, hi[keep] >> 1, left[keep]
    return np.concatenate(starts), np.concatenate(levels), np.concatenate(weights)


def runs_of(a: np.ndarray, b: np.ndarray, w: np.ndarray, top: int = CELL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, end, weight) of the union of half-open intervals of one line, none of which crosses a cell."""
    if not len(a):
        return a, b, w
    s, level, wt = blocks_of(a, b, w, top)
    # preorder of the dyadic tree: an ancestor comes before what it covers
    at = np.lexsort((-level, s))
    s, level, wt = s[at], level[at], wt[at]
    e = s + (np.int64(1) << level)
    reach = np.maximum.accumulate(e)
    kept = np.ones(len(s), bool)
    kept[1:] = e[1:] > reach[:-1]
    owner = np.cumsum(kept) - 1
    wt = np.bincount(owner, weights=wt).astype(np.int64)
    s, level = s[kept], level[kept]
    # siblings that are both there become their parent, level by level
    done_s, done_l, done_w = [], [], []
    up_s, up_w = s[:0], wt[:0]
    for k in range(top + 1):
        here = level == k
        cs, cw = np.concatenate([s[here], up_s]), np.concatenate([wt[here], up_w])
        at = np.argsort(cs, kind="stable")
        cs, cw = cs[at], cw[at]
        if k == top or not len(cs):
            done_s.append(cs), done_l.append(np.full(len(cs), k, np.int64)), done_w.append(cw)
            up_s, up_w = cs[:0], cw[:0]
            continue
        first = np.zeros(len(cs), bool)
        first[:-1] = (((cs[:-1] >> k) & 1) == 0) & (cs[1:] == cs[:-1] + (1 << k))
        second = np.zeros(len(cs), bool)
        second[1:] = first[:-1]
        up_s, up_w = cs[first], cw[first] + cw[second]
        alone = ~first & ~second
        done_s.append(cs[alone]), done_l.append(np.full(int(alone.sum()), k, np.int64)), done_w.append(cw[alone])
    s, level, wt = np.concatenate(done_s), np.concatenate(done_l), np.concatenate(done_w)
    at = np.argsort(s, kind="stable")
    s, e, wt = s[at], (s + (np.int64(1) << level))[at], wt[at]
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != e[:-1]
    begin = np.flatnonzero(fresh)
    return s[begin], e[np.append(begin[1:], len(s)) - 1], np.add.reduceat(wt, begin)


def _codes(t: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Dense group codes in order of first appearance, and a row of each group."""
    code = np.zeros(t.num_rows, np.int64)
    for n in names:
        d = t[n].combine_chunks()
        if pa.types.is_integer(d.type):
            x = np.unique(d.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        else:
            d = d.dictionary_encode(null_encoding="encode")
            d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
            x = d.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code * (int(x.max(initial=0)) + 1) + x, return_inverse=True)[1]
    first = np.full(int(code.max(initial=-1)) + 1, t.num_rows, np.int64)
    np.minimum.at(first, code, np.arange(t.num_rows))
    return code, first


def _fold(t: pa.Table, keys: list[str]) -> pa.Table:
    """Runs of each key and cell of a table of pieces (relative a, b and weight)."""
    code, first = _codes(t, [*keys, "cell"])
    base = code << (CELL + 1)  # an empty cell between neighbours: no run crosses groups
    a, b, w = runs_of(base + t["a"].to_numpy(), base + t["b"].to_numpy(), t["w"].to_numpy())
    g = a >> (CELL + 1)
    rows = t.select([*keys, "cell"]).take(pa.array(first[g]))
    for n, x in (("a", a - (g << (CELL + 1))), ("b", b - (g << (CELL + 1))), ("w", w)):
        rows = rows.append_column(n, pa.array(x, pa.int64()))
    return rows


def _local(keys: list[str], fold_rows: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= fold_rows:
                yield from _fold(pa.Table.from_batches(held), keys).to_batches()
                held, rows = [], 0
        if rows:
            yield from _fold(pa.Table.from_batches(held), keys).to_batches()

    return fold


def _settle(t: pa.Table, keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What whole cells give: inner periods and gaps, runs at an edge, and the ends of each cell."""
    r = _fold(t, keys)
    cell, a, b, w = (r[c].to_numpy() for c in ("cell", "a", "b", "w"))
    n = len(a)
    if not n:
        return
    code, _ = _codes(r, [*keys, "cell"])
    size, base = np.int64(1) << CELL, cell << CELL
    edge = (a == 0) | (b == size)
    same = np.zeros(n, bool)
    same[1:] = code[1:] == code[:-1]
    last = np.append(~same[1:], True)
    first = np.flatnonzero(~same)
    parts = [
        ("edge", np.flatnonzero(edge), base + a, base + b, w),
        ("period", np.flatnonzero(~edge & (w >= 2)), base + a, base + b, w),
        ("gap", np.flatnonzero(same), np.append(0, (base + b)[:-1]), base + a, w),
    ]
    ends = np.zeros(n, np.int64)
    ends[first] = (base + b)[np.flatnonzero(last)]
    parts.append(("cell", first, base + a, ends, w))
    for tag, at, x, y, z in parts:
        if len(at):
            k = r.select(keys).take(pa.array(at))
            yield from pa.Table.from_arrays([*k.columns, pa.array([tag] * len(at), pa.string()), pa.array(x[at]), pa.array(y[at]), pa.array(z[at])], schema=schema).to_batches()


def _cells(keys: list[str], schema: pa.Schema, fold_rows: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < fold_rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            # rows are sorted by key and cell: all but the last cell are whole
            end = t.slice(t.num_rows - 1).to_pylist()[0]
            lo, hi = 0, t.num_rows - 1
            while lo < hi:
                mid = (lo + hi) // 2
                row = t.slice(mid, 1)
                if all(row[c][0].as_py() == end[c] for c in [*keys, "cell"]):
                    hi = mid
                else:
                    lo = mid + 1
            if lo:
                yield from _settle(t.slice(0, lo), keys, schema)
                held = t.slice(lo).to_batches()
            else:
                held = _fold(t, keys).to_batches()  # one busy cell: its runs are bounded by its positions
            rows = sum(x.num_rows for x in held)
        if rows:
            yield from _settle(pa.Table.from_batches(held), keys, schema)

    return settle


def periods_and_gaps(df: DataFrame, keys: list[str], ident: str, start: str, end: str, *, least: int = 2, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Periods of two or more intervals and the gaps between neighbouring periods: keys, kind, start, end.

    ``start`` and ``end`` are closed. Repeated rows (same keys, ``ident``, start and end) count once. Rows with start or end
    missing, start beyond end, or a null in the last key are left out; a null in another key is a group of its own. A gap is a
    stretch of at least one position that no interval covers between two that are covered; periods of one interval bound gaps
    but are not listed. Only the columns named are read.
    """
    if least != 2:
        raise ValueError("periods are listed from two intervals on")
    one = df.select(*keys, F.col(ident).alias("_i"), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
    one = one.where(F.col(keys[-1]).isNotNull() & (F.col("_s") <= F.col("_e"))).distinct()
    size = 1 << CELL
    a, b = F.col("_s") * 2, F.col("_e") * 2 + 1
    pieces = one.select(*keys, a.alias("_a"), b.alias("_b"), F.explode(F.sequence(F.shiftright(a, CELL), F.shiftright(b - 1, CELL))).alias("cell")).select(
        *keys,
        "cell",
        F.greatest(F.col("_a") - F.col("cell") * size, F.lit(0)).cast("bigint").alias("a"),
        F.least(F.col("_b") - F.col("cell") * size, F.lit(size)).cast("bigint").alias("b"),
        F.when(F.shiftright("_a", CELL) == F.col("cell"), 1).otherwise(0).cast("bigint").alias("w"),
    )
    runs = pieces.mapInArrow(_local(keys, fold_rows), pieces.schema)
    types = {f.name: f.dataType for f in pieces.schema.fields}
    out = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField("kind", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("a", "b", "w")])
    settled = runs.repartition(*keys, "cell").sortWithinPartitions(*keys, "cell").mapInArrow(_cells(keys, to_arrow_schema(out), fold_rows), out)
    final = settled.where(F.col("kind").isin("period", "gap")).select(*keys, "kind", "a", "b")
    # one row a cell and at most two runs at its edges: few, whatever the number of intervals
    # (both kinds go through one window and one aggregate, so that the cells are settled twice at most)
    w = Window.partitionBy(*keys, "kind").orderBy("a", "b")
    few = settled.where(F.col("kind").isin("edge", "cell")).withColumn("_before", F.lag("b").over(w))
    few = few.withColumn("_n", F.sum(F.when(F.col("a") == F.col("_before"), 0).otherwise(1)).over(w))
    runs = few.groupBy(*keys, "kind", "_n").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("w").alias("w"), F.min("_before").alias("_before"))
    crossing = runs.where(F.when(F.col("kind") == "edge", F.col("w") >= 2).otherwise(F.col("_before") < F.col("a"))).select(
        *keys,
        F.when(F.col("kind") == "edge", "period").otherwise("gap").alias("kind"),
        F.when(F.col("kind") == "edge", F.col("a")).otherwise(F.col("_before")).alias("a"),
        F.when(F.col("kind") == "edge", F.col("b")).otherwise(F.col("a")).alias("b"),
    )
    everything = final.unionByName(crossing)
    s = F.expr("CASE WHEN kind = 'gap' THEN shiftright(a + 1, 1) ELSE shiftright(a, 1) END").alias("start")
    e = F.expr("CASE WHEN kind = 'gap' THEN shiftright(b, 1) - 1 ELSE shiftright(b - 1, 1) END").alias("end")
    return everything.select(*keys, "kind", s, e).where(F.col("start") <= F.col("end"))
