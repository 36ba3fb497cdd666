"""Per-key results when a few keys hold most rows.

Every input partition folds its rows into a bounded table of mergeable key states before anything is shuffled; a full
table is spilled downstream as partial states and started anew. A key thus costs at most k rows for each spill of each
partition in the shuffle, however many rows it has, and no task ever sees all rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows gathered before they are folded into the table.
FOLD_ROWS = 131_072
#: Rows that a partition's table may hold before it is spilled as partial states.
TABLE_ROWS = 262_144


def _top(t: pa.Table, k: int) -> pa.Table:
    """The first k distinct (order descending, tie ascending) of each key."""
    codes = t["key"].combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    order, tie = t["order"].to_numpy(), t["tie"].to_numpy()
    down = ~order if order.dtype.kind == "i" else -order
    at = np.lexsort((tie, down, codes))
    c, o, i = codes[at], order[at], tie[at]
    if not len(at):
        return t
    fresh = np.ones(len(at), bool)
    fresh[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1]) | (i[1:] != i[:-1])
    at, c = at[fresh], c[fresh]
    first = np.ones(len(at), bool)
    first[1:] = c[1:] != c[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    return t.take(pa.array(np.sort(at[np.arange(len(at)) - begin < k])))


def _folder(k: int, fold_rows: int, table_rows: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, table = [], 0, None
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < fold_rows:
                continue
            t = pa.Table.from_batches(held)
            table = _top(pa.concat_tables([table, t]) if table is not None else t, k)
            held, rows = [], 0
            if table.num_rows > table_rows:
                yield from table.to_batches()
                table = None
        parts = ([table] if table is not None else []) + ([pa.Table.from_batches(held)] if held else [])
        if parts:
            yield from _top(pa.concat_tables(parts), k).to_batches()

    return fold


def top_k_per_key(df: DataFrame, key: str, order: str, tie: str, k: int, *, fold_rows: int = FOLD_ROWS, table_rows: int = TABLE_ROWS) -> DataFrame:
    """For each non-null key the k greatest ``order``, ties going to the smaller ``tie``: columns key, tie.

    ``order`` is numeric and ``tie`` integral. Rows with a null in any of the three don't compete, nor does NaN. Rows
    alike in all three count once. A key with fewer than k candidates gives them all; an empty table gives none. Columns
    besides these three are never read, so clashing names do no harm.
    """
    kind = dict(df.dtypes)[order]
    num = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "double"
    slim = df.select(F.col(key).alias("key"), F.col(order).cast(num).alias("order"), F.col(tie).cast("bigint").alias("tie")).where(
        F.col("key").isNotNull() & F.col("order").isNotNull() & F.col("tie").isNotNull()
    )
    if num == "double":
        slim = slim.where(~F.isnan("order"))
    partial = slim.mapInArrow(_folder(k, fold_rows, table_rows), slim.schema)
    # the states of the partitions are merged; duplicates that met in no partition go first, and Spark's
    # window group limit keeps k rows a key on the map side of the last exchange
    w = Window.partitionBy("key").orderBy(F.col("order").desc(), F.col("tie"))
    merged = partial.distinct().withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return merged.select(F.col("key").alias(key), F.col("tie").alias(tie))


def rollup_per_key(df: DataFrame, key: str | list[str], **aggregates: Column) -> DataFrame:
    """Algebraic aggregates (count, sum, min, max, bit_or and the like) of each key, combined before the shuffle.

    Spark's hash aggregate holds a bounded table for each task, falls back to sorted runs when it is full, and shuffles one
    state a key and task. Rows with a null key are left out.
    """
    keys = [key] if isinstance(key, str) else key
    for c in keys:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
