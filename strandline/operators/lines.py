"""Windows along a line of positions that don't put a whole line into one task.

A line (the rows of one key, by position) is cut into cells. Windows run within cells; what passes from one cell to the next
is settled on one summary row a cell. A busy key is thus spread over as many tasks as it has cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a cell.
CELL = 1 << 20


def _cell(start: str, cell: int) -> Column:
    return F.floor(F.col(start) / cell).cast("bigint")


def islands(df: DataFrame, keys: list[str], start: str, end: str, *, cell: int = CELL, into: str = "island", ties: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds ``into``: the start of the run of transitively overlapping closed intervals that each row belongs to.

    Touching intervals are apart. Rows with a null start or end get none.
    """
    w = Window.partitionBy(*keys, "_cell").orderBy(start, end, *ties)
    df = df.withColumn("_cell", _cell(start, cell))
    summary = df.groupBy(*keys, "_cell").agg(F.max(end).alias("_reach"))
    over = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*keys, "_cell", F.max("_reach").over(over).alias("_before"))
    df = df.join(summary, [*keys, "_cell"], "left")
    reach = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    df = df.withColumn("_first", F.when(reach.isNull() | (F.col(start) > reach), F.col(start)))
    firsts = df.groupBy(*keys, "_cell").agg(F.max("_first").alias("_f")).select(*keys, "_cell", F.max("_f").over(over).alias("_carried"))
    df = df.join(firsts, [*keys, "_cell"], "left")
    here = F.max("_first").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(into, F.coalesce(here, "_carried")).drop("_cell", "_before", "_first", "_carried")


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str], *, cell: int = CELL) -> DataFrame:
    """Adds for each of ``columns`` prev_ and next_: its value in the row before and after, by ``order``, within the keys.

    The first of ``order`` is the position.
    """
    df = df.withColumn("_cell", _cell(order[0], cell))
    w = Window.partitionBy(*keys, "_cell").orderBy(*order)
    everything = F.struct(*order, *[c for c in columns if c not in order])
    summary = df.groupBy(*keys, "_cell").agg(F.min(everything).alias("_lo"), F.max(everything).alias("_hi"))
    over = Window.partitionBy(*keys).orderBy("_cell")
    summary = summary.select(*keys, "_cell", F.lag("_hi").over(over).alias("_p"), F.lead("_lo").over(over).alias("_n"))
    df = df.join(summary, [*keys, "_cell"], "left")
    mark = df.withColumn("_k", F.row_number().over(w)).withColumn("_lead", F.lead(F.lit(1)).over(w))
    for c in columns:
        mark = mark.withColumn(f"prev_{c}", F.when(F.col("_k") > 1, F.lag(c).over(w)).otherwise(F.col(f"_p.{c}")))
        mark = mark.withColumn(f"next_{c}", F.when(F.col("_lead").isNotNull(), F.lead(c).over(w)).otherwise(F.col(f"_n.{c}")))
    return mark.drop("_cell", "_p", "_n", "_k", "_lead")


def numbered(df: DataFrame, group: list[str], order: list[str], into: str = "serial", *, cell: int = CELL, position: str = "start") -> DataFrame:
    """Adds a running number over all rows, by ``group`` and then ``order``: numbers within cells, and offsets of the cells."""
    df = df.withColumn("_cell", _cell(position, cell))
    counts = df.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    per = counts.groupBy(*group).agg(F.sum("_n").alias("_all"))
    groups = per.select(*group, (F.sum("_all").over(Window.orderBy(*group)) - F.col("_all")).alias("_off"))
    within = counts.select(*group, "_cell", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_cell")) - F.col("_n")).alias("_in"))
    offsets = within.join(groups, group).select(*group, "_cell", (F.col("_off") + F.col("_in")).alias("_at"))
    w = Window.partitionBy(*group, "_cell").orderBy(*order)
    return df.join(offsets, [*group, "_cell"]).withColumn(into, (F.col("_at") + F.row_number().over(w)).cast("bigint")).drop("_cell", "_at")


def carried(df: DataFrame, keys: list[str], order: list[str], mark: Column, into: str, *, cell: int = CELL) -> DataFrame:
    """Adds ``into``: the place (a struct of ``order``) of the last row up to this one for which ``mark`` is true."""
    df = df.withColumn("_cell", _cell(order[0], cell)).withColumn("_m", F.when(mark, F.struct(*order)))
    over = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*keys, "_cell").agg(F.max("_m").alias("_f")).select(*keys, "_cell", F.max("_f").over(over).alias("_c"))
    w = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(summary, [*keys, "_cell"], "left").withColumn(into, F.coalesce(F.max("_m").over(w), "_c")).drop("_cell", "_m", "_c")
