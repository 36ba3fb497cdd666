"""Several values packed in one field, one value a row with its position.

A parsing expression grammar with ordered alternatives reads each field left to right::

    field  <- sep* (value sep*)* end
    value  <- quoted / bracketed / bare
    quoted <- '"' [^"]* '"' / "'" [^']* "'"
    bracketed <- '[' [^]]* ']'
    bare   <- [^ sep]+

A quote or bracket without its partner makes its alternative fail; the parser backtracks to that place and takes the bare
alternative, which keeps the mark and flags the value. Where brackets mean nothing, their alternative is left out. ``values_of`` is the same grammar as a native column expression,
for operators that need the values of a whole table and not their flags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate values: blank, tab and the four marks.
SEPARATORS = " \t,;|/"
#: What is flagged: a quote or bracket that was opened and never closed.
UNCLOSED = "unclosed"


@lru_cache(maxsize=64)
def _grammar(separators: str, brackets: bool, stop: str) -> re.Pattern:
    sep = re.escape(separators.replace(stop, "")) if stop else re.escape(separators)
    halt = f"|(?P<stop>{re.escape(stop)})" if stop else ""
    bracketed = r"|\[(?P<b>[^\]]*)\]" if brackets else ""
    return re.compile(rf"""[{sep}]+|"(?P<d>[^"]*)"|'(?P<s>[^']*)'{bracketed}{halt}|(?P<w>[^{re.escape(separators)}]+)""")


def parse(text: str, separators: str = SEPARATORS, brackets: bool = False, stop: str = "", at: int = 0) -> tuple[list[tuple[str, str | None]], int]:
    """Values from ``at`` to the end, or to the first ``stop`` outside of quotes: (value, flag) pairs and where it ended."""
    found: list[tuple[str, str | None]] = []
    match = _grammar(separators, brackets, stop).match
    end = len(text)
    while at < end:
        m = match(text, at)
        kind = m.lastgroup
        if kind == "stop":
            return found, m.start()
        at = m.end()
        if kind is None:
            continue
        value = m[kind]
        if value:
            flag = UNCLOSED if kind == "w" and (value[0] in "\"'" or brackets and value[0] == "[") else None
            found.append((value, flag))
    return found, at


_KEY = re.compile(r"[;\s]*([^=;\s\"']*)(?:[ \t]*=[ \t]*|[ \t]+|(?=;)|$)")


def parse_entries(text: str, keys: frozenset[str], separators: str = SEPARATORS, brackets: bool = False) -> list[tuple[str, str | None]]:
    """Values of all entries ``key=values`` or ``key "value"`` whose key, in lower case, is one of ``keys``, left to right."""
    found: list[tuple[str, str | None]] = []
    at, end = 0, len(text)
    while at < end:
        m = _KEY.match(text, at)
        key, at = (m[1].lower(), m.end()) if m and m.end() > at else ("", at)
        values, stopped = parse(text, separators, brackets, ";", at)
        if key in keys:
            found += values
        at = max(stopped, at) if stopped > at or stopped == end or text[stopped] == ";" else at + 1
        if at < end and text[at] == ";":
            at += 1
    return found


def _splitter(fields: list[tuple[str, str, frozenset[str]]], least: int, schema: pa.Schema, id_columns: int, brackets: bool):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names, places, values, flags = [], [], [], [], []
            for i, (_, name, keys) in enumerate(fields):
                column = b.column(id_columns + i)
                for row, text in zip(column.is_valid().to_numpy(zero_copy_only=False).nonzero()[0], column.drop_null().to_pylist()):
                    got = parse_entries(text, keys, brackets=brackets) if keys else parse(text, brackets=brackets)[0]
                    if len(got) < least:
                        continue
                    for pos, (value, flag) in enumerate(got, 1):
                        rows.append(row)
                        names.append(name)
                        places.append(pos)
                        values.append(value)
                        flags.append(flag)
            at = pa.array(rows, pa.int64())
            arrays = [b.column(i).take(at) for i in range(id_columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(values, pa.string()), pa.array(flags, pa.string())], schema=schema)

    return split


def split_packed(df: DataFrame, ids: list[str], fields: dict[str, str], entries: dict[str, tuple[str, list[str]]] | None = None, least: int = 1, brackets: bool = False) -> DataFrame:
    """One row a value: the id columns, field, pos (from 1), value and flag (null, or why the value is malformed).

    ``fields`` gives the output name of each column that is a list of values; ``entries`` the output names of columns of
    attributes, with the keys whose values are wanted. Fields with fewer than ``least`` values give no row. Null, empty and
    blank fields give none; empty pieces are no values; repeated rows give theirs each. With ``brackets``, a value may also stand
    in square brackets, which are no part of it and keep separators inside. Only the columns named are read.
    """
    marks = "[" + re.escape(SEPARATORS).replace("/", "\\/") + "\"'" + ("\\[" if brackets else "") + "]"
    spec: list[tuple[str, str, frozenset[str]]] = []
    chosen, wanted = [F.col(c) for c in ids], F.lit(False)
    for i, (column, name) in enumerate(fields.items()):
        # a field without any separator is one value at most: with least > 1 it never leaves the JVM
        keep = F.col(column).rlike(marks) if least > 1 else F.col(column).isNotNull()
        chosen.append(F.when(keep, F.col(column)).alias(f"_f{i}"))
        spec.append((column, name, frozenset()))
        wanted = wanted | keep
    for i, (column, (name, keys)) in enumerate((entries or {}).items()):
        keep = F.lower(F.col(column)).rlike("|".join(re.escape(k.lower()) for k in keys))
        chosen.append(F.when(keep, F.col(column)).alias(f"_e{i}"))
        spec.append((column, name, frozenset(k.lower() for k in keys)))
        wanted = wanted | keep
    slim = df.where(F.coalesce(wanted, F.lit(False))).select(*chosen)
    kinds = {f.name: f.dataType for f in slim.schema.fields}
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([T.StructField(c, kinds[c]) for c in ids] + [T.StructField("field", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("flag", T.StringType())])
    return slim.mapInArrow(_splitter(spec, least, to_arrow_schema(out), len(ids), brackets), out)


def values_of(column: Column | str) -> Column:
    """The values of a packed field as an array, by native expressions; an empty array for null."""
    c = F.col(column) if isinstance(column, str) else column
    tokens = F.regexp_extract_all(c, F.lit("\"[^\"]*\"|'[^']*'|[^ \\t,;|/]+"), F.lit(0))
    quoted = lambda t: (F.length(t) >= 2) & ((F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))) | (F.startswith(t, F.lit("'")) & F.endswith(t, F.lit("'"))))
    bare = F.transform(tokens, lambda t: F.when(quoted(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))
    return F.when(c.isNull(), F.array().cast("array<string>")).when(~c.rlike("[ \\t,;|/\"']") & (c != ""), F.array(c)).otherwise(F.filter(bare, lambda t: t != ""))
