"""Access to attribute text (key=value;...)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(attributes: Column | str, key: str) -> Column:
    """Value of a key, null if it isn't there. Keys are matched whole."""
    c = F.col(attributes) if isinstance(attributes, str) else attributes
    v = F.regexp_extract(c, rf"(?:^|;)\s*{key}=([^;\n]+)", 1)
    return F.when(v != "", F.btrim(v))


def without(attributes: Column | str, key: str) -> Column:
    c = F.col(attributes) if isinstance(attributes, str) else attributes
    return F.regexp_replace(c, rf"(?<=^|;)\s*{key}=[^;\n]+;*", "")


def as_map(attributes: Column | str) -> Column:
    """All pairs as a map, values percent-decoded; of a repeated key the first stays."""
    c = F.col(attributes) if isinstance(attributes, str) else attributes
    pairs = F.filter(F.transform(F.split(c, ";"), lambda p: F.btrim(p)), lambda p: F.instr(p, "=") > 1)
    cut = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.expr("1").alias("_")).withField("v", F.substring(p, F.instr(p, "=") + 1, F.length(p))))
    first = F.aggregate(
        cut, F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, p: F.when(F.exists(acc, lambda q: q["k"] == p["k"]), acc).otherwise(F.concat(acc, F.array(F.struct(p["k"].alias("k"), F.try_url_decode(F.replace(p["v"], F.lit("+"), F.lit("%2B"))).alias("v"))))),
    )
    return F.map_from_entries(first)
