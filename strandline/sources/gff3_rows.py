"""Loading of raw feature lines: sound lines become typed features, broken ones come out with a reason.

Every column is first taken as nullable text. Vectorised cast and constraint rules, all native expressions, give each line
an array of errors; lines with an empty array are loaded, the others are separated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the nine columns of a feature line.
COLUMNS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
# \z is the very end; $ would also match before a line end that is part of the value
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
#: What a sound column 9 can't hold, whether its values are quoted or not: a piece without a key, without =, without a value, or
#: an odd accession.
_UNSOUND = r"""(?:^|;) *(?:=|[^=; ][^=;]*(?:;|\z)|[^=; ][^=;]*= *(?:"")? *(?:;|\z)|accession *=(?!"?[A-Z]{2}_[0-9]+\.[0-9]+"? *(?:;|\z)))"""


def _masked(attributes: Column) -> Column:
    """Column 9 with the semicolons and equals signs that stand inside quotes put out of the way.

    After a split at each double quote, the odd parts stand inside quotes.
    """
    parts = F.transform(F.split(attributes, '"'), lambda part, i: F.when(i % 2 == 1, F.translate(part, ";=", "\u0001\u0002")).otherwise(part))
    return F.when(F.instr(attributes, '"') > 0, F.array_join(parts, '"')).otherwise(attributes)


def _pieces(masked: Column) -> Column:
    """Pieces between the semicolons outside of quotes, blanks trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(masked, ";"), lambda p: F.btrim(p)), lambda p: p != "")


def _sound_quotes(value: Column) -> Column:
    """Quotes stand only at both ends of a value, those inside being doubled."""
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.startswith(value, F.lit('"')) & F.endswith(value, F.lit('"')) & (F.length(value) >= 2) & (F.instr(F.replace(inner, F.lit('""'), F.lit("")), '"') == 0)


def _once(df: DataFrame) -> DataFrame:
    """The same rows, with the columns so far computed once: a filter can't be pushed through the generator, which would write
    out every column's expression again wherever the filter uses it."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("_row")).select("_row.*")


def with_errors(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds the nine columns as text and ``errors``, the array of the rules broken, each with its column: ``quoting:score``.

    Blank lines and lines that begin with ``#`` are no data lines and are left out, as are nulls. Rules, in order:
    ``columns`` (nine tab-separated columns; nothing else is tried if it fails), ``quoting`` (a double quote anywhere but
    around an attribute's value, or not doubled within), ``value`` (everything else); each names the columns that break it, left
    to right. A carriage return at the end is no part of a line.
    """
    raw = F.when(F.endswith(F.col(line), F.lit("\r")), F.expr(f"substring(`{line}`, 1, length(`{line}`) - 1)")).otherwise(F.col(line))
    df = lines.withColumn("_raw", raw).where((F.btrim(F.col("_raw"), F.lit(" \t\r\n\x0b\x0c")) != "") & ~F.startswith(F.col("_raw"), F.lit("#")))
    df = _once(df).withColumn("_c", F.split("_raw", "\t", -1))
    nine = F.size("_c") == 9
    for i, c in enumerate(COLUMNS):
        df = df.withColumn(f"_{c}", F.get("_c", F.lit(i)))
    df = _once(df)
    # most lines hold no double quote at all: these are not cut into pieces
    quoted = F.instr("_raw", '"') > 0
    pairs = F.btrim("_attributes") != "."
    df = _once(df.withColumn("_m", _masked(F.col("_attributes"))))
    df = df.withColumn("_p", F.when(nine & quoted & pairs, _pieces(F.col("_m"))).otherwise(F.array().cast("array<string>")))
    eq = lambda p: F.instr(p, "=")
    ill_quoted = F.exists(
        "_p",
        lambda p: (F.instr(p, '"') > 0)
        & ((eq(p) == 0) | (F.instr(F.substring(p, F.lit(1), F.greatest(eq(p) - 1, F.lit(0))), '"') > 0) | ~_sound_quotes(F.substring(p, eq(p) + 1, F.length(p)))),
    )
    digits = lambda c: F.col(c).rlike(r"^[0-9]+\z")
    # digits of any length: compared as decimals would overflow, so by length of the stripped digits, then by text
    s, e = F.ltrim("_start", F.lit("0")), F.ltrim("_end", F.lit("0"))
    ordered = (s != "") & ((F.length(s) < F.length(e)) | ((F.length(s) == F.length(e)) & (s <= e)))
    filled = lambda c: F.btrim(c) != ""
    values = {
        "seqid": filled("_seqid"),
        "source": filled("_source"),
        "type": filled("_type"),
        "start": digits("_start"),
        "end": digits("_end") & (~digits("_start") | ordered),
        "score": (F.col("_score") == ".") | F.col("_score").rlike(_NUMBER),
        "strand": F.col("_strand").isin("+", "-", ".", "?"),
        "phase": F.col("_phase").isin("0", "1", "2", ".") & ~((F.col("_type") == "CDS") & (F.col("_phase") == ".")),
        "attributes": filled("_attributes")
        & (~pairs | F.col("_m").rlike("[^; ]") & ~F.col("_m").rlike(_UNSOUND))
        & ~((F.instr("_attributes", "%") > 0) & F.col("_attributes").rlike("%(?![0-9A-Fa-f]{2})")),
    }
    broken = [F.when(quoted & (F.instr(f"_{c}", '"') > 0), F.lit(f"quoting:{c}")) for c in COLUMNS[:8]]
    broken += [F.when(quoted & ill_quoted, F.lit("quoting:attributes"))]
    broken += [F.when(~F.coalesce(sound, F.lit(False)), F.lit(f"value:{c}")) for c, sound in values.items()]
    errors = F.when(~nine, F.array(F.lit("columns"))).otherwise(F.array_compact(F.array(*broken)))
    return _once(df.withColumn("errors", errors))


def rejected(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Broken data lines with the first rule that each breaks: key, reason. Repeated rows each give their own."""
    return with_errors(lines.select(key, line), line).where(F.size("errors") > 0).select(key, F.substring_index(F.get("errors", F.lit(0)), ":", 1).alias("reason"))


def loaded(lines: DataFrame, keep: list[str], line: str = "line") -> DataFrame:
    """Sound data lines as typed features: the columns of ``keep``, the nine of the format, and id, parent, accession.

    ``.`` is null in every column but the strand; coordinates past BIGINT are null. Values keep their percent escapes.
    """
    ok = with_errors(lines.select(*keep, line), line).where(F.size("errors") == 0)
    ok = ok.withColumn("_p", F.when(F.btrim("_attributes") != ".", _pieces(F.col("_m"))).otherwise(F.array().cast("array<string>")))
    # pieces hold masked semicolons and equals signs inside quotes; they are put back in the values
    back = lambda v: F.translate(v, "\u0001\u0002", ";=")

    def attribute(name: str) -> Column:
        hit = F.get(F.filter("_p", lambda p: F.startswith(p, F.lit(name)) & p.rlike(f"^{name}\\s*=")), F.lit(0))
        v = F.regexp_replace(hit, f"^{name}\\s*=\\s*", "")
        return back(F.when(v.rlike('^".*"$'), F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), '""', '"')).otherwise(v))

    dot = lambda c: F.when(F.col(c) != ".", F.col(c))
    return ok.select(
        *keep,
        F.col("_seqid").alias("seqid"),
        dot("_source").alias("source"),
        F.col("_type").alias("type"),
        F.col("_start").try_cast("bigint").alias("start"),
        F.col("_end").try_cast("bigint").alias("end"),
        dot("_score").try_cast("double").alias("score"),
        F.col("_strand").alias("strand"),
        dot("_phase").try_cast("tinyint").alias("phase"),
        attribute("ID").alias("id"),
        attribute("Parent").alias("parent"),
        attribute("accession").alias("accession"),
        dot("_attributes").alias("attributes"),
    )
