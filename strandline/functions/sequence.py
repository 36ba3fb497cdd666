"""Functions on sequences of letters, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the nucleotide codes.
_FROM = "ACGTUWSMKRYBDHVNacgtuwsmkrybdhvn"
_TO = "TGCAAWSKMYRVHDBNtgcaawskmyrvhdbn"


def _count(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters + letters.lower(), ""))


def gc_content(seq: Column) -> Column:
    """(C + G + S) / (A + T + W + C + G + S) in any case; 0 if there are none."""
    gc, at = _count(seq, "CGS"), _count(seq, "ATW")
    return F.coalesce(F.try_divide(gc.cast("double"), (gc + at).cast("double")), F.lit(0.0))


def gc_skew(seq: Column) -> Column:
    """(G - C) / (G + C); 0 if there are none."""
    g, c = _count(seq, "G"), _count(seq, "C")
    return F.coalesce(F.try_divide((g - c).cast("double"), (g + c).cast("double")), F.lit(0.0))


def n_content(seq: Column) -> Column:
    """Share of N and X; other ambiguous letters don't count."""
    return F.coalesce(F.try_divide(_count(seq, "NX").cast("double"), F.length(seq).cast("double")), F.lit(0.0))


def subsequence(seq: Column, start: Column, end: Column) -> Column:
    """Letters from start to end, 1-based and closed; null if they aren't all there."""
    return F.when((start >= 1) & (end <= F.length(seq)) & (start <= end), F.substring(seq, start.cast("int"), (end - start + 1).cast("int")))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, _FROM, _TO))


def spliced(seq: Column, parts: Column, strand: Column) -> Column:
    """Parts (structs start, end) joined from 5' to 3': on the - strand each is reverse-complemented and the order turned."""
    ordered = F.array_sort(parts)
    forward = F.transform(ordered, lambda p: subsequence(seq, p["start"], p["end"]))
    backward = F.reverse(F.transform(forward, lambda s: reverse_complement(s)))
    return F.when(F.exists(forward, lambda s: s.isNull()), F.lit(None)).otherwise(F.array_join(F.when(strand == "-", backward).otherwise(forward), ""))


def wrapped(seq: Column, width: int = 80) -> Column:
    """The sequence with a line break after every ``width`` letters; 0 leaves it on one line."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n") if width else seq


# The classes of letters that compositions count.
_CLASSES = {"g": "Gg", "c": "Cc", "s": "Ss", "at": "AaTtWw", "nx": "NnXx"}


def _counted(seq):
    """Counts of each class in each sequence, over the bytes of the whole batch at once."""
    import numpy as np
    import pyarrow as pa

    seq = seq.cast(pa.large_binary())
    offsets = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
    data = np.frombuffer(seq.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(seq) else np.zeros(0, np.uint8)
    fields = []
    for letters in _CLASSES.values():
        hit = np.zeros(256, bool)
        hit[[ord(x) for x in letters]] = True
        running = np.concatenate([[0], np.cumsum(hit[data], dtype=np.int64)])
        fields.append(pa.array(np.diff(running[offsets - offsets[0]]), pa.int64()))
    return pa.StructArray.from_arrays(fields, list(_CLASSES))


def letter_counts(seq: Column) -> Column:
    """Struct of counts g, c, s, at, nx of a sequence; 0 for null.

    The one place where Arrow batches beat native expressions: all classes come from one pass over the bytes, where the native
    functions take one slow pass a class. Worth it for long sequences whose whole composition is wanted.
    """
    return F.arrow_udf(_counted, "struct<g:bigint,c:bigint,s:bigint,at:bigint,nx:bigint>")(seq)
