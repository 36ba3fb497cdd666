"""Reports on a comparison, as data frames of lines or pages. Only a summary is ever small enough to come to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shown(x: str) -> Column:
    """Three decimals, or -- where undefined."""
    return F.when(F.col(x).isNotNull(), F.format_string("%.3f", F.col(x))).otherwise("--")


def text(pairs: DataFrame) -> DataFrame:
    """One block of text for each pair (gene_id, seqid, start, end, class, counts and statistics): gene_id, block."""
    rule = F.lit("-" * 60)
    line = lambda label, *c: F.concat(F.lit(f"  {label:<28}"), *c)
    block = F.concat_ws(
        "\n", F.lit("=" * 60), F.concat(F.lit("Locus "), "seqid", F.lit(":"), "start", F.lit("-"), "end"), rule, line("class", F.col("class")),
        line("matching bases", F.format_number("matches", 0), F.lit(" of "), F.format_number("length", 0)),
        line("CDS sensitivity", shown("sn")), line("CDS specificity", shown("sp")), line("CDS F1", shown("f1")), line("CDS edit distance", shown("ed")),
        line("exons correct/missing/wrong", F.concat_ws("/", "exon_correct", "exon_missing", "exon_wrong")),
    )
    return pairs.select("gene_id", block.alias("block"))


def summary_lines(classes: DataFrame) -> DataFrame:
    """Lines of the closing summary: class, n, share of all pairs."""
    x = classes.withColumn("_all", F.lit(classes.agg(F.sum("n")).first()[0]))
    return x.select("class", F.format_string("%-14s %10s (%5.1f%%)", "class", F.format_number("n", 0), F.col("n") * 100.0 / F.col("_all")).alias("line"))


def html(pairs: DataFrame) -> DataFrame:
    """One page for each pair: path, page. Write them with ``write_pages``."""
    esc = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = lambda k, c: F.concat(F.lit(f"<tr><th>{k}</th><td>"), c, F.lit("</td></tr>"))
    page = F.concat(
        F.lit("<!doctype html><html><head><meta charset='utf-8'><title>"), esc("seqid"), F.lit(":"), "start", F.lit("-"), "end", F.lit("</title></head><body><table>"),
        row("class", esc("class")), row("matches", F.col("matches").cast("string")), row("length", F.col("length").cast("string")), row("sensitivity", shown("sn")), row("specificity", shown("sp")),
        F.lit("</table></body></html>"),
    )
    return pairs.select("seqid", F.concat("seqid", F.lit("/"), "start", F.lit("-"), "end", F.lit(".html")).alias("path"), page.alias("page"))


def html_index(pairs: DataFrame) -> DataFrame:
    """For each sequence, the number of loci, and how many are perfect: the rows of the index."""
    return pairs.groupBy("seqid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == "perfect").alias("n_perfect"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Each page to its own file under a folder that all executors share."""

    def write(rows) -> None:
        import os

        for r in rows:
            p = os.path.join(folder, r.path)
            os.makedirs(os.path.dirname(p), exist_ok=True)
            with open(p, "w", encoding="utf-8") as f:
                f.write(r.page)

    pages.foreachPartition(write)


def graphic_width(length: Column) -> Column:
    """Width in pixels of the picture of a locus."""
    return F.least(F.greatest(length * 0.05, F.lit(650.0)), F.lit(10_000.0)).cast("int")
