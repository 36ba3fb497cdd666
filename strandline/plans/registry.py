"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import extra_queries, feature_queries, loci_queries, model_queries, problems, source_queries, summary_queries

_CATALOGS = (loci_queries.C, feature_queries.C, model_queries.C, summary_queries.C, source_queries.C, extra_queries.C)


def queries() -> dict:
    out = dict(problems.QUERIES)
    for c in _CATALOGS:
        out |= c.queries
    return out


def oracle() -> dict[str, str]:
    out = dict(problems.ORACLE)
    for c in _CATALOGS:
        out |= c.oracle
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iLoci of the model genes: merged, extended by delta, with the loci between them."""
    return loci_queries.locus_extend(spark, sf_dir)
