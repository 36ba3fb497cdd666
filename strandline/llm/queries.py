"""Queries on documents, and the SQL that checks them where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import encode, packing, spam
from strandline.session import ship, table, written


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return encode.encoded(table(spark, d, "documents"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Number of tokens of each document, and whether its ids give back the text."""
    ship(spark)
    return encode.encoded(table(spark, d, "documents"), "doc_id", "text", mode="check")


#: Tokens of a container.
CAPACITY = 2048


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one longer than a container, with the container that holds it."""
    ship(spark)
    docs = table(spark, d, "documents")
    return packing.fill_containers(encode.encoded(docs, "doc_id", "text", mode="count"), "doc_id", "n_tokens", CAPACITY, docs.count())


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers are filled to which hundredth."""
    used = p8_containers(spark, d).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return used.groupBy(F.floor(F.col("n") * 100 / CAPACITY).cast("int").alias("percent")).agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and of them: those without a container or piece, tokens lost, containers too full, documents cut without need."""
    ship(spark)
    docs = table(spark, d, "documents")
    sized = written(encode.encoded(docs, "doc_id", "text", mode="count"), "counts")
    placed = written(packing.fill_containers(sized, "doc_id", "n_tokens", CAPACITY, docs.count()), "placed")
    by_doc = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("n_pieces"), F.count("container").alias("n_in"))
    checks = docs.select("doc_id").join(sized, "doc_id", "left").join(by_doc, "doc_id", "left")
    n = F.coalesce("n_tokens", F.lit(0))
    docs_row = checks.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.coalesce(F.sum((F.col("placed").isNull() | (n > 0) & (F.col("n_in") < F.col("n_pieces"))).cast("bigint")), F.lit(0)).alias("n_unplaced"),
        F.coalesce(F.sum(F.abs(n - F.coalesce("placed", F.lit(0)))), F.lit(0)).cast("bigint").alias("tokens_lost"),
        F.coalesce(F.sum((F.col("n_pieces") != F.greatest(F.ceil(n / CAPACITY), F.lit(1))).cast("bigint")), F.lit(0)).alias("n_cut_wrongly"),
    )
    full = placed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.coalesce(F.sum((F.col("n") > CAPACITY).cast("bigint")), F.lit(0)).alias("n_too_full"))
    return docs_row.join(full, F.lit(True))


def p8_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Of each shard: its items, the least number of containers, that of a sorted best fit, that found, and the crossovers made."""
    ship(spark)
    docs = table(spark, d, "documents")
    return packing.evolution(written(encode.encoded(docs, "doc_id", "text", mode="count"), "counts"), "doc_id", "n_tokens", CAPACITY, docs.count())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return spam.spam_pages(table(spark, d, "documents"), "doc_id", "text", "lang")


def p9_suspects(spark: SparkSession, d: str) -> DataFrame:
    """Documents with any stretch that lies far out toward spam: the share of their characters in such, and their distance."""
    ship(spark)
    found = spam.judged(table(spark, d, "documents"), "doc_id", "text", "lang").where("share > 0")
    return found.select(F.col("key").alias("doc_id"), "language", F.round("distance", 6).alias("distance"), F.round("share", 6).alias("share"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_roundtrip, p8_containers, p8_fill, p8_check, p8_evolution, p9_found, p9_suspects)}
ORACLE: dict[str, str] = {
    "p8_check": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_unplaced, CAST(0 AS BIGINT) AS tokens_lost, CAST(0 AS BIGINT) AS n_cut_wrongly, CAST(0 AS BIGINT) AS n_too_full FROM documents",
}
