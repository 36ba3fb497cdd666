"""Clusters of proteins by shared k-mers, and what clusters say about loci."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import written


def cluster_loci(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """cluster_id, n_loci, n_species, loci, species: members (cluster_id, species, accession) with the locus of each protein."""
    x = members.join(mapping.select(F.col("protein").alias("accession"), "locus"), "accession")
    return x.groupBy("cluster_id").agg(
        F.countDistinct("locus").alias("n_loci"), F.countDistinct("species").alias("n_species"), F.concat_ws(",", F.array_sort(F.collect_set("locus"))).alias("loci"), F.concat_ws(",", F.array_sort(F.collect_set("species"))).alias("species")
    )


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the smallest node (nodes: node) of each component of links (a, b); the lineage is cut at each round."""
    both = links.union(links.select("b", "a"))
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label").union(labels)
        new = written(seen.groupBy("node").agg(F.min("label").alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def by_sequence(seqs: DataFrame, *, k: int = 5, least: float = 0.5, hits: int = 3) -> DataFrame:
    """seqid, cluster_id: proteins (seqid, seq) joined transitively where the Jaccard index of their sets of k-mers is at least
    ``least``. Not the greedy clusters of any particular program.

    Copies of one sequence are settled first, by equality. No pair is lost: of two sets alike enough, those first in any fixed
    order of k-mers share some, and here the rarest come first; all but the last ``least`` of a set, and ``hits`` more, must share
    ``hits`` with the other's. Every candidate is held against the other by its whole set. Links to the smallest holder of each
    k-mer are tried first, so that a family falls together before pairs are made; then all pairs in different clusters are.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(k))))
    need = lambda n: F.ceil(F.col(n) * least - 1e-9)  # noqa: E731  # k-mers that a set shares at least with one alike
    d = seqs.where("seqid IS NOT NULL AND seq IS NOT NULL AND length(seq) > 0").groupBy("seq").agg(F.min("seqid").alias("rep"))
    d = written(d.select(F.monotonically_increasing_id().alias("id"), "rep", "seq", F.size(grams("seq")).alias("n")), "proteins")
    tokens = d.select("id", "rep", "n", F.explode(grams("seq")).alias("g"))
    # k-mers of one holder stand first in its order, but lead to nobody
    common = tokens.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    held = tokens.join(common, "g").groupBy("id", "rep", "n").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("x"))
    first = F.least("n", F.col("n") - need("n") + hits) - F.col("n") + F.size("x")
    heads = written(held.select("id", "rep", "n", F.explode(F.slice("x", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("x")).select("id", "rep", "n", "x.g"), "heads")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs a k-mer (a, an, b, bn): a and b of those alike, once each, with their sequences' rep."""
        near = pairs.where(F.greatest("an", "bn") * least - 1e-9 <= F.least("an", "bn")).groupBy("a", "an", "b", "bn").agg(F.count(F.lit(1)).alias("c"))
        near = near.where(F.col("c") >= F.least(F.lit(hits), F.greatest(need("an"), need("bn"))))
        for t in "ab":
            near = near.join(d.select(F.col("id").alias(t), F.col("rep").alias(f"{t}_rep"), F.col("seq").alias(f"{t}_seq")), t)
        both = F.size(F.array_intersect(grams("a_seq"), grams("b_seq")))
        return near.where(both / (F.col("an") + F.col("bn") - both) >= least)

    least_of = heads.groupBy("g").agg(F.min(F.struct("id", "n")).alias("m"))
    star = heads.join(least_of, "g").where("m.id <> id").select(F.col("m.id").alias("a"), F.col("m.n").alias("an"), F.col("id").alias("b"), F.col("n").alias("bn"))
    links = written(verified(star).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct(), "links")
    labels = _components(d.select(F.col("rep").alias("node")).distinct(), links)

    # what the first round left apart: clusters are its nodes now
    x = heads.join(labels.withColumnRenamed("node", "rep"), "rep")
    x = x.join(x.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("g"), "g", "left_semi")
    side = lambda t: x.select("g", F.col("id").alias(t), F.col("n").alias(f"{t}n"), F.col("label").alias(f"{t}_label"))
    pairs = side("a").join(side("b"), "g").where("a < b AND a_label <> b_label").select("a", "an", "b", "bn")
    label_of = lambda t: labels.select(F.col("node").alias(f"{t}_rep"), F.col("label").alias(t))
    found = verified(pairs).select("a_rep", "b_rep").join(label_of("a"), "a_rep").join(label_of("b"), "b_rep")
    links = written(found.select("a", "b").distinct(), "links")
    joined = _components(labels.select(F.col("label").alias("node")).distinct(), links).select(F.col("node").alias("label"), F.col("label").alias("cluster_id"))
    clusters = labels.join(joined, "label").select(F.col("node").alias("rep"), "cluster_id")
    return seqs.join(d.select("seq", "rep"), "seq").join(clusters, "rep").select("seqid", "cluster_id").distinct()
