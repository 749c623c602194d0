"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.llm._common import Tables, bounded, drop_stored, rows_of, stored


def components(edges: DataFrame) -> DataFrame:
    """A stored table of node, label (the least node that links reach) for every node of edges (a, b: long). No links: no rows.

    Each round hangs every neighbour on the least node of its neighbourhood, first the larger neighbours, then the
    smaller ones, until nothing changes; every node's links then lead to its component's least node alone. Least
    neighbours are pre-aggregated, so that a node with very many links is no large partition.
    """
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    links = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", mark)
    state = None
    while rows_of(links) and state != (state := (rows_of(links), links.stored_mark)):
        used = Tables([links])
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = used(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        larger = used(both.where("v > u").join(bounded(least), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = used(larger.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = larger.join(bounded(least), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links", mark)
        used.drop()
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    labels = stored(labels, "labels")
    drop_stored(links)
    return labels
