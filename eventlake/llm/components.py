"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import discard, settled, spill


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def _round(now: DataFrame) -> DataFrame:
    """Edges after every node's larger neighbours hang on the least node that it sees, and then its smaller ones."""
    both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = spill(low, "lowest")
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = spill(large, "large-star")
    least = spill(large.groupBy("u").agg(F.min("v").alias("m")), "least")
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(small.union(least.select("u", F.col("m").alias("v"))))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another one; root is the smallest node of the component.

    edges: columns u, v. Each round hangs neighbours on the smallest one that either end sees, until the edges are stars. Rounds grow
    with the logarithm of a component's width; each is written to the shared folder, and what it needed is deleted there.
    Aggregated sides of joins are written first: a join of plain exchanges is one whose hot keys Spark splits. Loops, repeated
    edges and nulls are dropped first. No edges: no rows.
    """
    spark, state = edges.sparkSession, None
    now = spill(_ordered(edges), "edges")
    while True:
        before, now = now, settled(spark, lambda now=now: _round(now), "edges")
        discard(before)
        found = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (found["n"], found["h"]) == state:
            break
        state = (found["n"], found["h"])
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
