"""Connected components of links by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one node, which itself hangs on none."""
    ups = edges.groupBy("a").agg(F.min("b").alias("b1"), F.max("b").alias("b2"))
    odd = ups.join(edges.select(F.col("b").alias("_b")).distinct(), F.col("a") == F.col("_b"), "left").where(F.col("_b").isNotNull() | (F.col("b1") < F.col("b2")))
    return odd.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, label), the smallest node that links lead to; nodes without links are left out.

    A large star hangs each node's larger neighbours on the smallest node around
    it, a small star its smaller ones; they alternate until every component is a
    star, in a number of rounds that grows with the logarithm of the largest
    component. Minima are aggregated before any shuffle. Each round is written
    to the shared folder, and nothing of it comes to the driver.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(links.where("a <> b").select(hi.alias("a"), lo.alias("b")).distinct(), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        hung = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = hung.where("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        before, edges = edges, materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "small")
        discard(before, large)
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return materialize(labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "labels")
