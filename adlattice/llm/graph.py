"""Connected components by alternating star rounds, the number of rounds logarithmic in the component size."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adlattice.session import materialise

SLICES = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of a node move to the least of all its neighbours and itself.  Small star: the node
    and its smaller neighbours move to the least of them.  Only minima are aggregated, so no neighbourhood is gathered, and
    the neighbours of a node meet its minimum in slices."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("at")
    met = (both.withColumn("slice", F.pmod(F.xxhash64("b"), F.lit(SLICES)).cast("int"))
           .join(least.select("u", "m", slices), (F.col("a") == F.col("u")) & (F.col("slice") == F.col("at"))))
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of longs to (node, label), the label being the component's least node; only linked nodes appear."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = state(edges)
    while now[0]:
        edges = materialise(_star(_star(edges, True), False))
        before, now = now, state(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
