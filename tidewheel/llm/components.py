"""Connected components of an edge table, by alternating large and small stars.

Every round replaces each node's edges by edges to the smallest neighbour, so
the edge count never grows and the depth shrinks fast. Each round's edges are
written to the shared folder, which cuts the lineage, and replace those of the
round before; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import forget, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return moved.select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, label: str = "stars") -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of one type); the component is its smallest node.

    Loops and repeated edges do no harm; an edge with a null end is left out; no edges give no rows.
    """
    a, b = edges.columns
    edges = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = _tidy(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    before, last = None, None
    while True:
        edges = materialize(edges, label)
        if last is not None:
            forget(last)
        last = edges
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        edges = _tidy(_small_star(_tidy(_large_star(edges))))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
