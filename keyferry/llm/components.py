"""Connected components of a link table, by contracting stars in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyferry.scratch import settle


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, root): the least node that each node can reach.

    Every round hangs a node's larger neighbours on its least one (large star), then its smaller
    neighbours (small star), until all links point at roots. The rounds grow with the logarithm of
    the longest chain. Each round is written to the shared folder. Nodes without links, and nulls,
    have no row. A node with very many neighbours is only aggregated (map-side first) and joined.
    """
    edges = settle(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        large = _star(edges, both=True)
        edges = settle(_star(large, both=False).distinct(), "links")
        # The sums stay the same once every link points at its component's root.
        state = edges.agg(
            F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Links point from larger to smaller nodes. With ``both`` a node's larger neighbours move to the
    least node among it and its neighbours; else its smaller neighbours and itself do."""
    if both:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges
    least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = sides.join(least, "a")
    if both:
        return (
            joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )
