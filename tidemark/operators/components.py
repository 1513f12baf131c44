"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u and v of one orderable type); component is its smallest node.

    Each round points the larger neighbours of a node to its smallest one, then the smaller
    ones; it ends when a round changes nothing, after a few rounds even for long chains.
    Smallest neighbours are found by an aggregate that combines before its shuffle, and a
    node with very many edges meets its one smallest in a join that AQE can split.  Every
    round is written to the shared folder.  Self-edges and repeated edges do no harm; no
    edges give an empty table.
    """
    pairs = cut_lineage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        )
        pairs = cut_lineage(small.select("col.u", "col.v").where("u <> v").distinct(), "stars")
        now = pairs.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    labels = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labels.unionByName(roots)
