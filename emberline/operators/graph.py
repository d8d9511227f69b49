"""Connected components by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import lookup
from .storage import discard, written


#: So many edges, of 16 bytes, are few enough for one task if they all have one node.
FEW_EDGES = 250_000


def _signature(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, whatever their order."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", *, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node
    that is reachable. Edges count both ways; loops, repeats and edges with a null end
    add nothing but the loop's own node. No edges: an empty table.

    In a round, every node first hands its larger neighbours to the smallest node it
    knows, then its smaller ones. Node ids meet by partial minimums, and nodes of many
    edges by broadcast (see lookup; graphs of up to FEW_EDGES are simply joined, which
    keeps plans small), so a node of more edges than that doesn't land in one task. Each round
    is written to the shared folder, which keeps plans short and survives lost executors.
    The rounds end when every node points to its component's smallest node, which is when
    nothing changes.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    start = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    now, state = start.where("u <> v"), None
    rows = now.count()
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        counted = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        met = both.join(counted.drop("n"), "u") if rows <= FEW_EDGES else lookup(both, counted, ["u"], total=2 * rows, how="inner")
        large = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components", rows)
        discard(last)
        before, state = state, _signature(now)
        rows = state[0]
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = start.select(F.col("v").alias("node")).union(start.select("u")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
