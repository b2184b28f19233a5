"""Connected components of a graph held in tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mlwatch.sources.shared import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest node it knows."""
    least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest of them."""
    least = F.min("v").over(Window.partitionBy("u").orderBy("v"))
    pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return edges.withColumn("m", least).select(F.inline(pairs)).filter("u <> v").distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a neighbour.

    A round is grouped minima (combined before the shuffle), an equi-join, which adaptive execution splits at the
    roots that many nodes hang on, and a running minimum; nothing is gathered per node. A round's edges are written to the shared folder, the round
    before is removed, and the loop ends when a round changes nothing. Null ends and loops are no edges;
    repeated edges count once; no edges give no rows.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    usable = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    current = written(edges.filter(usable).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    signature = _signature(current)
    while True:
        after = written(_small_star(_large_star(current)), "edges")
        discard(current)
        current, before = after, signature
        signature = _signature(current)
        if signature == before:
            break
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots)
