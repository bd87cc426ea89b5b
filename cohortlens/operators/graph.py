"""Connected components by label propagation with pointer jumping, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that edges (a, b) touch; component: the smallest node reachable. No edges, no rows.

    A round gives each node the smallest label around it, then that label's label; a long chain takes about the logarithm
    of its length in rounds. Nodes with many edges are aggregated before the shuffle.
    """
    real = edges.filter("a <> b").select("a", "b")
    both = cut(real.unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("over"), F.col("component").alias("top"))
        new = cut(step.join(up, F.col("component") == F.col("over")).select("node", "old", F.least("component", "top").alias("component")))
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def shared_key_components(df: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """(node, component) for every row: rows that share any of the keys are together. A key's rows are tied to its smallest node, so a hot key gives as many edges as rows."""
    edges = None
    for k in keys:
        rows = df.filter(F.col(k).isNotNull()).select(F.col(k).alias("k"), F.col(node).alias("b"))
        own = rows.join(rows.groupBy("k").agg(F.min("b").alias("a")), "k").select("a", "b")
        edges = own if edges is None else edges.unionByName(own)
    parts = components(edges)
    return df.select(F.col(node).alias("n")).join(parts, F.col("n") == F.col("node"), "left").select(F.col("n").alias("node"), F.coalesce("component", "n").alias("component"))
