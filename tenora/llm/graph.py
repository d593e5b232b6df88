"""Connected components: of an edge table, as DataFrame operations alone, and of pairs within one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenora.plans.staging import staged


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Nodes of ``edges`` (src, dst) with the smallest node they reach: columns node, component.

    Every round points each node at the smallest of itself and its neighbours, follows those pointers twice more,
    and replaces the edges by edges between the nodes pointed at. Edges inside a group vanish, so that the table
    shrinks by a factor each round and a chain of n nodes ends in about log4(n) rounds. Tables are staged
    between rounds, hence a lost executor costs one round. Null ends and self-loops are ignored; an empty
    table gives an empty result.
    """
    edges = _simple(edges.select("src", "dst"), tag)
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        near = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
        step = staged(near.select("node", F.least("node", "least").alias("up")), f"{tag}-step")
        step = staged(_follow(_follow(step, step), step), f"{tag}-step")
        steps.append(step)
        edges = _simple(_renamed(_renamed(edges, step, "src"), step, "dst"), tag)
    if not steps:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    found = steps[0]
    for step in steps[1:]:
        found = _follow(found, step)
    return found.select("node", F.col("up").alias("component"))


def _simple(edges: DataFrame, tag: str) -> DataFrame:
    kept = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return staged(kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), f"{tag}-edges")


def _follow(pointers: DataFrame, step: DataFrame) -> DataFrame:
    """Replace each pointer by where ``step`` takes it."""
    over = step.select(F.col("node").alias("via"), F.col("up").alias("onward"))
    return pointers.join(over, F.col("up") == F.col("via"), "left").select("node", F.coalesce("onward", "up").alias("up"))


def _renamed(edges: DataFrame, step: DataFrame, end: str) -> DataFrame:
    over = step.select(F.col("node").alias("via"), F.col("up").alias("onward"))
    return edges.join(over, F.col(end) == F.col("via"), "left").withColumn(end, F.coalesce("onward", end)).drop("via", "onward")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
