"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of edges(a long, b long) with its component.

    Returns node, root: nodes share a root just when a path joins them.
    Nodes without an edge to another node are absent.

    Randomised contraction: each round maps a node to the first, in an order
    hashed anew each round, of itself and its neighbours, and relabels the
    edges. A node and its image are neighbours, so paths survive; every round
    removes a constant share of the nodes in expectation, so the number of
    rounds is logarithmic. Every round is a grouped minimum with map-side
    combine and joins of written tables, which AQE can split where a node has
    very many edges. Null ends are ignored; an empty table gives an empty one.
    """
    live = materialize(_contracted(edges.select("a", "b")), "cc-edges")
    steps: list[DataFrame] = []
    while not live.isEmpty():
        seed = len(steps)
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            live.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        first = both.groupBy("node").agg(F.min(_rank("other", seed)).alias("near"))
        step = materialize(
            first.select("node", F.least("near", _rank("node", seed))["id"].alias("parent")), "cc-step"
        )
        steps.append(step)
        to_a = step.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = step.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = live.join(to_a, "a").join(to_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        live = materialize(_contracted(moved), "cc-edges")
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = steps[0].select("node", F.col("parent").alias("root"))
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("root"), "parent")
        labels = labels.join(onward, "root", "left").select(
            "node", F.coalesce("parent", "root").alias("root")
        )
    return materialize(labels, "cc-labels")


def extended_components(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """connected_components() of the edges that labels (node, root) come from and of further ones.

    Only the further edges, between the components so far, are contracted;
    labels None stands for no edges.
    """
    if labels is None:
        return connected_components(edges)
    to_a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    to_b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")
    )
    onward = connected_components(between)
    moved = labels.join(onward.select(F.col("node").alias("root"), F.col("root").alias("parent")), "root", "left")
    added = onward.join(labels.select("node"), "node", "left_anti")
    return materialize(moved.select("node", F.coalesce("parent", "root").alias("root")).unionByName(added), "cc-labels")


def _rank(name: str, seed: int) -> Column:
    return F.struct(F.xxhash64(F.col(name), F.lit(seed)).alias("h"), F.col(name).alias("id"))


def _contracted(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
