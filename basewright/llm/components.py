"""Connected components as DataFrame operations; nothing is gathered on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import forget, heavy_keys, materialise, salted

#: Edges that one task solves at once (16 MB of them).
CHUNK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node of each one's component.

    Roots hook onto the smallest root that an edge leads to, then all paths are
    shortened, until no edge leads to another root.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        live = x != y
        if not live.any():
            return nodes, nodes[root]
        x, y = x[live], y[live]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def _forests(edges: DataFrame, chunk: int) -> DataFrame:
    """node, root by forests of at most ``chunk`` edges each (and a batch)."""

    def run(batches):
        import pyarrow as pa

        def solved(held):
            nodes, roots = forest(*[np.concatenate([x[i] for x in held]) for i in range(2)])
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(2)])
            size += batch.num_rows
            if size >= chunk:
                yield solved(held)
                held, size = [], 0
        if size:
            yield solved(held)

    return edges.mapInArrow(run, "node bigint, root bigint")


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), a table without nulls; root is the component's smallest node.

    Tasks first reduce every ``chunk`` edges to their forest, which is the result
    if they all fit one. Otherwise the forests' edges meet in rounds: each takes the
    least label among a node's neighbours and then the label of that label, so
    chains shorten by powers of two. Minima are combined before the shuffle, and
    the joins deal a node with very many edges, or a label of very many nodes, over
    several tasks.
    """
    edges = edges.select("a", "b").filter("a <> b")
    if edges.count() < chunk:
        return materialise(_forests(edges.coalesce(1), chunk), "labels")
    edges = materialise(_forests(edges, chunk).toDF("a", "b"), "forests")
    links = materialise(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links"
    )
    forget(edges)
    hot = heavy_keys(links, "b")
    dealt = salted(links, hot, "b", F.col("a"))
    labels = materialise(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        known = salted(labels.withColumnRenamed("node", "b"), hot, "b")
        near = dealt.join(known, ["b", "salt"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("low"))
        shared = heavy_keys(labels, "root").withColumnRenamed("root", "low")  # labels of very many nodes
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        moved = salted(lower, shared, "low", F.col("node")).join(salted(up, shared, "low"), ["low", "salt"])
        moved = materialise(moved.select("node", "root", F.least("low", "jump").alias("next")), "labels")
        changed = moved.filter("next <> root").head(1)
        forget(labels)
        labels = moved.select("node", F.col("next").alias("root"))
        if not changed:
            forget(links)
            return labels
