"""Connected components of an edge table, by spreading the smallest label."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.shared import cut, free


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of `edges` (columns a, b): label is the component's smallest node.

    In every round each node takes the smallest label next to it, then the label that its own
    label has, so that long chains shrink by doubling. Nodes without edges aren't returned;
    edges with a null end, loops and repeated edges change nothing. Each round is written out,
    so a lost executor costs a part of one round only; what the last round no longer needs is
    deleted. The result is such a table, which the caller may free.
    """
    whole = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = whole.select("a", "b").unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label", F.col("label").alias("_old")), "labels")
    while True:
        known = labels.select("node", F.col("label").alias("_label"))
        nearest = both.join(known, F.col("b") == F.col("node")).groupBy("a").agg(F.min("_label").alias("_near"))
        spread = labels.join(nearest, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        spread = cut(spread, "labels")
        onward = spread.select(F.col("node").alias("_node"), F.col("label").alias("_next"))
        jumped = spread.join(onward, F.col("label") == F.col("_node"), "left").select("node", F.least("label", "_next").alias("label"), "_old")
        jumped = cut(jumped, "labels")
        free(labels, spread)
        labels = jumped
        if jumped.where("label < _old").isEmpty():
            free(both)
            out = labels.select("node", "label")
            out.cut_path = labels.cut_path
            return out


def spanning_edges(ids_a: np.ndarray, ids_b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links (rows, cols) join, as few as the ids that have any."""
    nodes, place = np.unique(np.concatenate([ids_a[rows], ids_b[cols]]), return_inverse=True)
    a, b = place[: len(rows)], place[len(rows) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]
