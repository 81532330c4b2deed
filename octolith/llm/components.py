"""Connected components of a graph too large for one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.llm.spark import cut


#: A graph with so few edges left is solved within one task.
FEW = 16_384


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of a small graph, and the smallest of each one's component."""
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, w = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(vertices))
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[w])
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[w], low)
        label = label[label]
        if (label == before).all():
            return vertices, vertices[label]


def _solved(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [[np.asarray(batch.column(c)) for c in "ab"] for batch in batches]
        v, p = solve(*(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2)
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(p)], ["v", "p"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, p long")


def _smaller(edges: DataFrame) -> DataFrame:
    """Each vertex that has a neighbour of smaller priority, with the smallest one. The aggregation is partial, so a hub is no hot key."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    return both.groupBy("v").agg(F.min("w").alias("p")).where("p < v")


def _relabel(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    map_ = parents.select(F.col("v").alias("__v"), F.col("p").alias("__p"))
    return df.join(map_, F.col(column) == F.col("__v"), "left").withColumn(column, F.coalesce("__p", column)).drop("__v", "__p")


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` for each vertex of ``edges(a, b)`` (longs); vertices of one component share a root.

    Rounds of contraction: each vertex hangs itself below its smallest neighbour, chains are
    shortened to the top, and the graph of the tops is next. The numbers of vertices should carry
    no order of the graph (hash them), then each round leaves about half the vertices or fewer.
    As soon as at most ``FEW`` edges are left, one task solves the rest.
    Every round is kept in the shared checkpoint folder. An empty graph gives no rows; loops and
    repeated edges are harmless.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    vertices = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    rounds = []
    while n := edges.count():
        if n <= FEW:
            rounds.append(cut(_solved(edges)))
            break
        parents = cut(_smaller(edges))
        while True:
            jumped = cut(_relabel(parents.withColumn("was", F.col("p")), "p", parents))
            parents = jumped.select("v", "p")
            if jumped.where("p <> was").isEmpty():
                break
        rounds.append(parents)
        edges = _relabel(_relabel(edges, "a", parents), "b", parents).where("a <> b")
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = vertices.withColumn("root", F.col("v"))
    for parents in rounds:
        labels = _relabel(labels, "root", parents)
    return labels
