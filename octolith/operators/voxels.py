"""Sample grids of inner nodes: the first point of each occupied cell stands for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.config import MAX_DEPTH
from octolith.functions import colour, keys
from octolith.operators.cloud import AXES, Box, with_bounds
from octolith.operators.tree import Tree

_SUMS = ("n", "r", "g", "b")


def _first(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min(F.struct("seq", "rgba")).alias("first"), *[F.sum(c).alias(c) for c in _SUMS])


def cells(tree: Tree) -> DataFrame:
    """``level, node, cell`` with the first point's colour, the number of points and the sums of colours, of every occupied cell of every inner node.

    A cell of a node at level L is an octree cell at level L + grid bits, so coarser cells come
    from finer ones. Grids that reach below full depth are keyed point by point instead.
    """
    bits = tree.params.grid_bits
    deepest = tree.inner.agg(F.max("level")).first()[0]
    points = tree.codes.select("code", *[f"u{a}" for a in AXES], "seq", "rgba", F.lit(1).cast("long").alias("n"), *[colour.channel(F.col("rgba"), k).alias(c) for k, c in enumerate(_SUMS[1:])])
    if deepest is None:
        deepest = -1
    if deepest + bits <= MAX_DEPTH:
        at = max(deepest, 0) + bits
        fine = _first(points.withColumn("code", keys.at_level(F.col("code"), at)), ["code"]).select("code", F.col("first.seq").alias("seq"), F.col("first.rgba").alias("rgba"), *_SUMS)
        # rows of a level stay only below an inner node, before anything is shuffled
        df = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(deepest, 0)))))
        df = df.withColumn("key", F.call_function("shiftright", "code", ((F.lit(at - bits) - F.col("level")) * 3).cast("int")))
        df = df.withColumn("node", F.shiftright("key", 3 * bits))
        inner = tree.inner.select("level", F.col("code").alias("node"))
        df = _first(df.join(inner, ["level", "node"], "left_semi"), ["level", "node", "key"])
        inside = F.col("key").bitwiseAND(F.lit((1 << 3 * bits) - 1).cast("long"))
        index = [keys.gather(inside, k) for k in range(3)]
    else:
        df = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumn("node", keys.at_level(F.col("code"), F.col("level")))
        scale = F.pow(F.lit(2.0), F.col("level") + bits)
        df = df.withColumns({f"v{k}": F.pmod(F.floor(F.col(f"u{a}") * scale).cast("long"), F.lit(1 << bits)) for k, a in enumerate(AXES)})
        df = df.join(tree.inner.select("level", F.col("code").alias("node")), ["level", "node"], "left_semi")
        df = _first(df, ["level", "node", "v0", "v1", "v2"])
        index = [F.col(f"v{k}") for k in range(3)]
    df = df.withColumns({f"i{a}": i for a, i in zip(AXES, index)})
    return df.select("level", "node", *[f"i{a}" for a in AXES], F.col("first.rgba").alias("rgba"), *_SUMS)


def _centre(axis: int, tree: Tree) -> Column:
    a = AXES[axis]
    edge = F.col("size") / F.pow(F.lit(2.0), F.col("level"))
    return F.col(f"{a}min") + keys.gather(F.col("node"), axis) * edge + edge * ((F.col(f"i{a}") + 0.5) / float(1 << tree.params.grid_bits))


def first_come(tree: Tree, box: Box) -> DataFrame:
    """Voxels at their centres with the first point's colour."""
    df = with_bounds(cells(tree), box)
    return df.select("level", "node", "ix", "iy", "iz", *[_centre(k, tree).alias(a) for k, a in enumerate(AXES)], "rgba")


def mean_colour(tree: Tree) -> DataFrame:
    """Voxels with the mean of all their points' colours, which no order of points changes."""
    return cells(tree).select("level", "node", "ix", "iy", "iz", "n", *[(F.col(c) / F.col("n")).alias(f"mean_{c}") for c in _SUMS[1:]])


def counts(tree: Tree) -> DataFrame:
    """Occupied cells of each inner node."""
    return cells(tree).groupBy("level", "node").agg(F.count("*").alias("num_voxels"))


def stats(tree: Tree) -> DataFrame:
    """Voxels over all inner nodes and by node: sum, least, most, mean."""
    return counts(tree).agg(F.sum("num_voxels").alias("voxels"), F.count("*").alias("inner_nodes"), F.min("num_voxels").alias("least"), F.max("num_voxels").alias("most"), F.sum(F.ceil(F.col("num_voxels") / 1000)).cast("long").alias("voxel_chunks"))
