"""The octree of a cloud in closed form: a cell is an inner node if and only if it holds more points than the threshold.

The set of inner nodes depends on the points alone, not on their order or on batches, so the tree
is a few aggregations over keys. Counts are taken band by band from the top: only points in cells
that are over the threshold at the end of a band are counted in the next one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.config import CHUNK_POINTS, MAX_DEPTH, NODE_CAPACITY, TreeParams
from octolith.functions import keys

BANDS = (7, 14, MAX_DEPTH)
#: Up to so many cells of a band are broadcast, in 12 bytes each.
BROADCAST_CELLS = 1_000_000


def pyramid(cells: DataFrame, at: int, low: int) -> DataFrame:
    """``level, code, n`` of all levels from ``low`` to ``at``, from cell counts at level ``at``: each finer count is used again, the points are not."""
    up = F.explode(F.sequence(F.lit(low), F.lit(at))).alias("level")
    df = cells.select("code", "n", up)
    ancestor = F.call_function("shiftright", F.col("code"), ((F.lit(at) - F.col("level")) * 3).cast("int"))
    return df.groupBy("level", ancestor.alias("code")).agg(F.sum("n").alias("n"))


def cells_at(codes: DataFrame, level: int) -> DataFrame:
    return codes.groupBy(keys.at_level(F.col("code"), level).alias("code")).agg(F.count("*").alias("n"))


def band_ends(depth: int) -> list[int]:
    """Ends of the bands of levels that can have inner nodes, in a tree of that depth."""
    return [b for b in BANDS if b < depth - 1] + [depth - 1]


def counts(codes: DataFrame, params: TreeParams) -> DataFrame:
    """``level, code, n`` of all cells whose parent can be an inner node (and of some others).

    The first band has at most 8**7 cells at its end whatever the number of points, so it is kept;
    most trees end within it. Only if cells at its end are over the threshold are further bands planned.
    """
    first = min(BANDS[0], params.max_depth)
    out = pyramid(cells_at(codes, first), first, 0).persist()
    full = out.where((F.col("level") == first) & (F.col("n") > params.threshold))
    if first == params.max_depth or full.isEmpty():
        return out
    low, left, over = first, codes.select("code"), full.select(F.col("code").alias("over"))
    for at in [b for b in BANDS[1:] if b < params.max_depth] + [params.max_depth]:
        left = left.join(over, keys.at_level(F.col("code"), low) == F.col("over"), "left_semi")
        cells = cells_at(left, at)
        out = out.unionByName(pyramid(cells, at, low + 1))
        over = cells.where(F.col("n") > params.threshold).select(F.col("code").alias("over"))
        low = at
    return out


@dataclass
class Tree:
    """``cells``: counts by level and code. ``inner``: keys of inner nodes, kept in memory once they are known, so that the optimizer sees their size and broadcasts them only if they are small."""

    params: TreeParams
    cells: DataFrame
    inner: DataFrame
    codes: DataFrame = field(repr=False)
    fixed: bool = False

    @classmethod
    def adaptive(cls, keyed: DataFrame, params: TreeParams) -> Tree:
        cells = counts(keyed, params)
        over = (F.col("n") > params.threshold) & (F.col("level") < params.max_depth)
        return cls(params, cells, cells.where(over).select("level", "code"), keyed)

    @classmethod
    def fixed_depth(cls, keyed: DataFrame, depth: int) -> Tree:
        """Every occupied cell above ``depth`` is split."""
        cells = pyramid(cells_at(keyed, depth), depth, 0)
        return cls(TreeParams(0, depth), cells, cells.where(F.col("level") < depth).select("level", "code"), keyed, True)

    def settle(self) -> Tree:
        """Computes the inner nodes now, and keeps them."""
        self.inner = self.inner.persist()
        self.inner.count()
        return self

    def nodes(self) -> DataFrame:
        """``level, code, n, is_inner`` of the root and of all eight children of inner nodes, empty ones too."""
        children = self.inner.select((F.col("level") + 1).alias("level"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda o: F.shiftleft(F.col("code"), 3) + o)).alias("code"))
        root = self.inner.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("code"))
        every = root.unionByName(children).join(self.cells, ["level", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        over = (F.col("n") > self.params.threshold) & (F.col("level") < self.params.max_depth)
        return every.withColumn("is_inner", over)

    def described(self) -> DataFrame:
        """Nodes with their coordinates, name and points of their own."""
        df = self.nodes()
        return df.select("level", "code", *[keys.gather(F.col("code"), k).alias(a) for k, a in enumerate(("cx", "cy", "cz"))], "n", "is_inner", (~F.col("is_inner")).alias("is_leaf"), F.when(F.col("is_inner"), 0).otherwise(F.col("n")).alias("num_points"), keys.name(F.col("level"), F.col("code")).alias("name"))

    def leaves(self) -> DataFrame:
        return self.nodes().where(~F.col("is_inner")).select("level", "code", "n")

    def stats(self) -> DataFrame:
        """One row of counts over the nodes, with the flag of a full node pool."""
        n, leaf = F.col("n"), ~F.col("is_inner")
        chunks = F.ceil(n / CHUNK_POINTS)
        return self.nodes().agg(
            F.count("*").alias("nodes"), F.count_if("is_inner").alias("inner_nodes"), F.count_if(leaf).alias("leaves"), F.count_if(leaf & (n > 0)).alias("nonempty_leaves"),
            F.sum(F.when(leaf, n).otherwise(0)).alias("points"), F.max(F.when(leaf, n)).alias("max_points_per_leaf"), F.max("level").cast("long").alias("depth"),
            F.sum(F.when(leaf, chunks).otherwise(0)).cast("long").alias("point_chunks"), (F.count("*") > NODE_CAPACITY).alias("over_capacity"),
        )

    def level_histogram(self) -> DataFrame:
        return self.nodes().groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("nodes"), F.count_if("is_inner").alias("inner_nodes"), F.sum(F.when(F.col("is_inner"), 0).otherwise(F.col("n"))).alias("points"))

    def _found(self, low: int, end: int) -> DataFrame:
        """``cell, found``: for each counted cell at level ``end`` how many of its ancestors from level ``low`` on are inner nodes. Ancestors of inner nodes are inner nodes, so this tells the leaf."""
        cells = self.cells.where(F.col("level") == end).select(F.col("code").alias("cell"))
        up = cells.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(end - 1))))
        up = up.withColumn("code", F.call_function("shiftright", F.col("cell"), ((F.lit(end) - F.col("level")) * 3).cast("int")))
        return up.join(self.inner, ["level", "code"], "left_semi").groupBy("cell").agg(F.count("*").cast("int").alias("found"))

    def assigned(self, points: DataFrame | None = None) -> DataFrame:
        """Each point with the ``level`` and ``leaf`` of the leaf that holds it: one level below its deepest inner ancestor.

        A point is looked up once for each band of levels, at most three times, by its cell at the
        band's end; most trees end within the first band. While a band's cells are few they are
        broadcast and points don't move.
        """
        df = self.codes if points is None else points
        deepest = self.inner.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0]
        level, low = F.lit(0), 0
        for end in [b for b in BANDS if b <= deepest] + [deepest + 1] * (deepest >= 0):
            found = self._found(low, end).withColumnsRenamed({"cell": f"cell{end}", "found": f"found{end}"}).persist()
            if found.count() <= BROADCAST_CELLS:
                found = F.broadcast(found)
            df = df.join(found, keys.at_level(F.col("code"), end) == F.col(f"cell{end}"), "left")
            level, low = level + F.coalesce(f"found{end}", F.lit(0)), end
        df = df.withColumn("level", level)
        df = df.drop(*[c for c in df.columns if c.startswith(("cell", "found")) and c not in (self.codes if points is None else points).columns])
        return df.withColumn("leaf", keys.at_level(F.col("code"), F.col("level")))

    def close(self) -> None:
        """Frees what is kept of the tree."""
        self.inner.unpersist()
        self.cells.unpersist()
