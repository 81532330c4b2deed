"""A build's report, and a check that every registered query can be planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.config import DRAW_CAPACITY, NODE_CAPACITY
from octolith.operators import budget, voxels
from octolith.plans.pipelines import Built


def build_report(built: Built, budget_bytes: int) -> DataFrame:
    """``name, value`` rows: counts of the tree and its grids, health flags (0 or 1), predicted share of the budget."""
    stats, grid = built.tree.stats(), voxels.stats(built.tree).select("voxels", "voxel_chunks")
    row = stats.crossJoin(F.broadcast(grid)).withColumns({"pipeline": F.lit("report"), "budget": F.lit(budget_bytes).cast("long"), "resident": F.lit(False)})
    row = budget.admission(row).withColumn("voxels", F.coalesce("voxels", F.lit(0)))
    row = row.withColumns({"over_capacity": (F.col("nodes") > NODE_CAPACITY).cast("int"), "over_draw_list": (F.col("nodes") > DRAW_CAPACITY).cast("int"), "nodes_add_up": (F.col("nodes") == 8 * F.col("inner_nodes") + 1).cast("int"), "predicted_percent": F.col("completion") * 100})
    names = ["points", "nodes", "inner_nodes", "leaves", "nonempty_leaves", "max_points_per_leaf", "depth", "point_chunks", "voxels", "over_capacity", "over_draw_list", "nodes_add_up", "predicted_percent", "required_bytes"]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return row.select(F.inline(pairs))


def write_records(records: DataFrame, path: str) -> None:
    """Report or timing rows as newline-delimited JSON."""
    records.write.mode("append").json(path)


def check_queries(spark: SparkSession, sf_dir: str, queries: dict) -> list[tuple[str, str]]:
    """Plans each query without running it; the names and errors of those that fail."""
    failed = []
    for name, f in queries.items():
        try:
            f(spark, sf_dir)._jdf.queryExecution().executedPlan()
        except Exception as e:  # a check reports every failure
            failed.append((name, str(e)))
    return failed
