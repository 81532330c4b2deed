"""Timing samples: distributions by scope, phases, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from octolith.session import cut

RECENT = 4096


def scope_stats(samples: DataFrame) -> DataFrame:
    """``scope`` with count, mean, variance (n - 1; 0 for one sample), extremes, the last sample by ``seq``, and the total."""
    ms = F.col("ms")
    return samples.groupBy("scope").agg(F.count("*").alias("n"), F.avg(ms).alias("mean"), F.coalesce(F.var_samp(ms), F.lit(0.0)).alias("variance"), F.min(ms).alias("least"), F.max(ms).alias("most"), F.max_by(ms, "seq").alias("last"), F.sum(ms).alias("total"))


def recent(samples: DataFrame, most: int = RECENT) -> DataFrame:
    """The last samples of each scope; partial limits come before the shuffle."""
    w = Window.partitionBy("scope").orderBy(F.desc("seq"))
    return samples.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most).drop("age")


def percentiles(samples: DataFrame, shares: tuple[float, ...] = (0.5, 0.95, 0.99), most: int = RECENT) -> DataFrame:
    """Nearest-rank percentiles of each scope's recent samples."""
    parts = [F.expr(f"percentile_disc({p}) within group (order by ms)").alias(f"p{round(p * 100)}") for p in shares]
    return recent(samples, most).groupBy("scope").agg(*parts)


def moving(samples: DataFrame, frames: int = 240, run: int = 50_000) -> DataFrame:
    """Mean and maximum over each sample and those just before it, per scope.

    There may be few scopes, so a scope is dealt out in runs of ``run`` samples by their place in
    its order; each run also gets the ``frames - 1`` samples before it.
    """
    ranged = cut(samples.select("scope", "seq", "ms").repartitionByRange("scope", "seq").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("scope", "part").agg(F.count("*").alias("size"))  # a few rows for each partition
    before = F.coalesce(F.sum("size").over(Window.partitionBy("scope").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("scope", "part").orderBy("seq")) - 1
    df = ranged.withColumn("place", place).join(F.broadcast(sizes.select("scope", "part", before.alias("before"))), ["scope", "part"]).withColumn("place", F.col("place") + F.col("before"))
    own = F.floor(F.col("place") / run)
    df = df.withColumn("run", F.explode(F.sequence(own, F.floor((F.col("place") + frames - 1) / run)))).withColumn("own", own == F.col("run"))
    w = Window.partitionBy("scope", "run").orderBy("place").rowsBetween(1 - frames, 0)
    return df.select("scope", "seq", "own", F.avg("ms").over(w).alias("mean"), F.max("ms").over(w).alias("most")).where("own").drop("own")


def phase_durations(marks: DataFrame) -> DataFrame:
    """``phase`` with total, share of all phases and launches, from ``launch, i, phase, ns`` marks: a phase lasts until the next mark of its launch; backward clocks are left out."""
    w = Window.partitionBy("launch").orderBy("i")
    spans = marks.withColumn("span", F.lead("ns").over(w) - F.col("ns")).where("span >= 0")
    total = spans.groupBy("phase").agg(F.sum("span").alias("ns"), F.count("*").alias("spans"), F.count_distinct("launch").alias("launches"))
    every = total.agg(F.sum("ns").alias("every"))
    return total.crossJoin(F.broadcast(every)).select("phase", "ns", "spans", "launches", (F.col("ns") * 100.0 / F.col("every")).alias("percent"))


def throughput(points: Column, ms: Column) -> Column:
    """Million points a second."""
    return points / 1e6 / (ms / 1000.0)


def build_totals(stats: DataFrame, scopes: list[str]) -> DataFrame:
    """One row over the declared scopes: total, count, and whether anything was measured."""
    chosen = stats.where(F.col("scope").isin(scopes))
    return chosen.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("measured", F.col("n") > 0)
