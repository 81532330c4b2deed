"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.session import cut, shared_dir

__all__ = ["cut", "partitions", "shared_dir", "spread_join", "table", "temporary"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{PurePosixPath(name).name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def temporary(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: str, *, limit: int = 100_000) -> DataFrame:
    """Inner join on ``key``, of which ``right`` has each value once.

    Keys with over ``limit`` rows of ``left`` are dealt over several tasks by the hash of the column
    ``spread``, and their rows of ``right`` copied to each. There are at most rows / limit such keys,
    so the table of them can be broadcast.
    """
    hot = cut(left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select(F.col(key).alias("__key"), F.ceil(F.col("__n") / limit).cast("int").alias("__parts")))
    if hot.isEmpty():
        return left.join(right, key)
    mark = lambda df: df.join(F.broadcast(hot), df[key].eqNullSafe(F.col("__key")), "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    dealt = mark(left).withColumn("__part", F.pmod(F.xxhash64(spread), F.col("__parts")).cast("int")).drop("__key", "__parts")
    copied = mark(right).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__key", "__parts")
    return dealt.join(copied, [key, "__part"]).drop("__part")
