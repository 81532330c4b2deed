"""Point clouds over tables: ``seq, x, y, z, rgba``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Colours of the values of ``event_type``, and of labels and line states by rank; opaque.
EVENT_COLOURS = {"click": 0xFF3050E0, "error": 0xFF2020FF, "purchase": 0xFF40C040, "signup": 0xFFE0A030, "view": 0xFFB0B0B0}
OTHER_COLOUR = 0xFFFFFFFF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def _points(df: DataFrame, seq: Column, x: Column, y: Column, z: Column, rgba: Column) -> DataFrame:
    """Rows with a null coordinate are no points."""
    out = df.select(seq.cast("long").alias("seq"), x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), rgba.cast("long").alias("rgba"))
    return out.where("x is not null and y is not null and z is not null")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User, value and hours since 2024; in arrival order by ``seq``."""
    df = table(spark, sf_dir, "events")
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0) / F.lit(3600.0) - F.lit(1704067200.0) / F.lit(3600.0)
    colour = F.lit(OTHER_COLOUR)
    for name, value in EVENT_COLOURS.items():
        colour = F.when(F.col("event_type") == name, F.lit(value)).otherwise(colour)
    return _points(df, F.col("event_id"), F.col("user_id"), F.col("value"), hours, colour)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of each vector; coloured by label."""
    df = table(spark, sf_dir, "embeddings")
    part = [F.get("embedding", k).cast("double") for k in range(3)]
    label = F.col("label").cast("long")
    return _points(df, F.col("vec_id"), *part, label * 25 + F.shiftleft(255 - label * 25, 8) + 128 * 65536 + 255 * 16777216)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, quantity and discount of order lines; there is no arrival order, so ``seq`` is null."""
    df = table(spark, sf_dir, "lineitem")
    colour = F.ascii("l_returnflag") + F.shiftleft(F.ascii("l_linestatus"), 8) + F.lit(255 * 16777216).cast("long")
    return _points(df, F.lit(None), F.col("l_extendedprice") / 1000, F.col("l_quantity"), F.col("l_discount") * 1000, colour)
