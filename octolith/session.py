"""Where intermediate tables of a session go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only in local mode, where none is named, a new one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="octolith-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Runs the plan once and keeps its rows in the shared checkpoint folder, so that rounds built on it don't run it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
