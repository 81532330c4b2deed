"""A generated cloud: a coloured box shell and a helix inside it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HELIX_COLOUR = 0xFF20E0FF


def cloud(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Seven eighths of the points on the shell of a cube of edge 100 (2 thick), one eighth on a helix of six turns.

    Each number is a hash of the seed and the point's index, so any split of the work gives the same cloud.
    """
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed * 16 + k), "id"), F.lit(1 << 40)) / float(1 << 40)
    df = spark.range(n).withColumns({f"u{k}": u(k) for k in range(5)})
    shell = F.col("id") < n - n // 8
    face, depth = F.floor(F.col("u0") * 6), F.col("u3") * 0.02
    place = []
    for k in range(3):
        free = F.col("u1") if k == 0 else F.col("u2")
        fixed = F.when(face == 2 * k, depth).when(face == 2 * k + 1, 1 - depth)
        place.append(fixed.otherwise(free if k < 2 else F.when(F.floor(face / 2) == 0, F.col("u1")).otherwise(F.col("u2"))))
    turn = F.col("u0") * (6 * 2 * math.pi)
    radius = 0.35 + (F.col("u1") - 0.5) * 0.012
    helix = [0.5 + radius * F.cos(turn), 0.5 + radius * F.sin(turn), F.col("u0")]
    at = [F.when(shell, s).otherwise(h) for s, h in zip(place, helix)]
    byte = lambda c: F.floor(F.least(c, F.lit(0.999999)) * 256).cast("long")
    tint = byte(at[0]) + F.shiftleft(byte(at[1]), 8) + F.shiftleft(byte(at[2]), 16) + F.lit(255 << 24).cast("long")
    return df.select(F.col("id").alias("seq"), *[(c * 100).alias(a) for a, c in zip("xyz", at)], F.when(shell, tint).otherwise(F.lit(HELIX_COLOUR).cast("long")).alias("rgba"))
