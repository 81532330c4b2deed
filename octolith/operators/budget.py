"""Memory budgets: whether a cloud is admitted, and how much of it would be built."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.config import BATCH_POINTS, RING_SLOTS

POINT_BYTES = 16
#: Fixed values of the model: bytes a point at least and at ease, the smallest store, the margin of the store, the fixed overhead.
FLOOR_BYTES, EASE_BYTES = 26, 48
MIN_STORE = 512 << 20
MARGIN = 200_000_000
FIXED = (512 << 20) + 200_000 * (152 + 112)
RESIDENT_LIMIT = RING_SLOTS * BATCH_POINTS


def admission(requests: DataFrame) -> DataFrame:
    """For ``pipeline, points, budget, resident`` rows: the bytes each needs, whether it is admitted, why not, and the predicted share.

    A pipeline that can build a partial tree is refused only if the ring, the fixed overhead and
    the smallest store don't fit.
    """
    n = F.col("points")
    slots = F.least(F.lit(RING_SLOTS), F.ceil(n / BATCH_POINTS))
    df = requests.withColumn("input_bytes", F.when(F.col("resident"), n * POINT_BYTES).otherwise(slots * BATCH_POINTS * POINT_BYTES).cast("long"))
    overhead = F.col("input_bytes") + FIXED
    df = df.withColumns({"required_bytes": n * FLOOR_BYTES + overhead, "refusal_floor": overhead + MIN_STORE})
    df = df.withColumn("fits", F.col("refusal_floor") <= F.col("budget"))
    usable = F.least(n * EASE_BYTES, F.greatest(F.lit(0), F.col("budget") - overhead)) - MARGIN
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.lit(0), usable) / float(FLOOR_BYTES) / n))
    df = df.withColumn("completion", F.when(n == 0, 1.0).otherwise(share))
    store = F.least(F.greatest(n * EASE_BYTES, F.lit(MIN_STORE)), F.greatest(F.lit(0), F.col("budget") - overhead))
    too_many = F.col("resident") & (n > RESIDENT_LIMIT)
    reason = F.when(~F.col("fits"), "below the smallest budget").when(too_many, "a resident cloud of more points than the ring addresses").otherwise("")
    warning = F.when(F.col("completion") < 0.999, "ingest will stop early").otherwise("")
    return df.withColumns({"store_bytes": store, "admitted": F.col("fits") & ~too_many, "reason": reason, "warning": warning})


def usable_budget(free_bytes: int, pinned: int = 0) -> int:
    """85 % of what is free beyond 512 MiB, unless a budget is pinned."""
    return pinned or (int((free_bytes - (512 << 20)) * 0.85) if free_bytes > 512 << 20 else 0)


def parse_bytes(text: str) -> int:
    """``9G`` is decimal, ``8Gi`` binary; a trailing B may follow the unit and stand before the i."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)[ \t]*(?:([kKmMgG])[bB]?([iI])?|[bB]?)", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    base = 1024 if m[3] else 1000
    return int(float(m[1]) * base ** ("kmg".index(m[2].lower()) + 1 if m[2] else 0))
