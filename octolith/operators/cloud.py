"""Bounds, translation to the origin, and the keys of points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.functions import keys

AXES = ("x", "y", "z")


def bounds(points: DataFrame) -> DataFrame:
    """One row: ``xmin .. zmax``, the edge ``size`` of the root cube (1 if all points are equal) and ``n``."""
    df = points.agg(*[F.min(a).alias(f"{a}min") for a in AXES], *[F.max(a).alias(f"{a}max") for a in AXES], F.count("*").alias("n"))
    extent = F.greatest(*[F.col(f"{a}max") - F.col(f"{a}min") for a in AXES])
    return df.withColumn("size", F.when(extent > 0, extent).otherwise(F.lit(1.0)))


@dataclass(frozen=True)
class Box:
    """Known bounds: the numbers of :func:`bounds`, worked out by one pass and used as literals from then on."""

    low: tuple[float | None, ...]
    high: tuple[float | None, ...]
    size: float | None
    n: int

    @classmethod
    def of(cls, points: DataFrame) -> Box:
        row = bounds(points).first()
        return cls(tuple(row[f"{a}min"] for a in AXES), tuple(row[f"{a}max"] for a in AXES), row["size"], row["n"])

    @property
    def extent(self) -> tuple[float, ...]:
        return tuple(h - lo for lo, h in zip(self.low, self.high))

    def columns(self) -> dict[str, Column]:
        named = {f"{a}min": v for a, v in zip(AXES, self.low)} | {f"{a}max": v for a, v in zip(AXES, self.high)} | {"size": self.size}
        return {k: F.lit(v).cast("double") for k, v in named.items()}


def with_bounds(points: DataFrame, box: Box) -> DataFrame:
    """Each row with the bounds beside it."""
    return points.withColumns(box.columns())


def translate(points: DataFrame) -> DataFrame:
    """Points moved so that the box begins at the origin."""
    df = with_bounds(points, Box.of(points))
    return df.select("seq", *[(F.col(a) - F.col(f"{a}min")).alias(a) for a in AXES], "rgba")


def quantisation_error(points: DataFrame) -> DataFrame:
    """The worst rounding error of a coordinate kept in 32 bits."""
    box = bounds(points)
    return box.select((F.greatest(*[F.abs(F.col(f"{a}max") - F.col(f"{a}min")) for a in AXES]) * F.lit(2.0**-23)).alias("error"))


def fit_header(header_min: float, header_max: float, observed_min: float, observed_max: float, scale: float) -> tuple[float, float, bool]:
    """A header's bounds of an axis corrected by the observed ones; whether the points have to be read again.

    The minimum only moves if a point lies below it by more than the slack (a step of the scale and
    the rounding error), which changes the translation of every point. The maximum grows at any excess.
    """
    slack = scale + (header_max - header_min) * 2.0**-23
    again = observed_min < header_min - slack
    low = observed_min if again else header_min
    return low, max(header_max, observed_max), again


def header_box(header, observed: Box) -> tuple[Box, bool]:
    """The bounds that a file's header claims, corrected by those of its points; and whether the translation of the points changes by it."""
    if header.low is None:
        return observed, False
    fitted = [fit_header(lo, hi, seen_lo, seen_hi, step) for lo, hi, seen_lo, seen_hi, step in zip(header.low, header.high, observed.low, observed.high, header.scale)]
    low, high = tuple(f[0] for f in fitted), tuple(f[1] for f in fitted)
    return Box(low, high, max(h - lo for lo, h in zip(low, high)) or 1.0, observed.n), any(f[2] for f in fitted)


def _unit(axis: str) -> Column:
    return keys.unit(F.col(axis), F.col(f"{axis}min"), F.col("size"))


def keyed(points: DataFrame, box: Box | None = None) -> DataFrame:
    """Points with unit coordinates ``ux, uy, uz`` in the root cube and their full-depth ``code``."""
    df = with_bounds(points, box or Box.of(points)).withColumns({f"u{a}": _unit(a) for a in AXES})
    return keys.with_morton(df, "code", [keys.wrapped(F.col(f"u{a}")) for a in AXES])


def morton_codes(points: DataFrame) -> DataFrame:
    df = keyed(points)
    return keys.with_morton(df, "code_clamped", [keys.clamped(F.col(f"u{a}")) for a in AXES]).select("seq", "code", "code_clamped")


def octant_paths(points: DataFrame, depth: int) -> DataFrame:
    df = keyed(points)
    return df.select("seq", keys.name(F.lit(depth), keys.at_level(F.col("code"), depth)).alias("path"))
