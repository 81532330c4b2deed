"""Projection, frustum, boxes, segments, and eigenvalues of symmetric 3x3 matrices, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.config import Camera


def clip(camera: Camera, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Clip-space x, y and w of a point."""
    row = lambda k: x * camera.matrix[k][0] + y * camera.matrix[k][1] + z * camera.matrix[k][2] + camera.matrix[k][3]
    return row(0), row(1), row(3)


def to_pixel(camera: Camera, cx: Column, cy: Column, w: Column) -> tuple[Column, Column]:
    """Pixel coordinates, not rounded."""
    return (cx / w * 0.5 + 0.5) * float(camera.width), (cy / w * 0.5 + 0.5) * float(camera.height)


def in_frustum(camera: Camera, low: list[Column], edge: Column) -> Column:
    """Whether a cube reaches into the frustum: for each plane, its corner farthest along the normal is inside."""
    inside = F.lit(True)
    for a, b, c, d in camera.planes():
        far = [lo + edge if n >= 0 else lo for lo, n in zip(low, (a, b, c))]
        inside = inside & (far[0] * a + far[1] * b + far[2] * c + d >= 0)
    return inside


def projected_extent(camera: Camera, low: list[Column], edge: Column) -> tuple[Column, Column]:
    """Width and height in pixels of a cube's corners; those behind the camera are left out, 0 if all are."""
    xs, ys = [], []
    for corner in range(8):
        p = [lo + edge if corner >> k & 1 else lo for k, lo in enumerate(low)]
        cx, cy, w = clip(camera, *p)
        px, py = to_pixel(camera, cx, cy, F.when(w > 0, w))
        xs.append(px)
        ys.append(py)
    return tuple(F.coalesce(F.greatest(*v) - F.least(*v), F.lit(0.0)) for v in (xs, ys))


def with_eigenvalues(df: DataFrame) -> DataFrame:
    """Adds ``e_min, e_mid, e_max`` of the matrices in ``cxx .. czz``, by the trigonometric closed form."""
    c = {k: F.col(f"c{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    df = df.withColumn("q", (c["xx"] + c["yy"] + c["zz"]) / 3)
    d = [c[k] - F.col("q") for k in ("xx", "yy", "zz")]
    off = c["xy"] * c["xy"] + c["xz"] * c["xz"] + c["yz"] * c["yz"]
    df = df.withColumn("p", F.sqrt((d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * off) / 6))
    det = d[0] * (d[1] * d[2] - c["yz"] * c["yz"]) - c["xy"] * (c["xy"] * d[2] - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - d[1] * c["xz"])
    p, q = F.col("p"), F.col("q")
    df = df.withColumn("phi", F.when(p > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (p * p * p) / 2))) / 3).otherwise(0.0))
    phi = F.col("phi")
    df = df.withColumns({"e_max": q + 2 * p * F.cos(phi), "e_min": q + 2 * p * F.cos(phi + 2 * math.pi / 3)})
    return df.withColumn("e_mid", 3 * q - F.col("e_max") - F.col("e_min")).drop("p", "q", "phi")


def with_normals(df: DataFrame) -> DataFrame:
    """Adds ``nx, ny, nz``: the eigenvector of ``e_min``, as the longest cross product of two rows of C - e_min I; its largest component is positive."""
    e = F.col("e_min")
    rows = [[F.col("cxx") - e, F.col("cxy"), F.col("cxz")], [F.col("cxy"), F.col("cyy") - e, F.col("cyz")], [F.col("cxz"), F.col("cyz"), F.col("czz") - e]]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    made = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        v = cross(rows[i], rows[j])
        made.append(F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("l"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z")))
    df = df.withColumn("v", F.greatest(*made))
    length = F.sqrt("v.l")
    size = [F.abs(F.col(f"v.{a}")) for a in "xyz"]
    first = F.when((size[0] >= size[1]) & (size[0] >= size[2]), F.col("v.x")).when(size[1] >= size[2], F.col("v.y")).otherwise(F.col("v.z"))
    sign = F.when(first < 0, -1.0).otherwise(1.0)
    return df.withColumns({f"n{a}": F.when(length > 0, F.col(f"v.{a}") / length * sign).otherwise(0.0) for a in "xyz"}).drop("v")
