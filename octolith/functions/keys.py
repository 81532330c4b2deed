"""Octree keys as bit arithmetic on longs: 20 bits an axis, x highest in each group of three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.config import MAX_DEPTH

CELLS = 1 << MAX_DEPTH
#: Shifts and masks that put two zero bits between the bits of a 20-bit number.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _and(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask).cast("long"))


def gather(code: Column, axis: int) -> Column:
    """The coordinate (0: x, 1: y, 2: z) of a code; undoes ``with_morton``. For nodes: it is short where many expressions are built on it, not fast."""
    bit = lambda i: F.call_function("shiftleft", _and(F.call_function("shiftright", code, (i * 3 + (2 - axis)).cast("int")), 1), i)
    return F.aggregate(F.sequence(F.lit(0), F.lit(MAX_DEPTH - 1)), F.lit(0).cast("long"), lambda total, i: total.bitwiseOR(bit(i)))


def with_morton(df: DataFrame, name: str, cells: list[Column]) -> DataFrame:
    """Adds the key of three 20-bit cell numbers. Their bits are spread step by step in columns of their own: nested in one expression each step would double it."""
    parts = [f"__{name}_{k}" for k in range(3)]
    df = df.withColumns({p: c.cast("long") for p, c in zip(parts, cells)})
    for shift, mask in SPREAD:
        df = df.withColumns({p: _and(F.col(p).bitwiseOR(F.shiftleft(p, shift)), mask) for p in parts})
    x, y, z = (F.col(p) for p in parts)
    return df.withColumn(name, F.shiftleft(x, 2).bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(z)).drop(*parts)


def unit(c: Column, low: Column, size: Column) -> Column:
    return (c - low) / size


def wrapped(u: Column, bits: int = MAX_DEPTH) -> Column:
    """The cell of a coordinate in [0, 1]; 1 itself wraps to cell 0, as tree and sample grids have it."""
    return _and(F.floor(u * F.lit(float(1 << bits))).cast("long"), (1 << bits) - 1)


def clamped(u: Column) -> Column:
    """The cell of a coordinate in [0, 1]; 1 itself stays in the last cell, as the statistics have it."""
    return F.greatest(F.lit(0), F.least(F.floor(u * F.lit(float(CELLS))).cast("long"), F.lit(CELLS - 1))).cast("long")


def at_level(code: Column, level) -> Column:
    """The key of the ancestor at a level (a number or a column) of a code at full depth."""
    if isinstance(level, int):
        return F.shiftright(code, 3 * (MAX_DEPTH - level))
    return F.call_function("shiftright", code, (F.lit(3 * MAX_DEPTH) - level * 3).cast("int"))


def name(level: Column, code: Column) -> Column:
    """``r`` and the octants from the root down."""
    digits = F.lpad(F.conv(code.cast("string"), 10, 8), MAX_DEPTH + 1, "0")
    return F.concat(F.lit("r"), F.substring(digits, F.lit(MAX_DEPTH + 2) - level, level))
