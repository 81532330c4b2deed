"""Packed colours: red in the low byte, then green, blue and alpha."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLEAR = 0x00332211


def pack(r: Column, g: Column, b: Column, a: Column | int = 255) -> Column:
    a = F.lit(a) if isinstance(a, int) else a
    return sum((F.shiftleft(c.cast("long"), s) for c, s in ((g, 8), (b, 16), (a, 24))), r.cast("long"))


def channel(rgba: Column, k: int) -> Column:
    return F.shiftright(rgba, 8 * k).bitwiseAND(F.lit(255).cast("long"))


#: Fixed values of the colour hash: what is added and multiplied first, what is multiplied next, and the two shifts.
HASH_STEP, HASH_FACTOR, HASH_SHIFTS = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (29, 32)
#: Channels of hashed colours begin here and spread over so many values; levels are hashed as their product with this number.
HASH_LOW, HASH_RANGE, LEVEL_STEP = 96, 159, 2654435761


def key_colour(key: int) -> int:
    """A light colour for an unsigned number."""
    wrap = (1 << 64) - 1
    h = (key + HASH_STEP) * HASH_STEP & wrap
    h = (h ^ h >> HASH_SHIFTS[0]) * HASH_FACTOR & wrap
    h ^= h >> HASH_SHIFTS[1]
    r, g, b = (HASH_LOW + (h >> s & 255) * HASH_RANGE // 255 for s in (0, 8, 16))
    return r | g << 8 | b << 16 | 255 << 24


def _product(x: Column, factor: int) -> Column:
    """The low 64 bits of a product, limb by limb, as a product of longs would overflow."""
    limb = [F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")) for k in range(4)]
    by = [factor >> 16 * k & 0xFFFF for k in range(4)]
    out, carry = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(4):
        total = sum((limb[i] * by[k - i] for i in range(k + 1)), carry)
        out = out.bitwiseOR(F.shiftleft(total.bitwiseAND(F.lit(0xFFFF).cast("long")), 16 * k))
        carry = F.shiftright(total, 16)
    return out


def hashed(key: Column) -> Column:
    """``key_colour`` of a column of numbers from 0 to 2**32 - 1. Steps are bound by one-element arrays, so that no expression is written out twice."""
    bound = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    h = _product(key.cast("long") + F.lit(HASH_STEP - (1 << 64)), HASH_STEP)
    h = bound(h, lambda h: _product(h.bitwiseXOR(F.shiftrightunsigned(h, HASH_SHIFTS[0])), HASH_FACTOR))
    h = bound(h, lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, HASH_SHIFTS[1])))
    channels = lambda h: [F.lit(HASH_LOW) + F.floor(channel(h, k) * HASH_RANGE / 255).cast("long") for k in range(3)]
    return bound(h, lambda h: pack(*channels(h)))


def level_colours(levels: int = 21) -> list[int]:
    return [key_colour(level * LEVEL_STEP) for level in range(levels)]


def by_mode(mode: str, rgba: Column, level: Column, code: Column) -> Column:
    """A sample's colour: its own, by level, by node (its code's low 32 bits), or white."""
    if mode == "rgb":
        return rgba
    if mode == "level":
        return F.get(F.array(*[F.lit(c) for c in level_colours()]), level.cast("int"))
    if mode == "node":
        return hashed(code.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    if mode == "white":
        return F.lit(0xFFFFFFFF)
    raise ValueError(f"unknown colour mode {mode}")
