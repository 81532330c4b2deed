"""Vectorised word splitting and 64-bit word keys over UTF-8 bytes.

Both word definitions used by the corpus operators are classes of single bytes (every byte of a
non-ASCII character is a word byte), so splitting works on bytes and agrees with the code-point
patterns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240101)
_BYTE_KEYS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
for _c in range(65, 91):  # A-Z share the keys of a-z
    _BYTE_KEYS[_c] = _BYTE_KEYS[_c + 32]
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_POWER_BITS = 16


def _powers() -> np.ndarray:
    out = np.ones(1 << _POWER_BITS, dtype=np.uint64)
    np.multiply.accumulate(np.concatenate([out[:1], np.full(len(out) - 1, _RADIX, np.uint64)]), out=out)
    return out


_POWERS = _powers()


def _byte_class(separators) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: ``[^\x20\x09-\x0D]+``: anything but white space.
SPACED = _byte_class([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: letters, digits and all non-ASCII.
ALNUM = _byte_class([b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)])

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def words(buffer: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a byte array."""
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = word_byte[buffer]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def keys(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key for each word, equal for words that differ only in the case of A-Z.

    Keys are a polynomial in random byte values with a final mix; two given different words share
    a key with a chance of about 2**-60.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _BYTE_KEYS[buffer[within + np.repeat(starts, lengths)]]
    values *= _POWERS[within & ((1 << _POWER_BITS) - 1)]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, a line feed after each row, and each row's first byte (one more at the end). Null is empty."""
    texts = column.to_pylist()
    raw = [(t or "").encode() for t in texts]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    raw.append(b"")
    return np.frombuffer(b"\n".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Cuts a batch into runs of rows of about ``most`` text bytes, never splitting a row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 1
    if start < batch.num_rows:
        yield batch.slice(start)
