"""What a Python worker keeps between its tasks: one thing, so that the operators of a pipeline don't add up in its memory."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import pyarrow as pa

_KEPT: list[tuple[Hashable, object]] = []


def keep(key: Hashable, make: Callable[[], object]):
    """The thing of this name, made if the worker hasn't got it; whatever else it kept is freed first."""
    if not _KEPT or _KEPT[0][0] != key:
        clear()
        _KEPT.append((key, make()))
    return _KEPT[0][1]


def clear() -> None:
    """Frees what is kept, and what Arrow holds without need. Operators that keep nothing call it when a task begins."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
