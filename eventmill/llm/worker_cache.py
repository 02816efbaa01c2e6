"""The one large table that a Python worker keeps between tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_held: dict[str, object] = {}


def kept(key: str, build: Callable[[], T]) -> T:
    """The object built for ``key``; asking for another key lets the last one go, as workers are shared."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]
