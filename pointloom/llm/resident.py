"""What a Python worker keeps from task to task: one large thing at a time.

Workers outlive stages, so a stage would otherwise carry the tables that earlier ones have loaded.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_held: dict[Hashable, Any] = {}


def keep(key: Hashable, make: Callable[[], Any]) -> Any:
    """The thing of this key, made if it isn't held; whatever else was held goes first."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    _held.clear()
