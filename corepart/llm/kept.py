"""Values that a worker process makes once and keeps for its later tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from typing import Any

MOST = 8  # values kept at a time


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The value under this key, made when it isn't there; the oldest go beyond MOST.

    Functions reach a task by value, with fresh globals, so neither a global nor lru_cache would
    do: one is empty in each task, the other is looked up in a module that workers may not have.
    """
    values = vars(sys).setdefault("_corepart_kept", {})
    if key not in values:
        while len(values) >= MOST:
            values.pop(next(iter(values)))
        values[key] = make()
    return values[key]
