"""State that outlives a task: models and caches kept once per Python worker."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable
from typing import TypeVar

from pyspark import cloudpickle

T = TypeVar("T")

# Functions travel to workers by value, each with its own globals, so the shelf hangs on a module of its own.
SHELF = "_bitextry_worker_shelf"
KEPT = 2


def once(kind: str, key: str, build: Callable[[], T], kept: int = KEPT) -> T:
    """The value of ``build()``, made at the first call with ``kind`` and ``key`` in this process and kept.

    A worker serves many jobs; of each kind it keeps the ``kept`` values that were used last.
    """
    shelves = sys.modules.setdefault(SHELF, types.ModuleType(SHELF)).__dict__.setdefault("kinds", {})
    shelf = shelves.setdefault(kind, {})
    found, value = key in shelf, shelf.pop(key, None)
    # Room is made first, so that the old and the new value need not fit side by side.
    while len(shelf) >= kept:
        shelf.pop(next(iter(shelf)))
    shelf[key] = value if found else build()
    value = shelf[key]
    return value


def content_key(*parts: object) -> str:
    """A key for what is made from ``parts``: the same for equal ones, so that later jobs find it."""
    return hashlib.md5(cloudpickle.dumps(parts)).hexdigest()
