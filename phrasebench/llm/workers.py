"""Helpers for code that runs in Python workers."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType


def cached(key, make: Callable):
    """``make()``, once per worker process and ``key``; functions are sent by value, so a module-level
    dictionary of this package would start empty in every task."""
    store = sys.modules.setdefault("_phrasebench_worker_store", ModuleType("_phrasebench_worker_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
