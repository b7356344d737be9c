"""A store that lives as long as a Python worker."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType


def once_per_worker(key, make: Callable):
    """``make()``, once per worker process and ``key``; only the newest value is kept.

    Functions are sent by value, so a module-level dictionary of this package would start empty in every task.
    """
    store = sys.modules.setdefault("_phrasebench_newest", ModuleType("_phrasebench_newest")).__dict__
    if store.get("key") != key:
        store["value"], store["key"] = make(), key
    return store["value"]
