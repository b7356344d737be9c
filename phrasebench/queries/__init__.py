"""Registered queries and, where SQL can say the same, their check SQL."""

from __future__ import annotations

import importlib

from phrasebench.queries.registry import ORACLES, QUERIES

for _name in ("corpus", "text", "splits", "retrieval", "evaluation", "artifacts"):
    importlib.import_module(f"phrasebench.queries.{_name}")

__all__ = ["QUERIES", "ORACLES"]
