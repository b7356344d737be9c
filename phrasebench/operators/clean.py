"""Projections, filters and derived columns on example tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.fixed import LABELS, SURE
from phrasebench.functions.text import strip_all


def not_empty(col: str) -> Column:
    return F.coalesce(strip_all(col) != "", F.lit(False))


def number_or_null(col: str) -> Column:
    return F.expr(f"try_cast(`{col}` AS DOUBLE)")


def map_values(col: str, mapping: dict, default: Column | None = None) -> Column:
    """Look a value up in a fixed mapping; ``default`` (or null) when it is not there."""
    out = None
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, F.lit(v)) if out is None else out.when(F.col(col) == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def fallback_key(*cols: str) -> Column:
    return F.coalesce(*[F.col(c) for c in cols])


def contains_column(text: str, part: str) -> Column:
    """Case-insensitive: does one column's text hold another column's text?"""
    return F.coalesce(F.contains(F.lower(F.col(text)), F.lower(F.col(part))), F.lit(False))


def quality_funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(position, stage, n): rows left after each cumulative filter, counted in one pass."""
    cond, aggs = F.lit(True), []
    for name, keep in stages:
        cond = cond & F.coalesce(keep, F.lit(False))
        aggs.append(F.count_if(cond).alias(name))
    counts = df.agg(*aggs)
    pairs = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("stage"), F.col(n).alias("n"))
             for i, (n, _) in enumerate(stages)]
    return counts.select(F.inline(F.array(*pairs)))


def weak_flags(label: str, confidence: str, threshold: float = SURE) -> list[Column]:
    """Literal-usage note and low-confidence flag; the literal note wins."""
    note = F.when(F.col(label) == LABELS[0], "literal_note").when(
        F.col(confidence) < threshold, "low_confidence").otherwise("none")
    return [note.alias("note"), (F.col(confidence) < threshold).alias("ambiguous")]
