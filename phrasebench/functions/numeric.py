"""Rounding, scaling, vector and metric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x: Column | str, places: int) -> Column:
    """Half-even rounding done in binary (scale, round, unscale), as numpy does it."""
    scale = float(10 ** places)
    return F.rint(_c(x).cast("double") * F.lit(scale)) / F.lit(scale)


def r6(x: Column | str) -> Column:
    return round_half_even(x, 6)


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, 0 when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")), F.lit(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """Unit vector; null for a zero vector."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: x.cast("double") / n))


def linear_fusion(dense: Column | str, lexical: Column | str, weight: float = 0.8) -> Column:
    return F.lit(weight) * _c(dense) + F.lit(1 - weight) * _c(lexical)


def minmax_scale(x: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """(x - lo) / (hi - lo); 0 when the range is flat."""
    span = _c(hi) - _c(lo)
    return F.when(span < 1e-12, F.lit(0.0)).otherwise((_c(x) - _c(lo)) / span)


def bm25_weight(tf, dl, idf, avgdl, k1: float = 1.5, b: float = 0.75) -> Column:
    tf, dl, idf, avgdl = (_c(v) for v in (tf, dl, idf, avgdl))
    return idf * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def softmax(logits: Column | str) -> Column:
    """Class probabilities of a logit array, shifted by the maximum."""
    top = F.array_max(_c(logits))
    powers = F.transform(_c(logits), lambda x: F.exp(x - top))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def arg_max(values: Column | str) -> Column:
    """Zero-based place of the first maximum."""
    return (F.array_position(_c(values), F.array_max(_c(values))) - 1).cast("int")


def reciprocal_rank(items: Column | str, gold: Column | str) -> Column:
    """1 / place of gold in the list, 0 when it is absent."""
    place = F.coalesce(F.array_position(_c(items), _c(gold)), F.lit(0))
    return F.when(place > 0, F.lit(1.0) / place).otherwise(F.lit(0.0))


def gold_in_first(items: Column | str, gold: Column | str, k: int) -> Column:
    return F.coalesce(F.array_contains(F.slice(_c(items), 1, k), _c(gold)), F.lit(False)).cast("int")


def equal_flag(pred: Column | str, gold: Column | str) -> Column:
    return (_c(pred) == _c(gold)).cast("int")


def thresholds(first: float = 0.50, step: float = 0.05, count: int = 10) -> Column:
    """Evenly spaced thresholds as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)),
                       lambda i: round_half_even(F.lit(first) + F.lit(step) * i, 2))
