"""Score distributions, calibration and error analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.functions.numeric import thresholds
from phrasebench.session import cut_lineage


def histogram(df: DataFrame, col: str, bins: int, by: list[str] | None = None, density: bool = False) -> DataFrame:
    """(bin, lo, hi, n[, density]) of equal-width bins over the column's range; empty bins are left out.

    With ``by`` the range is taken per key, as separate histograms would. The ranges table has one row
    per key and is written first, so Spark knows its size and a hot key is not shuffled to one task.
    """
    by = by or []
    vals = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_x"))
    if by:
        ranges = vals.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n"))
        ranges = cut_lineage(ranges)
        vals = vals.join(ranges, by)
    else:
        facts = vals.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count("*").alias("n"))).scalar()
        vals = vals.withColumns({"_lo": facts["lo"], "_hi": facts["hi"], "_n": facts["n"]})
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_lo")) / width))).otherwise(0)
    placed = vals.withColumns({"bin": place.cast("int"), "_w": width})
    out = placed.groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.max("_lo").alias("_lo"), F.max("_w").alias("_w"), F.max("_n").alias("_n"))
    out = out.withColumns({"lo": F.col("_lo") + F.col("bin") * F.col("_w"),
                           "hi": F.col("_lo") + (F.col("bin") + 1) * F.col("_w")})
    if density:
        out = out.withColumn("density", F.col("n") / (F.col("_n") * F.col("_w")))
    return out.drop("_lo", "_w", "_n")


def kde(df: DataFrame, col: str, points: int = 100, cut: float = 3.0, steps: int | None = 1024) -> DataFrame:
    """(i, x, density): Gaussian kernel density with Scott's bandwidth h on an even grid.

    Values are first dealt linearly to places h / ``steps`` apart, combined before the shuffle; each place then meets the
    grid points within nine bandwidths. The work after that does not depend on the number of rows or of distinct
    values, and the density is off by at most 0.05 / (h · steps²). ``steps=None`` is the exact path, where each
    distinct value meets every grid point.
    """
    vals = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_x"))
    # one row of four numbers, so that the rows below need no subquery
    h, lo, hi, n = vals.agg(F.stddev_samp("_x") * F.pow(F.count("*"), F.lit(-0.2)), F.min("_x"), F.max("_x"), F.count("*")).first()
    h = h or 0.0
    if not n or not h > 0:  # nothing to smooth: no rows, one value, or one row
        return df.sparkSession.createDataFrame([], "i int, x double, density double")
    start, end = lo - cut * h, hi + cut * h
    step = (end - start) / (points - 1)
    if steps is None:
        counted = vals.groupBy("_x").agg(F.count("*").alias("_c"))
        first, last = F.lit(0), F.lit(points - 1)
    else:
        at = (F.col("_x") - F.lit(lo)) / F.lit(h / steps)
        share = at - F.floor(at)
        halves = F.array(F.struct(F.floor(at).alias("_b"), (1 - share).alias("_w")), F.struct((F.floor(at) + 1).alias("_b"), share.alias("_w")))
        dealt = vals.select(F.inline(halves)).where("_w > 0").groupBy("_b").agg(F.sum("_w").alias("_c"))
        counted = dealt.select((F.lit(lo) + F.col("_b") * F.lit(h / steps)).alias("_x"), "_c")
        near = lambda side: F.floor((F.col("_x") + F.lit(side * 9 * h) - F.lit(start)) / F.lit(step)).cast("int")
        first, last = F.greatest(F.lit(0), near(-1)), F.least(F.lit(points - 1), near(1) + 1)
    met = counted.withColumn("i", F.explode(F.sequence(first, last)))
    x = F.lit(start) + F.lit(end - start) * F.col("i") / F.lit(points - 1)
    z = (x - F.col("_x")) / F.lit(h)
    root = 2.5066282746310002  # square root of 2 pi
    sums = met.groupBy("i").agg((F.sum(F.col("_c") * F.exp(-0.5 * z * z)) / F.lit(n * h * root)).alias("density"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    return grid.join(sums, "i", "left").select("i", x.alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))


def outcome_stats(df: DataFrame, score: str, correct: str) -> DataFrame:
    """One row: mean and standard deviation of the score for right and wrong rows, and the gap."""
    ok, bad = F.when(F.col(correct) == 1, F.col(score)), F.when(F.col(correct) == 0, F.col(score))
    stats = df.agg(F.avg(ok).alias("mean_correct"), F.avg(bad).alias("mean_wrong"),
                   F.stddev_samp(ok).alias("std_correct"), F.stddev_samp(bad).alias("std_wrong"))
    return stats.withColumn("gap", F.col("mean_correct") - F.col("mean_wrong"))


def calibration(df: DataFrame, score: str, correct: str, bins: int = 10, min_count: int = 100) -> DataFrame:
    """(bin, mean_score, accuracy, n) for right-closed equal-width bins with at least ``min_count`` rows."""
    vals = df.where(F.col(score).isNotNull())
    facts = vals.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"))).scalar()
    placed = vals.withColumns({"_lo": facts["lo"], "_hi": facts["hi"]})
    at = F.ceil((F.col(score) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))
    placed = placed.withColumn("bin", F.coalesce(F.greatest(F.lit(1), at), F.lit(1)).cast("int"))
    out = placed.groupBy("bin").agg(F.avg(score).alias("mean_score"),
                                    F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return out.where(F.col("n") >= min_count)


def threshold_sweep(df: DataFrame, score: str, correct: str) -> DataFrame:
    """(threshold, n, accuracy, coverage) for 0.50 … 0.95; a threshold no row reaches is skipped.

    A row is placed once, at the highest threshold it reaches; ten counters are then accumulated.
    """
    ts = thresholds()
    reach = F.size(F.filter(ts, lambda t: F.col(score) >= t))
    at = df.groupBy(reach.alias("_r")).agg(F.count("*").alias("_n"), F.sum(F.col(correct)).alias("_ok"))
    at = cut_lineage(at)  # at most eleven rows
    total = at.agg(F.sum("_n")).scalar()
    grid = at.withColumn("_i", F.explode_outer(F.when(F.col("_r") > 0, F.sequence(F.lit(0), F.col("_r") - 1))))
    grid = grid.where(F.col("_i").isNotNull())
    out = grid.groupBy(F.get(ts, F.col("_i")).alias("threshold")).agg(
        F.sum("_n").alias("n"), F.sum("_ok").alias("_k"))
    return out.select("threshold", "n", (F.col("_k") / F.col("n")).alias("accuracy"),
                      (F.col("n") / total).alias("coverage"))


def outcome(rank: str, k: int = 5) -> Column:
    r = F.col(rank)
    return F.when(r == 1, "correct").when(r <= k, "retrieved_misranked").otherwise("not_retrieved")


def shares(df: DataFrame, by: list[str], places: Column | None = None) -> DataFrame:
    """Rows and percentage per value."""
    counts = cut_lineage(df.groupBy(*by).agg(F.count("*").alias("n")))
    return counts.withColumn("pct", F.col("n") / counts.agg(F.sum("n")).scalar() * 100)


def hardest(df: DataFrame, keep: Column, score: str, key: str, n: int) -> DataFrame:
    """Top ``n`` rows by score among those that satisfy ``keep``."""
    return df.where(keep).orderBy(F.desc(score), key).limit(n)
