"""Deterministic orders that scale: keyed hash order, global ranks and running sums.

A row's place in a "shuffle" is the md5 of ``seed|key``, so samples and splits repeat on any
cluster. Nothing here sorts a whole table, or one whole group, in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phrasebench.session import cut_lineage

#: Hex digits of the hash that name a bucket: 65,536 buckets globally, 4,096 inside a group.
GLOBAL_DIGITS = 4
GROUP_DIGITS = 3
_LOW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def hash_order(*keys: Column | str, seed: int = 42) -> Column:
    """Portable pseudo-random sort key: md5 of ``seed|key|...`` as hex text."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def hash_number(hashed: Column, start: int = 1) -> Column:
    """Eight hex digits of a hash as a number."""
    return F.conv(F.substring(hashed, start, 8), 16, 10).cast("long")


def hash_threshold(keys: DataFrame, hash_col: str, wanted) -> Column:
    """Hash value of the n-th smallest key, as a scalar subquery; null when n is 0.

    ``wanted`` maps the total number of keys (a Column) to n. Buckets are counted first, so
    only the one bucket that holds the n-th key is ever sorted.
    """
    bucket = F.substring(hash_col, 1, GLOBAL_DIGITS)
    counts = keys.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_c"))
    # at most 16**GLOBAL_DIGITS rows, so one task is enough
    running = W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edge = (
        counts.withColumn("_cum", F.sum("_c").over(running))
        .withColumn("_n", wanted(F.sum("_c").over(whole)).cast("long"))
        .where((F.col("_cum") >= F.col("_n")) & (F.col("_cum") - F.col("_c") < F.col("_n")))
        .select("_b", (F.col("_n") - F.col("_cum") + F.col("_c")).alias("_left"))
    )
    inside = keys.select(bucket.alias("_b"), F.col(hash_col).alias("_h")).join(F.broadcast(edge), "_b")
    place = F.row_number().over(W.partitionBy("_b").orderBy("_h"))
    hit = inside.withColumn("_p", place).where(F.col("_p") == F.col("_left"))
    return hit.agg(F.max("_h")).scalar()


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by hash order of a unique ``key``."""
    hashed = df.withColumn("_h", hash_order(key, seed=seed))
    limit = hash_threshold(hashed.select("_h"), "_h", lambda total: F.least(total, F.lit(n)))
    return hashed.where(F.col("_h") <= limit).drop("_h")


def rank_in_group(df: DataFrame, group: list[str], key: str, seed: int = 42,
                  rank: str = "rank_in_group", size: str = "group_size") -> DataFrame:
    """1-based hash-order rank of every row inside its group, and the group's size.

    A group is cut into hash buckets; rows are ranked inside (group, bucket) and shifted by the
    number of rows in earlier buckets. A group with a third of all rows is thus spread over
    4,096 keys, and the join that brings the shift uses the same salted key.
    """
    hashed = df.where(_all_set(group)).withColumn("_h", hash_order(key, seed=seed))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, GROUP_DIGITS))
    by_group = W.partitionBy(*group)
    shifts = (
        hashed.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
        .withColumn("_off", F.sum("_c").over(
            by_group.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_c"))
        .withColumn(size, F.sum("_c").over(by_group))
        .drop("_c")
    )
    local = F.row_number().over(W.partitionBy(*group, "_b").orderBy("_h", key))
    return (
        hashed.withColumn("_r", local).join(shifts, [*group, "_b"])
        .withColumn(rank, F.col("_off") + F.col("_r"))
        .drop("_h", "_b", "_r", "_off")
    )


def shuffle_rank(df: DataFrame, key: str, seed: int = 42, rank: str = "shuffle_rank") -> DataFrame:
    """Place of every row in the full shuffle (1..n), ranked bucket by bucket."""
    hashed = df.withColumn("_h", hash_order(key, seed=seed))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, GLOBAL_DIGITS))
    counts = hashed.groupBy("_b").agg(F.count("*").alias("_c"))  # at most 65,536 rows
    running = W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    shifts = counts.select("_b", (F.sum("_c").over(running) - F.col("_c")).alias("_off"))
    local = F.row_number().over(W.partitionBy("_b").orderBy("_h", key))
    return (
        hashed.withColumn("_r", local).join(F.broadcast(shifts), "_b")
        .withColumn(rank, F.col("_off") + F.col("_r")).drop("_h", "_b", "_r", "_off")
    )


def _sorted_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partitioned sort, written once so partition ids and places stay put."""
    placed = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    return cut_lineage(placed).withColumn("_pid", F.shiftright("_mid", _LOW_BITS))


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based rank over the whole table without a single-task window."""
    placed = _sorted_parts(df, order)
    counts = placed.groupBy("_pid").agg(F.count("*").alias("_c"))  # one row per sort partition
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, W.currentRow)
    shifts = counts.select("_pid", (F.sum("_c").over(before) - F.col("_c")).alias("_off"))
    within = F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return (
        placed.join(F.broadcast(shifts), "_pid")
        .withColumn(rank, F.col("_off") + within + F.lit(1)).drop("_mid", "_pid", "_off")
    )


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running totals of ``sums`` (column → output name) over the whole table, partition by partition."""
    placed = _sorted_parts(df, order)
    totals = placed.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{o}") for c, o in sums.items()])
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, W.currentRow)
    shifts = totals.select("_pid", *[
        (F.sum(f"_t_{o}").over(before) - F.col(f"_t_{o}")).alias(f"_o_{o}") for o in sums.values()])
    inside = W.partitionBy("_pid").orderBy("_mid").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = placed.join(F.broadcast(shifts), "_pid")
    for c, o in sums.items():
        out = out.withColumn(o, F.sum(c).over(inside) + F.col(f"_o_{o}"))
    return out.drop("_mid", "_pid", *[f"_o_{o}" for o in sums.values()])


def _all_set(cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def top_k_per(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark keeps at most ``k`` rows per key and task before the shuffle."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= F.lit(k))


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row per key as a combining aggregate: one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in by]
    packed = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*by).agg(F.min_by(packed, F.struct(*order)).alias("_row"))
    return picked.select(*by, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
