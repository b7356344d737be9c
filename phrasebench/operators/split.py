"""Leakage-safe splits, hold-outs, samples and augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.functions.text import role_prefix, weak_context_rows
from phrasebench.operators.ordering import (
    first_per, hash_number, hash_order, hash_threshold, rank_in_group, sample_rows)


def _split_by_key(df: DataFrame, key: str, n_first, first: str, second: str, seed: int) -> DataFrame:
    keys = df.where(F.col(key).isNotNull()).select(key).distinct().select(hash_order(key, seed=seed).alias("_h"))
    limit = hash_threshold(keys, "_h", n_first)
    in_first = F.coalesce(hash_order(key, seed=seed) <= limit, F.lit(False))
    # every row decides by its own key: no join back, so a hot key needs no care
    return df.where(F.col(key).isNotNull()).withColumn("split", F.when(in_first, first).otherwise(second))


def group_split(df: DataFrame, group: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` column: ceil(frac · groups) whole groups go to test."""
    return _split_by_key(df, group, lambda n: F.ceil(F.lit(frac) * n), "test", "train", seed)


def entity_split(df: DataFrame, entity: str, frac: float = 0.8, seed: int = 42) -> DataFrame:
    """``split`` column: the first floor(frac · entities) entities of the shuffle go to train."""
    return _split_by_key(df, entity, lambda n: F.floor(F.lit(frac) * n), "train", "test", seed)


def within_entity_split(df: DataFrame, entity: str, key: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` column: ceil(frac · n) rows of every entity go to test; a single row stays in train."""
    ranked = rank_in_group(df, [entity], key, seed)
    test = (F.col("group_size") > 1) & (F.col("rank_in_group") <= F.ceil(F.lit(frac) * F.col("group_size")))
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).drop("rank_in_group", "group_size")


def pair_split(df: DataFrame, key: str, frac: float = 0.1, seed: int = 42) -> DataFrame:
    """``split`` column: ceil(frac · rows) rows go to validation."""
    hashed = df.withColumn("_h", hash_order(key, seed=seed))
    limit = hash_threshold(hashed.select("_h"), "_h", lambda n: F.ceil(F.lit(frac) * n))
    held = F.coalesce(F.col("_h") <= limit, F.lit(False))
    return hashed.withColumn("split", F.when(held, "val").otherwise("train")).drop("_h")


def holdout_one(df: DataFrame, entity: str, key: str, seed: int = 42) -> DataFrame:
    """One row per entity, the first in hash order."""
    return first_per(df.where(F.col(entity).isNotNull()), [entity],
                     [hash_order(key, seed=seed).alias("_h"), F.col(key).alias("_k")])


def rows_in(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def rows_not_in(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """One row: number of groups present in more than one split."""
    per_group = df.groupBy(group).agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    return per_group.agg(F.count_if(F.col("lo") != F.col("hi")).alias("leaked_groups"))


def split_report(df: DataFrame, entity: str, label: str, split: str = "split") -> DataFrame:
    """Rows, entities and mean label per split."""
    return df.groupBy(split).agg(
        F.count("*").alias("n_rows"), F.countDistinct(entity).alias("n_entities"),
        F.avg(label).alias("label_mean"))


def augment(train: DataFrame, entity: str, key: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """Four short-context (text, label) rows for each of at most ``n`` sampled training rows."""
    picked = sample_rows(train.select(key, entity), key, n, seed)
    return picked.select(F.col(key), F.inline(weak_context_rows(entity)))


def distinct_draws(key: str, size: str, n: int, seed: int = 42) -> Column:
    """Array of ``min(n, size)`` different places below ``size``, uniform and independent for different keys."""
    def later(drawn: Column, i: Column) -> Column:
        left = F.pmod(hash_number(hash_order(F.col(key), i, seed=seed)), F.col(size) - i)
        # the place with as many free places before it: step over the places drawn, from the smallest on
        place = F.aggregate(F.array_sort(drawn), left, lambda x, taken: F.when(taken <= x, x + 1).otherwise(x))
        return F.concat(drawn, F.array(place))

    draws = F.sequence(F.lit(0).cast("long"), F.least(F.lit(n).cast("long"), F.col(size)) - 1)
    return F.aggregate(draws, F.array().cast("array<bigint>"), later)


def sampled_positives(queries: DataFrame, query_id: str, query_entity: str, query_text: str,
                      bank: DataFrame, bank_id: str, bank_entity: str, bank_text: str,
                      n: int = 2, seed: int = 42) -> DataFrame:
    """Up to ``n`` distinct positives of its entity for every query, drawn without replacement.

    Every query has a permutation of its entity's places of its own: its i-th draw is the h-th place not drawn yet, h
    being a keyed hash of query and draw modulo the places left. The join is on (entity, place), so each query meets
    ``n`` rows, never its whole entity, and queries of one entity draw independently.
    """
    ranked = rank_in_group(bank, [bank_entity], bank_id, seed).select(
        F.col(bank_entity).alias("entity"), (F.col("rank_in_group") - 1).alias("place"),
        F.col("group_size"), F.col(bank_id).alias("positive_id"), F.col(bank_text).alias("positive"))
    sizes = bank.groupBy(F.col(bank_entity).alias("entity")).agg(F.count("*").alias("m"))
    wants = (
        queries.select(F.col(query_id).alias("query_id"), F.col(query_entity).alias("entity"),
                       F.col(query_text).alias("query"))
        .join(sizes, "entity")
        .select("*", F.posexplode(distinct_draws("query_id", "m", n, seed)).alias("draw", "place"))
    )
    return wants.join(ranked.drop("group_size"), ["entity", "place"]).select(
        "query_id", "entity", "draw", "positive_id",
        role_prefix("query", "query").alias("query"), role_prefix("positive", "passage").alias("positive"))
