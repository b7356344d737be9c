"""Retrieval banks: one row per entity, several views per entity, or canonical and example rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.functions.text import strip_all
from phrasebench.operators.ordering import first_per, global_rank, rank_in_group, top_k_per


def first_nonempty(col: str, order: str) -> Column:
    """First non-empty trimmed value by ``order``, '' when there is none; a combining aggregate."""
    text = strip_all(col)
    value = F.when(text != "", text)
    return F.coalesce(F.min_by(value, F.when(value.isNotNull(), F.col(order))), F.lit(""))


def first_texts(df: DataFrame, entity: str, text: str, order: str, n: int = 3, out: str = "usage") -> DataFrame:
    """(entity, first ``n`` non-null texts joined by a space); at most ``n`` rows per entity and task move."""
    kept = top_k_per(df.where(F.col(text).isNotNull()).select(entity, text, order), [entity], [F.col(order)], n)
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col(text))))
    return kept.groupBy(entity).agg(F.array_join(F.transform(rows, lambda r: r[text]), " ").alias(out))


def entity_bank(df: DataFrame, entity: str, fields: list[str], text: str, order: str, n_texts: int = 3) -> DataFrame:
    """One row per entity: first non-empty value of each field, first texts joined as ``usage``."""
    heads = df.groupBy(entity).agg(*[first_nonempty(f, order).alias(f) for f in fields])
    usage = first_texts(df, entity, text, order, n_texts)
    return heads.join(usage, entity, "left").withColumn("usage", F.coalesce("usage", F.lit("")))


def texts_by_entity(df: DataFrame, entity: str, key: str, text: str, seed: int = 42) -> DataFrame:
    """Entity → texts as long rows (entity, place, text): an entity of any size stays spread out."""
    ranked = rank_in_group(df.where(F.col(text).isNotNull()), [entity], key, seed, rank="place", size="n_texts")
    return ranked.select(entity, "place", "n_texts", key, text)


def multiview_bank(df: DataFrame, entity: str, views: dict[str, str]) -> DataFrame:
    """(bank_text, source_type, entity): one row per non-empty view (name → column), distinct."""
    made = [F.struct(strip_all(c).alias("bank_text"), F.lit(v).alias("source_type"))
            for v, c in views.items()]
    long = df.select(strip_all(entity).alias("entity"), F.inline(F.array(*made)))
    return long.where(F.col("bank_text") != "").distinct()


def entity_index(df: DataFrame, entity: str) -> DataFrame:
    """(entity, idx): number of every entity in sorted order, from 0."""
    names = df.where(F.col(entity).isNotNull()).select(entity).distinct()
    return global_rank(names, [F.col(entity)], "idx").withColumn("idx", F.col("idx") - 1)


def with_index(df: DataFrame, index: DataFrame, entity: str) -> DataFrame:
    return df.join(index, entity, "left")


def index_names(df: DataFrame, index: DataFrame, entity: str, default: str = "UNKNOWN") -> DataFrame:
    return df.join(index, "idx", "left").withColumn(entity, F.coalesce(entity, F.lit(default)))


def first_rows(df: DataFrame, entity: str, order: str) -> DataFrame:
    """First row of every entity in file order."""
    return first_per(df, [entity], [F.col(order).alias("_o")])


def typed_bank(df: DataFrame, entity: str, example: str, order: str, example_only: list[str]) -> DataFrame:
    """Canonical rows (one per entity) and example rows that name their entity, in one table.

    Columns in ``example_only`` are absent, hence null, on canonical rows.
    """
    canonical = first_rows(df, entity, order).drop(*example_only)
    canonical = canonical.withColumns({"input_text": F.col(entity), "input_type": F.lit("canonical")})
    named = F.contains(F.lower(F.col(example)), F.lower(F.col(entity)))
    examples = df.where(F.coalesce(named, F.lit(False)))
    examples = examples.withColumns({"input_text": F.col(example), "input_type": F.lit("example")})
    return canonical.unionByName(examples, allowMissingColumns=True)


def bank_summary(bank: DataFrame, entity: str) -> DataFrame:
    return bank.agg(F.count("*").alias("n_rows"), F.countDistinct(entity).alias("n_entities"))
