"""Corpus profile: counts, shares, missing values, token statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasebench.functions.numeric import round_half_even
from phrasebench.functions.text import tokenize_ws
from phrasebench.operators.ordering import top_k_per
from phrasebench.session import cut_lineage


def value_counts(df: DataFrame, col: str, keep_null: bool = False) -> DataFrame:
    rows = df if keep_null else df.where(F.col(col).isNotNull())
    return rows.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, cols: list[str], n: int = 20) -> DataFrame:
    """(col, value, n, rank): most frequent values of several columns, nulls counted too."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])))
    counts = long.groupBy("col", "value").agg(F.count("*").alias("n"))
    return top_k_per(counts, ["col"], [F.desc("n"), F.asc_nulls_first("value")], n)


def percentages(df: DataFrame, col: str, places: int = 2) -> DataFrame:
    """(value, pct) over the non-null rows."""
    rows = df.where(F.col(col).isNotNull())
    counts = cut_lineage(rows.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.select("value", round_half_even(F.col("_n") / total * 100, places).alias("pct"))


def overview(variants: dict[str, DataFrame], entity: str, text: str) -> DataFrame:
    """One row per dataset variant: rows, columns, entities, distinct texts, rows per entity."""
    out = None
    for name, df in variants.items():
        row = df.agg(F.count("*").alias("n_rows"), F.countDistinct(entity).alias("n_entities"),
                     F.countDistinct(F.md5(text)).alias("n_texts"))
        row = row.select(F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
                         "n_entities", "n_texts",
                         round_half_even(F.col("n_rows") / F.col("n_entities"), 2).alias("rows_per_entity"))
        out = row if out is None else out.unionByName(row)
    return out


def label_table(df: DataFrame, dataset: str, label: str, labels: list) -> DataFrame:
    """Label percentages per dataset as columns; a label that never occurs is 0."""
    share = [round_half_even(F.count_if(F.col(label) == v) / F.count(label) * 100, 2).alias(f"pct_{v}") for v in labels]
    return df.groupBy(dataset).agg(*share)


def missing_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, n_missing, ratio), most missing first; one pass over the table."""
    counts = df.agg(F.count("*").alias("_all"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("col"), F.col(c).alias("n_missing"), (F.col(c) / F.col("_all")).alias("ratio"))
            for c in cols]
    return counts.select(F.inline(F.array(*rows))).orderBy(F.desc("n_missing"), "col")


def token_totals(df: DataFrame, text: str) -> DataFrame:
    """One row: tokens, distinct tokens, type-token ratio."""
    counts = df.select(F.explode(tokenize_ws(text)).alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    sums = counts.agg(F.sum("c").alias("n_tokens"), F.count("*").alias("n_types"))
    return sums.withColumn("type_token_ratio", F.col("n_types") / F.col("n_tokens"))


def in_order(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Right-outer to a fixed display order; categories without rows stay as null rows."""
    dim = df.sparkSession.createDataFrame(list(enumerate(order)), f"position int, {col} string")
    return dim.join(df, col, "left").orderBy("position")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
