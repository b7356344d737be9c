"""Evaluation reports: reliability, comparison, curves, failures, inspection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasebench.functions.text import failure_type
from phrasebench.operators import diagnose as G
from phrasebench.operators import metrics as M
from phrasebench.operators.ordering import sample_rows


def reliability(preds: DataFrame, score: str, correct: str, rank: str, key: str,
                min_count: int = 100) -> dict[str, DataFrame]:
    """Outcomes, score gap, thresholds with coverage, calibration, recall curve, best and worst rows."""
    right = F.col(correct) == 1
    return {
        "outcomes": G.shares(preds.withColumn("outcome", G.outcome(rank)), ["outcome"]),
        "gap": G.outcome_stats(preds, score, correct),
        "density": G.histogram(preds, score, 50, [correct], density=True),
        "thresholds": G.threshold_sweep(preds, score, correct),
        "calibration": G.calibration(preds, score, correct, min_count=min_count),
        "recall": M.recall_curve(preds, 5, rank=rank),
        "best": G.hardest(preds, right, score, key, 10),
        "worst": G.hardest(preds, ~right, score, key, 10),
        "confident_errors": G.hardest(preds, ~right, score, key, 20),
    }


def model_comparison(metrics: dict[str, DataFrame], baseline: str, cols: list[str]) -> DataFrame:
    """One row per model with gains over the baseline."""
    rows = [df.withColumn("model", F.lit(m)) for m, df in metrics.items()]
    return M.compare_models(reduce(DataFrame.unionByName, rows), baseline, cols)


def recall_curves(ranks: dict[str, DataFrame], k_max: int = 10) -> DataFrame:
    """(model, k, recall) of several runs in one aggregate."""
    rows = [df.select(F.lit(m).alias("model"), "gold_rank") for m, df in ranks.items()]
    return M.recall_curve(reduce(DataFrame.unionByName, rows), k_max, ["model"])


def failures(preds: DataFrame, key: str, gold: str, pred: str, n: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """Wrong predictions among ``n`` sampled queries, each with its failure type, and the counts."""
    wrong = sample_rows(preds, key, n, seed).where(F.col(gold) != F.col(pred))
    typed = wrong.withColumn("failure_type", failure_type(gold, pred))
    return {"failures": typed, "summary": typed.groupBy("failure_type").agg(F.count("*").alias("n"))}


def inspection(ranked: DataFrame, key: str, n: int, top: int = 3, seed: int = 42) -> DataFrame:
    """Top predictions of ``n`` sampled queries with a hit marker."""
    ids = sample_rows(ranked.select(key).distinct(), key, n, seed)
    rows = ranked.where(F.col("rank") <= top).join(ids, key, "left_semi")
    return rows.withColumn("hit", (F.col("entity") == F.col("gold")).cast("int"))
