"""Corpus reports and dataset builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasebench.functions.text import bank_text, remove_label_words, strip_all
from phrasebench.operators import bank as B
from phrasebench.operators import clean as C
from phrasebench.operators import detect as D
from phrasebench.operators import diagnose as G
from phrasebench.operators import metrics as M
from phrasebench.operators import profile as P
from phrasebench.operators import split as S


def corpus_profile(df: DataFrame, entity: str, text: str, label: str, length: str) -> dict[str, DataFrame]:
    """Report tables of a corpus, each a lazy DataFrame."""
    return {
        "overview": P.overview({"all": df}, entity, text),
        "label_pct": P.percentages(df, label),
        "missing": P.missing_profile(df, df.columns),
        "tokens": P.token_totals(df, text),
        "lengths": G.histogram(df, length, 30),
        "length_density": G.kde(df, length),
    }


def detection_dataset(df: DataFrame, text: str, label: str, labels: dict, pair_id: str, entity: str, key: str,
                      frac: float = 0.2, n_augment: int = 2000, seed: int = 42) -> dict[str, DataFrame]:
    """Filter, label, group key, split by group, augment train."""
    rows = df.where(F.col(label).isin(list(labels))).withColumns({
        "y": C.map_values(label, labels), "split_group": C.fallback_key(pair_id, text)})
    rows = S.group_split(rows, "split_group", frac, seed)
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    extra = S.augment(train, entity, key, n_augment, seed).select(
        F.col("text").alias(text), F.col("label").alias("y"))
    return {"train": train.unionByName(extra, allowMissingColumns=True), "test": test,
            "report": S.split_report(rows, "split_group", "y"), "leakage": S.leakage(rows, "split_group")}


def detection_baseline(train: DataFrame, test: DataFrame, text: str, label: str) -> dict:
    """Fit the bag-of-words classifier and report on the held-out rows."""
    model = D.fit_text_classifier(train, text, label)
    scored = D.detect(model, test, [c for c in test.columns])
    matrix = M.confusion(scored, label, "class_id", [0, 1])
    return {"model": model, "scored": scored, "confusion": matrix, "report": M.class_report(matrix)}


def detection_diagnostics(scored: DataFrame, gold: str, key: str, score: str = "score",
                          confidence: str = "confidence", pred: str = "class_id") -> dict[str, DataFrame]:
    """ROC, confidence distribution, errors and most confident mistakes."""
    flagged = scored.withColumn("correct", (F.col(pred) == F.col(gold)).cast("int"))
    return {
        "roc": M.roc(scored, score, gold), "auc": M.auc(scored, score, gold),
        "confidence": G.histogram(flagged, confidence, 30, ["correct"], density=True),
        "outcome": G.outcome_stats(flagged, confidence, "correct"),
        "errors": flagged.where(F.col("correct") == 0),
        "hard": G.hardest(flagged, F.col("correct") == 0, confidence, key, 10),
    }


def entity_retrieval_set(df: DataFrame, entity: str, text: str, fields: list[str], order: str, usage_flag=None,
                         source: str = "train", seed: int = 42) -> dict[str, DataFrame]:
    """Clean text, split by entity, build the entity bank and its index.

    ``source='train'`` keeps held-out rows out of the bank text; ``'all'`` copies them in.
    """
    rows = df.withColumn(text, remove_label_words(text))
    kept = rows if usage_flag is None else rows.where(usage_flag)
    parts = S.entity_split(kept, entity, seed=seed)
    base = rows if source == "all" else parts.where(F.col("split") == "train")
    bank = B.entity_bank(base, entity, fields, text, order)
    pads = [F.col(c) for c in fields[:3]] + [F.lit("")] * (3 - len(fields[:3]))
    bank = bank.withColumn("bank_text", bank_text(F.col(entity), *pads, F.col("usage")))
    index = B.entity_index(bank, entity)
    return {"train": B.with_index(parts.where(F.col("split") == "train"), index, entity),
            "test": B.with_index(parts.where(F.col("split") == "test"), index, entity),
            "bank": B.with_index(bank, index, entity), "index": index}


def cross_lingual_set(df: DataFrame, entity: str, key: str, views: dict[str, str], flag: str, required: list[str],
                      seed: int = 42) -> dict[str, DataFrame]:
    """Filter, split inside every entity, multi-view bank from the training rows."""
    rows = df.where(F.col(flag) == F.lit(True))
    for c in [*required, entity]:
        rows = rows.where(C.not_empty(c)).withColumn(c, strip_all(c))
    parts = S.within_entity_split(rows, entity, key, seed=seed)
    train = parts.where(F.col("split") == "train")
    return {"train": train, "test": parts.where(F.col("split") == "test"),
            "bank": B.multiview_bank(train, entity, views)}


def meaning_bank(df: DataFrame, entity: str, example: str, order: str, example_only: list[str],
                 stages: list[tuple]) -> dict[str, DataFrame]:
    """Quality funnel counts and the two-type bank of the rows that pass it."""
    keep = F.lit(True)
    for _, cond in stages:
        keep = keep & F.coalesce(cond, F.lit(False))
    return {"funnel": C.quality_funnel(df, stages),
            "bank": B.typed_bank(df.where(keep), entity, example, order, example_only)}


def heldout_set(bank: DataFrame, entity: str, key: str, text: str, seed: int = 42) -> dict[str, DataFrame]:
    """One held-out example row per entity, and the bank without any row of those texts."""
    examples = bank.where(F.col("input_type") == "example")
    held = S.holdout_one(examples, entity, key, seed)
    return {"eval": held, "index_bank": S.rows_not_in(bank, held.select(text).distinct(), text)}
