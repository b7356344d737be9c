"""Ranking and classification metrics. All combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.functions.numeric import safe_ratio
from phrasebench.operators.ordering import running_sums
from phrasebench.session import cut_lineage


def hit_at(rank: str, k: int) -> Column:
    return F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0)))


def mrr(rank: str, max_rank: int | None = None) -> Column:
    r = F.col(rank)
    kept = r if max_rank is None else F.when(r <= max_rank, r)
    return F.avg(F.coalesce(F.lit(1.0) / kept, F.lit(0.0)))


def ranking_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5), max_rank: int | None = None,
                    by: list[str] | None = None, rank: str = "gold_rank") -> DataFrame:
    """Top-k accuracies and MRR from one gold rank per query; a missing rank is a miss."""
    aggs = [F.count("*").alias("n_queries"), *[hit_at(rank, k).alias(f"top{k}") for k in ks],
            mrr(rank, max_rank).alias("mrr")]
    return ranks.groupBy(*(by or [])).agg(*aggs)


def recall_curve(ranks: DataFrame, k_max: int, by: list[str] | None = None, rank: str = "gold_rank") -> DataFrame:
    """(k, recall) for k = 1..k_max in one pass: queries counted per gold rank, then per k."""
    by = by or []
    at = ranks.groupBy(*by, rank).agg(F.count("*").alias("_n"))
    ks = at.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k_max))))
    hit = F.sum(F.when(F.col(rank) <= F.col("k"), F.col("_n")).otherwise(0))
    return ks.groupBy(*by, "k").agg((hit / F.sum("_n")).alias("recall"))


def confusion(preds: DataFrame, gold: str, pred: str, labels: list) -> DataFrame:
    """(gold, pred, n) for every pair of the given labels, 0 where there is none."""
    spark = preds.sparkSession
    kind = dict(preds.dtypes)[gold]
    grid = spark.createDataFrame([(g, p) for g in labels for p in labels], f"gold {kind}, pred {kind}")
    counts = preds.groupBy(F.col(gold).alias("gold"), F.col(pred).cast(kind).alias("pred")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, ["gold", "pred"], "left").select(
        "gold", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def accuracy(pred: str, gold: str) -> Column:
    return F.avg((F.col(pred) == F.col(gold)).cast("double"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class and their macro and weighted means.

    Takes the confusion table, which has one row per pair of classes.
    """
    zero, n = F.lit(0).cast("long"), F.col("n")
    hit = F.when(F.col("gold") == F.col("pred"), n).otherwise(zero)
    cells = matrix.select(F.inline(F.array(
        F.struct(F.col("gold").alias("cls"), n.alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("pred").alias("cls"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")))))
    per = cells.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                   F.sum("tp").alias("tp"))
    per = per.withColumns({"precision": safe_ratio("tp", "predicted"), "recall": safe_ratio("tp", "support")})
    per = per.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"),
                                          F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    rows = per.select(F.col("cls").cast("string").alias("label"), *names, "support")
    macro = per.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per.agg(*[safe_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names],
                       F.sum("support").alias("support"))
    return (
        rows.unionByName(macro.select(F.lit("macro avg").alias("label"), *names, "support"))
        .unionByName(weighted.select(F.lit("weighted avg").alias("label"), *names, "support"))
    )


def roc(scored: DataFrame, score: str, gold: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) per distinct score, highest first, plus the (0, 0) start.

    Rows are first summed per distinct score; the running totals go over sorted partitions.
    """
    at = scored.where(F.col(score).isNotNull() & F.col(gold).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(gold) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(gold) == 1, 0).otherwise(1)).alias("_neg"))
    points = running_sums(at, [F.desc("threshold")], {"_pos": "tp", "_neg": "fp"}).drop("_pos", "_neg")
    totals = points.agg(F.struct(F.max("tp").alias("pos"), F.max("fp").alias("neg"))).scalar()
    pos, neg = totals["pos"], totals["neg"]
    start = points.sparkSession.createDataFrame([(float("inf"), 0, 0)], "threshold double, tp long, fp long")
    every = start.unionByName(points)
    return every.select("threshold", "tp", "fp", safe_ratio("tp", pos).alias("tpr"), safe_ratio("fp", neg).alias("fpr"))


def auc(scored: DataFrame, score: str, gold: str) -> DataFrame:
    """One row: area under the ROC curve.

    The trapezoid of a distinct score needs only its own counts and the running totals, so no ``lag``
    over the whole curve: area = Σ neg·(tp_before + pos/2) / (P·N).
    """
    at = scored.where(F.col(score).isNotNull() & F.col(gold).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(gold) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(gold) == 1, 0).otherwise(1)).alias("_neg"))
    run = running_sums(at, [F.desc("threshold")], {"_pos": "tp"})
    area = F.sum(F.col("_neg") * (F.col("tp") - F.col("_pos") / 2))
    return run.agg(safe_ratio(area, F.sum("_pos") * F.sum("_neg")).alias("auc"))


def pair_scorer_metrics(scored: DataFrame, prob: str, gold: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and log-loss of a binary scorer in one pass."""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-15)), F.lit(1 - 1e-15))
    yes, hit = F.col(gold) == 1, F.col(prob) >= threshold
    sums = scored.agg(
        F.count("*").alias("n"), F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"),
        F.count_if(yes & ~hit).alias("fn"), F.avg(-F.when(yes, F.log(p)).otherwise(F.log(1 - p))).alias("loss"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "n", safe_ratio(F.col("n") - fp - fn, F.col("n")).alias("accuracy"), safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "loss")


def compare_models(metrics: DataFrame, baseline: str, cols: list[str], model: str = "model") -> DataFrame:
    """Add ``<metric>_gain`` over the baseline row; refuses models scored on different query counts."""
    metrics = cut_lineage(metrics)  # a row a model; what made the rows runs once, not once a metric
    counts = metrics.agg(F.countDistinct("n_queries")).scalar()
    base = metrics.where(F.col(model) == baseline)
    out = metrics
    for c in cols:
        out = out.withColumn(f"{c}_gain", F.col(c) - base.agg(F.max(c)).scalar())
    checked = F.when(counts > 1, F.raise_error(F.lit("models were scored on different query sets")).cast("long"))
    return out.withColumn("n_queries", F.coalesce(checked, F.col("n_queries")))


def to_long(metrics: DataFrame, cols: list[str], model: str = "model") -> DataFrame:
    return metrics.unpivot([model], cols, "metric", "value")
