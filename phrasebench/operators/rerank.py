"""Pair tables and pair scorers for reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasebench.functions.numeric import safe_ratio
from phrasebench.functions.text import candidate_text, normal_tokens, padded_run, word_set
from phrasebench.operators.ordering import hash_number, hash_order, top_k_per
from phrasebench.session import cut_lineage, spread

#: A pair scorer maps rows with (query, candidate, …) to the same rows plus ``rerank_score``.
PairScorer = Callable[[DataFrame], DataFrame]


def _named(bank: DataFrame, ranked: DataFrame, name: str = "bank_id") -> DataFrame:
    """The rows of ``bank`` that some list names: a bank may be many times its candidates, and its other texts are not moved."""
    return bank.join(cut_lineage(ranked.select(name).distinct()), name, "left_semi")


def candidate_pairs(ranked: DataFrame, queries: DataFrame, query_id: str, query_text: str,
                    bank: DataFrame, bank_id: str, entity: str, meaning: str) -> DataFrame:
    """Ranked rows plus query text and ``entity | meaning``."""
    ranked = cut_lineage(ranked)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("query"))
    b = _named(bank.select(F.col(bank_id).alias("bank_id"), candidate_text(entity, meaning).alias("candidate")), ranked)
    return ranked.join(q, "query_id").join(b, "bank_id")


def hard_negatives(ranked: DataFrame, n: int = 3, depth: int = 10, by: str = "query_id",
                   entity: str = "entity", gold: str = "gold") -> DataFrame:
    """Up to ``n`` highest-ranked rows of the first ``depth`` whose entity is not the gold one."""
    wrong = ranked.where((F.col("rank") <= depth) & (F.col(entity) != F.col(gold)))
    return top_k_per(wrong, [by], [F.col("rank")], n, "neg_rank")


def training_pairs(queries: DataFrame, ranked: DataFrame, n: int = 3, depth: int = 10) -> DataFrame:
    """(query_id, candidate, label): the gold entity as positive, hard negatives as 0."""
    pos = queries.select("query_id", F.col("gold").alias("candidate"), F.lit(1.0).alias("label"))
    neg = hard_negatives(ranked, n, depth).select(
        "query_id", F.col("entity").alias("candidate"), F.lit(0.0).alias("label"))
    return pos.unionByName(neg)


def text_words(text) -> dict:
    """What pair features need of a text: its distinct words, and its normalised tokens as one padded run."""
    return {"words": word_set(text), "run": padded_run(normal_tokens(text)), "full": F.size(normal_tokens(text)) > 0}


def candidate_words(ranked: DataFrame, queries: DataFrame, query_id: str, query_text: str,
                    bank: DataFrame, bank_id: str, entity: str, meaning: str) -> DataFrame:
    """Ranked rows plus the words of both texts, made once a text that is in a list; the texts themselves stay behind."""
    ranked = cut_lineage(ranked)

    def side(df: DataFrame, key: str, name: str, text, prefix: str) -> DataFrame:
        made = spread(df.select(F.col(key).alias(name), text.alias("_text")))
        made = _named(made, ranked) if name == "bank_id" else made
        return cut_lineage(made.select(name, *[c.alias(f"{prefix}_{n}") for n, c in text_words("_text").items()]))

    q = side(queries, query_id, "query_id", F.col(query_text), "q")
    c = side(bank, bank_id, "bank_id", candidate_text(entity, meaning), "c")
    return ranked.join(q, "query_id").join(c, "bank_id")


def pair_features(pairs: DataFrame) -> DataFrame:
    """Features of a pair: shared-word share, word-set Jaccard, phrase match, length ratio.

    ``pairs`` has the texts (query, candidate) or their words, as ``candidate_words`` gives them.
    """
    if "q_words" not in pairs.columns:
        pairs = pairs.withColumns({f"{p}_{n}": c for p, text in (("q", "query"), ("c", "candidate")) for n, c in text_words(text).items()})
    both = F.size(F.array_intersect("q_words", "c_words"))
    n_q, n_c = F.size("q_words"), F.size("c_words")
    inside = F.col("c_full") & F.contains("q_run", "c_run")
    return (
        pairs.withColumn("_both", both)
        .withColumns({
            "f_cover": safe_ratio("_both", n_c), "f_jaccard": safe_ratio("_both", n_q + n_c - F.col("_both")),
            "f_phrase": F.when(inside, F.lit(1.0)).otherwise(F.lit(0.0)), "f_length": safe_ratio(F.least(n_q, n_c), F.greatest(n_q, n_c)),
        })
        .drop("_both", *[f"{p}_{n}" for p in ("q", "c") for n in ("words", "run", "full")])
    )


FEATURES = ["f_cover", "f_jaccard", "f_phrase", "f_length"]


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """Untrained scorer: Jaccard overlap plus a phrase bonus."""
    scored = pair_features(pairs)
    return scored.withColumn("rerank_score", F.col("f_jaccard") + 0.5 * F.col("f_phrase")).drop(*FEATURES)


#: The scorer takes pairs with words instead of texts.
overlap_scorer.wants_words = True


def fit_pair_scorer(pairs: DataFrame, extra: tuple[str, ...] = (), max_iter: int = 500):
    """Fit logistic regression on pair features; returns a Spark ML model that can be saved.

    Raises when the fit has not converged after ``max_iter`` steps.
    """
    inputs = [*FEATURES, *extra]
    stages = [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"),
              LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=0.01)]
    model = Pipeline(stages=stages).fit(pair_features(pairs))
    _require_converged(model.stages[-1], max_iter)
    return model


def _require_converged(fitted, max_iter: int) -> None:
    if fitted.hasSummary and fitted.summary.totalIterations >= max_iter:
        raise RuntimeError(f"no convergence after {max_iter} steps")


def fit_ranker(judged: DataFrame, max_iter: int = 500):
    """Weights of the pair features under the pairwise logistic loss; returns a Spark ML model that can be saved.

    ``judged`` has pairs with a ``label`` of 1 or 0. Within a query every positive meets every negative (a mined list
    holds a few of each), and the model learns from the difference of their features, in both directions, without an
    intercept: it is asked which of two candidates is the better one. Where no query has both (every candidate of a large
    bank may be a right one) nothing can be learned: all weights are 0, and every pair scores one half.
    """
    rows = cut_lineage(pair_features(judged).select("query_id", "label", *FEATURES))
    better, worse = (rows.where(F.col("label") == y).select("query_id", *[F.col(f).alias(f"{f}_{y}") for f in FEATURES]) for y in (1, 0))
    both = better.join(worse, "query_id")
    ahead = both.select(F.lit(1.0).alias("label"), *[(F.col(f"{f}_1") - F.col(f"{f}_0")).alias(f) for f in FEATURES])
    if ahead.isEmpty():  # a candidate beside its equal: no weight lowers this loss, so the penalty keeps all of them at 0
        ahead = ahead.sparkSession.createDataFrame([(1.0, *[0.0] * len(FEATURES))], ahead.schema)
    behind = ahead.select(F.lit(0.0).alias("label"), *[(-F.col(f)).alias(f) for f in FEATURES])
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="features"),
              LogisticRegression(featuresCol="features", labelCol="label", fitIntercept=False, maxIter=max_iter, regParam=0.001)]
    model = Pipeline(stages=stages).fit(ahead.unionByName(behind))
    _require_converged(model.stages[-1], max_iter)
    return model


def fold_of(key: str, folds: int, seed: int = 42):
    """Fold of a query, by hash."""
    return F.pmod(hash_number(hash_order(key, seed=seed)), F.lit(folds)).cast("int")


def cross_scored(judged: DataFrame, folds: int = 3) -> DataFrame:
    """``judged`` with ``rerank_score``; every query is scored by a model that learned from the other folds only."""
    judged = cut_lineage(judged.withColumn("_fold", fold_of("query_id", folds)))
    out = None
    for f in range(folds):
        scorer = model_scorer(fit_ranker(judged.where(F.col("_fold") != f)))
        own = scorer(judged.where(F.col("_fold") == f))
        out = own if out is None else out.unionByName(own)
    return out.drop("_fold")


def model_scorer(model) -> PairScorer:
    """Pair scorer backed by a fitted Spark ML model."""
    def score(pairs: DataFrame) -> DataFrame:
        out = model.transform(pair_features(pairs))
        drop = [*FEATURES, "features", "rawPrediction", "probability", "prediction"]
        return out.withColumn("rerank_score", vector_to_array("probability")[1]).drop(*drop)
    return score
