"""Ranking: cut, de-duplicate per entity, look up, rerank order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasebench.operators.ordering import first_per, top_k_per


def rank_topk(scored: DataFrame, k: int, by: str = "query_id", score: str = "score",
              item: str = "bank_id", rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per query: score descending, then item ascending."""
    return top_k_per(scored, [by], [F.desc(score), F.col(item)], k, rank)


def best_per_entity(scored: DataFrame, by: str = "query_id", entity: str = "entity",
                    score: str = "score", item: str = "bank_id") -> DataFrame:
    """Best row per (query, entity)."""
    return first_per(scored, [by, entity], [(-F.col(score)).alias("_s"), F.col(item).alias("_i")])


def distinct_topk(scored: DataFrame, k: int, fetch_k: int | None = None, by: str = "query_id",
                  entity: str = "entity", score: str = "score", item: str = "bank_id") -> DataFrame:
    """Over-fetch ``fetch_k`` rows, keep the best row per entity, cut to ``k``.

    ``fetch_k`` changes results and is the caller's choice; None de-duplicates the whole list.
    """
    rows = scored if fetch_k is None else rank_topk(scored, fetch_k, by, score, item).drop("rank")
    return rank_topk(best_per_entity(rows, by, entity, score, item), k, by, score, item)


def fill_lists(scored: DataFrame, queries: DataFrame, query_id: str, bank: DataFrame, bank_id: str, k: int,
               scores: list[str], by: str = "query_id", item: str = "doc_id") -> DataFrame:
    """``scored`` plus zero-score rows, so that every query has ``k`` rows where the bank has as many.

    Ties go to the lower id, so the rows that can fill a list are among the ``k`` lowest ids of the bank: at most ``k``
    rows per query are added, whatever the bank's size.
    """
    lowest = bank.select(F.col(bank_id).alias(item)).orderBy(item).limit(k).agg(F.collect_list(item)).scalar()
    # a query's row meets the ids it has, at most ``k``, as one list: the rows to fill in are not shuffled
    held = scored.where(F.array_contains(lowest, F.col(item))).groupBy(by).agg(F.collect_set(item).alias("_held"))
    spare = queries.select(F.col(query_id).alias(by)).distinct().join(held, by, "left").withColumn(item, F.explode(lowest))
    spare = spare.where(~F.coalesce(F.array_contains("_held", F.col(item)), F.lit(False)))
    spare = spare.select(by, item).withColumns({c: F.lit(0.0) for c in scores})
    return scored.select(by, item, *scores).unionByName(spare)


def gold_rank(ranked: DataFrame, by: str = "query_id", entity: str = "entity", gold: str = "gold",
              rank: str = "rank", queries: DataFrame | None = None) -> DataFrame:
    """(query, gold_rank): first rank of the gold entity, null when it is not in the list.

    ``queries`` (with the ``by`` column): all queries; one without any ranked row then counts as a miss.
    """
    hit = F.when(F.col(entity) == F.col(gold), F.col(rank))
    found = ranked.groupBy(by).agg(F.min(hit).alias("gold_rank"))
    return found if queries is None else queries.select(by).distinct().join(found, by, "left")


def prediction_lists(ranked: DataFrame, k: int, by: str = "query_id", entity: str = "entity",
                     rank: str = "rank", out: str = "preds") -> DataFrame:
    """(query, array of the first ``k`` entities in rank order)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(entity))))
    cut = ranked.where(F.col(rank) <= k)
    return cut.groupBy(by).agg(F.transform(rows, lambda r: r[entity]).alias(out))


def wide_predictions(ranked: DataFrame, k: int = 3, by: str = "query_id", entity: str = "entity",
                     rank: str = "rank") -> DataFrame:
    """(query, pred_1 … pred_k)."""
    cols = [F.max(F.when(F.col(rank) == i, F.col(entity))).alias(f"pred_{i}") for i in range(1, k + 1)]
    return ranked.where(F.col(rank) <= k).groupBy(by).agg(*cols)


def candidate_counts(ranked: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """One row: number of queries, and whether each has exactly ``k`` candidates."""
    per_query = ranked.groupBy(by).agg(F.count("*").alias("n"))
    return per_query.agg(F.count("*").alias("queries"), F.bool_and(F.col("n") == k).alias("all_full"))


def rerank(pairs: DataFrame, k: int, score: str = "rerank_score", by: str = "query_id",
           item: str = "bank_id") -> DataFrame:
    """Order each candidate list by the pair scorer's value and cut to ``k``."""
    return rank_topk(pairs, k, by, score, item, rank="rerank_rank")
