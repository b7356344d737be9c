"""Retrieval runs: dense, lexical, hybrid, phrase boost, rerank, two layers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.fixed import DENSE_WEIGHT
from phrasebench.functions.numeric import r6
from phrasebench.functions.text import normal_tokens, phrase_boost
from phrasebench.operators import clean as C
from phrasebench.operators import fusion as Fu
from phrasebench.operators import rank as R
from phrasebench.operators.dense import dense_range, dense_topk, fused_topk
from phrasebench.operators.blockmax import LEXICAL, found_rows, score_limits
from phrasebench.operators.lexical import (
    LexicalIndex, asked_terms, bm25_topk, fused_sparse_topk, lexical_index, sparse_topk)
from phrasebench.operators.phrases import token_run_matches
from phrasebench.operators.rerank import PairScorer, candidate_pairs, candidate_words, fold_of, training_pairs
from phrasebench.operators.split import pair_split
from phrasebench.session import bucket_count, cut_lineage, spread

#: Bytes that a candidate pair takes where it is ranked.
PAIR_BYTES = 200
#: An embedder maps a table with a text column to the same table plus a vector column.
Embedder = Callable[[DataFrame], DataFrame]


def with_gold(ranked: DataFrame, bank: DataFrame, bank_id: str, entity: str,
              queries: DataFrame, query_id: str, gold: str) -> DataFrame:
    """Ranked rows plus the bank row's entity and the query's gold entity."""
    b = bank.select(F.col(bank_id).alias("bank_id"), F.col(entity).alias("entity"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(gold).alias("gold"))
    return ranked.join(b, "bank_id").join(q, "query_id")


def dense_retrieval(queries: DataFrame, query_id: str, query_vec: str, gold: str,
                    bank: DataFrame, bank_id: str, bank_vec: str, entity: str,
                    k: int = 5, fetch_k: int | None = None) -> DataFrame:
    """Over-fetch, de-duplicate per entity, cut: (query_id, rank, bank_id, score, entity, gold)."""
    top = dense_topk(queries, query_id, query_vec, bank, bank_id, bank_vec, fetch_k or k).drop("rank")
    found = with_gold(top, bank, bank_id, entity, queries, query_id, gold)
    return R.distinct_topk(found, k)


def lexical_retrieval(queries: DataFrame, query_id: str, query_text: str, index: LexicalIndex, k: int = 10) -> DataFrame:
    scored = cut_lineage(bm25_topk(queries, query_id, query_text, index, k))
    scored = R.fill_lists(scored, queries, query_id, index.documents, "doc_id", k, ["lexical"])
    return R.rank_topk(scored, k, score="lexical", item="doc_id")


def filled_pairs(queries: DataFrame, query_id: str, query_text: str, index: LexicalIndex, k: int) -> DataFrame:
    """Pairs with both scores that hold the first ``k`` by either; every query has ``k`` of them where the bank has as many.

    Rows are dealt by query to as many tasks as they ask for, so that what is ranked per query is bounded in every task.
    """
    pairs = cut_lineage(sparse_topk(queries, query_id, query_text, index, k))
    filled = R.fill_lists(pairs, queries, query_id, index.documents, "doc_id", k, ["dense", "lexical"])
    most = pairs.count() + k * queries.count()
    return filled.repartition(bucket_count(pairs.sparkSession, PAIR_BYTES * most), "query_id")


def hybrid_whole_bank(queries: DataFrame, query_id: str, query_text: str, bank: DataFrame, bank_id: str,
                      bank_text: str, k: int = 10, weight: float = DENSE_WEIGHT, index: LexicalIndex | None = None) -> DataFrame:
    """Dense and BM25 scores scaled over the whole bank, fused and cut to ``k``; ``index`` is the bank's, if there is one."""
    index = index or lexical_index(bank, bank_id, bank_text)
    rows = cut_lineage(fused_sparse_topk(queries, query_id, query_text, index, k, weight))
    rows = R.fill_lists(rows, queries, query_id, index.documents, "doc_id", k, ["dense", "lexical", "score"])
    return R.rank_topk(rows, k, item="doc_id")


def hybrid_pooled(queries: DataFrame, query_id: str, query_text: str, bank: DataFrame, bank_id: str,
                  bank_text: str, entity: str, phrase: str, k: int = 5, fetch_k: int = 50,
                  weight: float = DENSE_WEIGHT, index: LexicalIndex | None = None) -> DataFrame:
    """Pool of both lists, scaled and fused inside the pool, phrase boost, best row per entity."""
    index = index or lexical_index(bank, bank_id, bank_text)
    pairs = filled_pairs(queries, query_id, query_text, index, fetch_k)
    pool = Fu.fuse_pool(Fu.pool_union(pairs, fetch_k), weight)
    boosted = with_boost(pool.withColumnRenamed("score", "hybrid_score"), "hybrid_score",
                         queries, query_id, query_text, bank, bank_id, entity, phrase, names=False)
    top = R.distinct_topk(boosted, k, item="doc_id").withColumnRenamed("entity", "_key")
    names = bank.select(F.col(bank_id).alias("doc_id"), F.col(entity).alias("entity"), entity_key(entity).alias("_key")).distinct()
    return top.join(names, ["doc_id", "_key"]).select(*boosted.columns, "rank")


def hybrid_vectors(queries: DataFrame, query_id: str, query_text: str, query_vec: str,
                   bank: DataFrame, bank_id: str, bank_text: str, bank_vec: str,
                   k: int = 10, weight: float = DENSE_WEIGHT, index: LexicalIndex | None = None) -> DataFrame:
    """Exact whole-bank fusion of vector cosine and BM25: ranges first, then the fused block product, which scores the
    terms of its block itself; no table of pairs is made."""
    index = index or lexical_index(bank, bank_id, bank_text, cosine=False)
    asked = asked_terms(queries, query_id, query_text, index)
    l_range = score_limits(found_rows(asked, 1, [LEXICAL], lows=True), index.facts["n_docs"]).select("query_id", "lo_lexical", "hi_lexical")
    d_range = dense_range(queries, query_id, query_vec, bank, bank_id, bank_vec)
    ranges = d_range.withColumnsRenamed({"lo": "lo_dense", "hi": "hi_dense"}).join(l_range, "query_id", "left")
    ranges = cut_lineage(ranges.fillna(0.0, ["lo_lexical", "hi_lexical"]))
    return fused_topk(queries, query_id, query_vec, bank, bank_id, bank_vec, asked, ranges, k, weight)


def entity_key(entity: str) -> Column:
    """Stands for an entity of any length in keys; never null."""
    return F.coalesce(F.unhex(F.md5(F.col(entity).cast("string"))), F.unhex(F.lit("00")))


def with_boost(scored: DataFrame, base: str, queries: DataFrame, query_id: str, query_text: str,
               bank: DataFrame, bank_id: str, entity: str, phrase: str, item: str = "doc_id", names: bool = True) -> DataFrame:
    """Add entity, ``phrase_boost`` and ``score`` = base + boost to candidate rows.

    Phrase hits come from one pass over the query texts, so no candidate row carries its query's text; they meet a query's
    rows as one list. ``names=False``: ``entity`` holds ``entity_key``, so that texts of entities are not sorted or shuffled.
    """
    q = spread(queries.select(F.col(query_id).alias("_q_id"), query_text)).select("_q_id", normal_tokens(query_text).alias("_q"))
    b = bank.select(F.col(bank_id).alias("_b_id"), normal_tokens(phrase).alias("_p"))
    hits = token_run_matches(q, "_q_id", "_q", b, "_b_id", "_p").groupBy("query_id").agg(F.collect_set("phrase_id").alias("_hits"))
    known = bank.select(F.col(bank_id).alias(item), (F.col(entity) if names else entity_key(entity)).alias("entity"))
    out = scored.join(known, item).join(hits, "query_id", "left")
    match = F.coalesce(F.array_contains("_hits", F.col(item)), F.lit(False))
    out = out.withColumn("phrase_boost", phrase_boost(F.when(match, F.lit(1.0)).otherwise(F.lit(0.0))))
    return out.withColumn("score", r6(F.col(base) + F.col("phrase_boost"))).drop("_hits")


def hybrid_rerank(queries: DataFrame, query_id: str, query_text: str, bank: DataFrame, bank_id: str, bank_text: str,
                  entity: str, phrase: str, scorer: PairScorer, pool: int = 20, k: int = 5, index: LexicalIndex | None = None) -> DataFrame:
    """Pooled hybrid search with boost, one row per entity, ``pool`` entities; rescored as pairs and cut to ``k``."""
    ranked = hybrid_pooled(queries, query_id, query_text, bank, bank_id, bank_text, entity, phrase, pool, index=index)
    ranked = ranked.select("query_id", F.col("doc_id").alias("bank_id"), "rank", "score")
    pairs = scored_pairs(ranked, queries, query_id, query_text, bank, bank_id, entity, bank_text, scorer)
    return rerank_candidates(pairs, scorer, k)


def scored_pairs(ranked: DataFrame, queries: DataFrame, query_id: str, query_text: str, bank: DataFrame, bank_id: str,
                 entity: str, meaning: str, scorer: PairScorer) -> DataFrame:
    """Pairs as ``scorer`` wants them: with texts, or with the words of each text, which are then made once a text."""
    make = candidate_words if getattr(scorer, "wants_words", False) else candidate_pairs
    return make(ranked, queries, query_id, query_text, bank, bank_id, entity, meaning)


def rerank_candidates(candidates: DataFrame, scorer: PairScorer, k: int) -> DataFrame:
    """Score (query, candidate) pairs and re-order each list; all score columns are kept."""
    return R.rerank(scorer(candidates), k)


def mining_set(queries: DataFrame, ranked: DataFrame, n: int = 3, depth: int = 10) -> DataFrame:
    return training_pairs(queries, ranked, n, depth)


def mined_pairs(queries: DataFrame, query_id: str, query_vec: str, entity: str, n: int = 3, depth: int = 10,
                folds: int = 2, val: float = 0.1) -> DataFrame:
    """(query_id, candidate, label, split): training pairs mined on the train side, fold by fold.

    A query is searched against the rows of the other folds, so no row it learns from is its own or its fold's; the
    gold entity is the positive, the ``n`` best wrong entities of the first ``depth`` are the negatives. Queries, not
    pairs, are dealt to training and validation.
    """
    rows = cut_lineage(queries.select(F.col(query_id).alias("_id"), F.col(query_vec).alias("_v"), F.col(entity).alias("_e"))
                       .withColumn("_fold", fold_of("_id", folds)))
    found = None
    for f in range(folds):
        own, bank = rows.where(F.col("_fold") == f), rows.where(F.col("_fold") != f)
        ranked = dense_retrieval(own, "_id", "_v", "_e", bank, "_id", "_v", "_e", depth, 10 * depth)
        found = ranked if found is None else found.unionByName(ranked)
    gold = rows.select(F.col("_id").alias("query_id"), F.col("_e").alias("gold"))
    pairs = training_pairs(gold, cut_lineage(found), n, depth)
    return pairs.join(pair_split(gold.select("query_id"), "query_id", val), "query_id")


def two_layer_answers(queries: DataFrame, query_id: str, query_text: str, index: LexicalIndex, bank: DataFrame, bank_id: str,
                      bank_text: str, entity: str, scorer: PairScorer, k: int = 3, pool: int = 20) -> DataFrame:
    """(query_id, bank_id, entity, fused, rerank_score, rank): dense top ``pool`` with its lexical scores, fused, scored
    as pairs, best row per entity, cut to ``k``."""
    pairs = filled_pairs(queries, query_id, query_text, index, pool)
    top = Fu.fuse_demo(R.rank_topk(pairs, pool, score="dense", item="doc_id"))
    top = top.select("query_id", F.col("doc_id").alias("bank_id"), "rank", r6("score").alias("fused"))
    scored = scorer(scored_pairs(top, queries, query_id, query_text, bank, bank_id, entity, bank_text, scorer))
    names = bank.select(F.col(bank_id).alias("bank_id"), F.col(entity).alias("entity"))
    found = scored.select("query_id", "bank_id", "fused", "rerank_score").join(names, "bank_id")
    return R.distinct_topk(found, k, score="rerank_score")


def two_layer(queries: DataFrame, detections: DataFrame, answers: DataFrame) -> DataFrame:
    """Detector verdict and flags beside the retrieved meanings of every query."""
    notes = detections.select("query_id", "label_name", "confidence", *C.weak_flags("label_name", "confidence"))
    return queries.join(notes, "query_id").join(answers, "query_id", "left")


def meaning_answers(ranked: DataFrame, bank: DataFrame, bank_id: str, fields: list[str]) -> DataFrame:
    """Ranked rows plus one JSON answer; languages without a meaning are left out of it."""
    b = bank.select(F.col(bank_id).alias("bank_id"), F.to_json(F.struct(*fields)).alias("answer"))
    return ranked.join(b, "bank_id")
