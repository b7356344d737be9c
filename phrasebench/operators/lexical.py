"""Lexical scoring over postings.

Searches go over blocks of postings by term (``blockmax``). Here are the index itself and the scores of all pairs that
share a term, for callers that need every pair. For those both sides are partitioned by text id before the text is
split into terms. The side whose measured size allows is broadcast; term counts, norms and the sum of a (query,
document) pair then stay inside the other side's partitioning. When neither side is small the join is a shuffle on
(term, salt), so a term found in a third of all documents is spread over many tasks. No term is ever dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phrasebench.fixed import EPSILON, K1, MAX_FEATURES, MIN_DF, B
from phrasebench.functions.numeric import bm25_weight, r6, safe_ratio
from phrasebench.functions.text import tokenize_ws
from phrasebench.operators.blockmax import (
    DENSE, LEXICAL, LIMITS, RANGE_UNITS, Asked, Goal, found_rows, number_of, part_of, place_documents, score_limits, store_blocks, weighted, with_ids)
from phrasebench.session import bucket_count, cut_lineage, measured_bytes, scratch_path, store_bucketed

SALTS = 32
#: So many of the most frequent terms at most are broadcast where every posting needs its term's idf.
COMMON = 1 << 17
#: Text that may be broadcast as term rows; the rows take about ten times the text's size.
TEXT_BYTES = 8 * 1024 * 1024


def postings(bank: DataFrame, doc_id: str, text: str, spread: bool = True) -> DataFrame:
    """(doc_id, dl, term, tf), partitioned by ``doc_id``; ``spread=False`` when the bank already is."""
    docs = bank.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    docs = docs.repartition("doc_id") if spread else docs
    # the length is taken before the split into rows, so no row carries its document's token array
    docs = docs.withColumn("dl", F.size(tokenize_ws("_text")))
    terms = docs.select("doc_id", "dl", F.explode(tokenize_ws("_text")).alias("term"))
    return terms.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term, qf), partitioned by ``query_id``; a repeated query term counts again through qf."""
    rows = queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("_text"))
    # as in an index: a task splits and counts texts of bounded size, however many there are
    rows = rows.repartition(bucket_count(rows.sparkSession, 10 * measured_bytes(rows.select("_text"))), "query_id")
    terms = rows.select("query_id", F.explode(tokenize_ws("_text")).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("qf"))


@dataclass
class LexicalIndex:
    """Postings by document and by term, term statistics, norms and ids of one bank; all can be stored and read back."""

    postings: DataFrame    # doc_id, dl, term, tf
    terms: DataFrame       # part, term, number, df, cf, raw_idf, smooth_idf
    documents: DataFrame   # doc_id
    norms: DataFrame | None  # doc_id, norm of its tf-idf vector over all terms; None when only BM25 is asked for
    blocks: DataFrame      # part, number, range, slot, w, c
    tops: DataFrame        # part, number, range, n, top_w, top_c
    places: DataFrame      # doc_id, range, slot
    facts: dict            # buckets, parts, ranges, n_docs, tokens, mean_idf, text_bytes, seed

    def n_docs(self) -> Column:
        return F.lit(self.facts["n_docs"])

    def avg_length(self) -> Column:
        return F.lit(average_length(self.facts))

    def mean_idf(self) -> Column:
        return F.lit(self.facts["mean_idf"]).cast("double")

    def term_stats(self) -> DataFrame:
        """(term, df, cf, idf, smooth_idf): a negative idf becomes a quarter of the mean idf."""
        floor = F.lit(EPSILON) * self.mean_idf()
        idf = F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf"))
        return self.terms.select("term", "df", "cf", idf.alias("idf"), "smooth_idf")


def average_length(facts: dict) -> float:
    return (facts["tokens"] or 0) / max(facts["n_docs"], 1)


def lexical_index(bank: DataFrame, doc_id: str, text: str, path: str | None = None, cosine: bool = True,
                  range_units: int = RANGE_UNITS) -> LexicalIndex:
    """Build the index once: postings in bucket files by document and in blocks by term, one statistics row per term.

    ``path`` keeps it for later jobs, replacing what is there; without one it goes to the shared scratch folder.
    ``cosine=False`` leaves out the norms, for which postings of rare terms are shuffled once more.
    """
    spark = bank.sparkSession
    root = path or scratch_path(spark, "lexical")
    size = measured_bytes(bank.select(text))
    # postings of a text take about ten times its bytes
    buckets = bucket_count(spark, 10 * size)
    rows = postings(bank.repartition(buckets, F.col(doc_id)), doc_id, text, spread=False)
    post = store_bucketed(rows, f"{root}/postings", "doc_id", buckets)
    docs = bank.select(F.col(doc_id).alias("doc_id"))
    facts = {"buckets": buckets, "parts": buckets, "n_docs": docs.count(), "text_bytes": size}
    n = F.lit(facts["n_docs"])
    terms = (
        post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        .withColumn("raw_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        .withColumn("smooth_idf", F.log((n + 1.0) / (F.col("df") + 1.0)) + 1)
    )
    # numbers are as good as terms where they are all different; the first seed practically always is
    terms, facts["seed"] = cut_lineage(terms), 0
    while terms.agg(F.count("*") - F.count_distinct(number_of("term", facts["seed"]))).first()[0]:
        facts["seed"] += 1
    terms = terms.withColumn("number", number_of("term", facts["seed"])).withColumn("part", part_of(F.col("number"), facts["parts"]))
    terms.repartition(facts["parts"], "part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{root}/terms")
    terms = spark.read.schema(terms.schema).parquet(f"{root}/terms")
    total = terms.agg(F.avg("raw_idf").alias("mean_idf"), F.sum("cf").alias("tokens")).first()
    facts |= {"mean_idf": total["mean_idf"], "tokens": total["tokens"]}
    placed = place_documents(post.groupBy("doc_id").agg(F.max("dl").alias("dl")), range_units)
    places = store_bucketed(placed.repartition(buckets, "doc_id"), f"{root}/places", "doc_id", buckets)
    facts["ranges"] = (places.agg(F.max("range")).first()[0] or 0) + 1
    norms, placed_rows = None, post.join(places.hint("shuffle_hash"), "doc_id")
    if cosine:
        norms = document_norms(post, terms)
        norms = store_bucketed(norms.repartition(buckets, "doc_id"), f"{root}/norms", "doc_id", buckets)
        placed_rows = placed_rows.join(norms.hint("shuffle_hash"), "doc_id")
    else:
        placed_rows = placed_rows.withColumn("norm", F.lit(None).cast("double"))
    blocks, tops = store_blocks(weighted(placed_rows, facts, average_length(facts)), root, buckets)
    return LexicalIndex(post, terms, docs, norms, blocks, tops, places, facts)


def common_terms(terms: DataFrame, most: int = COMMON) -> DataFrame:
    """(term, smooth_idf) of the terms in so many documents that at most ``most`` are, so they can be broadcast."""
    height = F.floor(F.log2("df"))
    sizes = {int(r["h"]): r["count"] for r in terms.groupBy(height.alias("h")).count().collect()}  # 63 rows at most
    bar, held = max(sizes, default=0) + 1, 0
    for h in sorted(sizes, reverse=True):
        held += sizes[h]
        if held > most:
            break
        bar = h
    return cut_lineage(terms.where(height >= bar).select("term", "smooth_idf"))


def document_norms(post: DataFrame, terms: DataFrame, most: int = COMMON) -> DataFrame:
    """(doc_id, norm) of the tf-idf vectors. Frequent terms hold most postings and come to them by broadcast; only the
    postings of the other terms are shuffled."""
    common = F.broadcast(common_terms(terms, most))
    weight = F.col("tf") * F.col("smooth_idf")
    near = post.join(common, "term")
    far = post.join(common, "term", "left_anti").join(terms.select("term", "smooth_idf").hint("shuffle_hash"), "term")
    squares = [rows.groupBy("doc_id").agg(F.sum(weight * weight).alias("_s")) for rows in (near, far)]
    return squares[0].unionByName(squares[1]).groupBy("doc_id").agg(F.sqrt(F.sum("_s")).alias("norm"))


def asked_terms(queries: DataFrame, query_id: str, text: str, index: LexicalIndex) -> Asked:
    return Asked(query_terms(queries, query_id, text), index)


def bm25_topk(queries: DataFrame, query_id: str, query_text: str, index: LexicalIndex, k: int) -> DataFrame:
    """(query_id, doc_id, lexical): rows that hold the first ``k`` of every query by BM25, ties by lower id."""
    return with_ids(found_rows(asked_terms(queries, query_id, query_text, index), k, [LEXICAL]), index).drop("dense")


def sparse_topk(queries: DataFrame, query_id: str, query_text: str, index: LexicalIndex, k: int) -> DataFrame:
    """(query_id, doc_id, dense, lexical): rows that hold the first ``k`` of every query by either score."""
    return with_ids(found_rows(asked_terms(queries, query_id, query_text, index), k, [DENSE, LEXICAL]), index)


def fused_sparse_topk(queries: DataFrame, query_id: str, query_text: str, index: LexicalIndex, k: int, weight: float) -> DataFrame:
    """(query_id, doc_id, dense, lexical, score): rows that hold the first ``k`` by both scores, scaled over the whole
    bank and fused. A first pass finds the queries' score ranges, a second the rows; ranges that cannot matter are left unread."""
    asked = asked_terms(queries, query_id, query_text, index)
    limits = cut_lineage(score_limits(found_rows(asked, 1, [DENSE, LEXICAL], lows=True), index.facts["n_docs"]))
    goal = Goal(weight, scaled=True)
    rows = with_ids(found_rows(asked, k, [goal], limits), index).join(limits, "query_id")
    return rows.withColumn("score", goal.column(F.col("dense"), F.col("lexical"))).drop(*LIMITS)


def small_side(queries: DataFrame, query_text: str, bank_bytes: int, limit: int = TEXT_BYTES) -> str | None:
    """The smaller side, if its measured text may be broadcast as term rows; else None."""
    if limit <= 0:
        return None
    sizes = {"queries": measured_bytes(queries.select(query_text)), "bank": bank_bytes}
    side = min(sizes, key=sizes.get)
    return side if sizes[side] <= limit else None


def match_terms(post: DataFrame, terms: DataFrame, small: str | None) -> DataFrame:
    """Postings joined to query terms on ``term``; ``terms`` holds one row per query and term."""
    if small == "queries":
        return post.join(F.broadcast(terms), "term")
    if small == "bank":
        return terms.join(F.broadcast(post), "term")
    salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = post.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["term", "_salt"]).drop("_salt")


def bm25_scores(queries: DataFrame, query_id: str, query_text: str, index: LexicalIndex,
                k1: float = K1, b: float = B, limit: int = TEXT_BYTES) -> DataFrame:
    """(query_id, doc_id, lexical) for every pair that shares a term; all other pairs score 0."""
    small = small_side(queries, query_text, index.facts["text_bytes"], limit)
    terms = query_terms(queries, query_id, query_text)
    terms = terms.join(index.term_stats(), "term").select("query_id", "term", "qf", "idf")
    weight = F.col("qf") * bm25_weight("tf", "dl", "idf", index.avg_length(), k1, b)
    pairs = match_terms(index.postings, terms, small)
    return pairs.groupBy("query_id", "doc_id").agg(r6(F.sum(weight)).alias("lexical"))


def vocabulary(index: LexicalIndex, max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> DataFrame:
    """(term, df, cf, idf) of the most frequent terms, the published cut of the detection features; not used in search."""
    kept = index.terms.where(F.col("df") >= min_df)
    kept = kept.orderBy(F.desc("cf"), "term").limit(max_features)
    idf = F.log((F.lit(1.0) + index.n_docs()) / (F.lit(1.0) + F.col("df"))) + 1
    return kept.select("term", "df", "cf", idf.alias("idf"))


def tfidf_weights(index: LexicalIndex, vocab: DataFrame) -> DataFrame:
    """(doc_id, term, weight): L2-normalised tf-idf over the capped vocabulary."""
    raw = index.postings.join(F.broadcast(vocab.select("term", "idf")), "term")
    raw = raw.withColumn("_w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return raw.join(norms, "doc_id").select("doc_id", "term", (F.col("_w") / F.col("_n")).alias("weight"))


def sparse_scores(queries: DataFrame, query_id: str, query_text: str, index: LexicalIndex,
                  limit: int = TEXT_BYTES) -> DataFrame:
    """(query_id, doc_id, dense, lexical) from one pass over the postings.

    ``dense`` is the cosine of tf-idf vectors over all terms of the bank, the stand-in for an encoder; ``lexical`` is
    BM25. Pairs without a common term are left out: both scores are 0 there. A query's norm counts the bank's terms.
    """
    small = small_side(queries, query_text, index.facts["text_bytes"], limit)
    q = query_terms(queries, query_id, query_text).join(index.term_stats().select("term", "idf", "smooth_idf"), "term")
    q = q.withColumn("q_w", F.col("qf") * F.col("smooth_idf"))
    q = q.withColumn("q_norm", F.sqrt(F.sum(F.col("q_w") * F.col("q_w")).over(W.partitionBy("query_id"))))
    d = index.postings.join(index.norms, "doc_id")
    bm25 = F.col("qf") * bm25_weight("tf", "dl", "idf", index.avg_length())
    pairs = match_terms(d, q, small).groupBy("query_id", "doc_id").agg(
        F.sum(F.col("q_w") * F.col("tf") * F.col("smooth_idf")).alias("_dot"), F.sum(bm25).alias("_bm25"),
        F.max("q_norm").alias("q_norm"), F.max("norm").alias("d_norm"))
    dense = safe_ratio(F.col("_dot"), F.col("q_norm") * F.col("d_norm"))
    return pairs.select("query_id", "doc_id", r6(dense).alias("dense"), r6("_bm25").alias("lexical"))
