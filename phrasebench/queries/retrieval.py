"""Dense, lexical and hybrid retrieval; rerank tables; two-layer answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasebench.functions.numeric import r6
from phrasebench.functions.text import normal_tokens
from phrasebench.operators import detect as D
from phrasebench.operators import fusion as Fu
from phrasebench.operators import lexical as L
from phrasebench.operators import rank as R
from phrasebench.operators import rerank as K
from phrasebench.operators.dense import dense_range, dense_topk
from phrasebench.operators.densestore import dense_index, indexed_topk, open_dense_index
from phrasebench.operators.embed import ALPHABET, letter_embedder, model_embedder, model_pair_scorer
from phrasebench.operators.phrases import token_run_matches
from phrasebench.operators.split import within_entity_split
from phrasebench.plans import retrieval as Z
from phrasebench.queries.registry import (
    BENCH_ON_DOCS, DOCS_ON_BENCH, POOL, VECTORS, hybrid_sql, lexical_sql, md5_of, norm_of, query, ranked_vectors, tokens_of)

from phrasebench.session import cut_lineage, scratch_path, spread


def vector_sets(t):
    """Every vector is a query (held out within its label) or a bank row."""
    parts = within_entity_split(t.embeddings, "label", "vec_id")
    return parts.where(F.col("split") == "test"), parts.where(F.col("split") == "train")


def ranked_vector_rows(t, k: int = 5, fetch: int = 25):
    q, b = vector_sets(t)
    return Z.dense_retrieval(q, "vec_id", "embedding", "label", b, "vec_id", "embedding", "label", k, fetch)


_STORED: dict[tuple, L.LexicalIndex] = {}


def stored_index(t, table: str, key: str):
    """The table's index, built and stored at its first use in a session and opened by later queries."""
    at = (t.spark.sparkContext.applicationId, t.root, table)
    if at not in _STORED:
        _STORED[at] = L.lexical_index(getattr(t, table), key, "text")
    return _STORED[at]


def bench_index(t):
    """Documents as bank, passages as queries."""
    return stored_index(t, "documents", "doc_id")


def passage_index(t):
    """Passages as bank, documents as queries."""
    return stored_index(t, "benchmark", "item_id")


def bench_pairs(t, k: int = 20):
    return cut_lineage(Z.filled_pairs(t.benchmark, "item_id", "text", bench_index(t), k))


TOP5 = f"""WITH {VECTORS} SELECT query_id, bank_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_id) AS rank
FROM vpairs QUALIFY rank <= 5"""


@query("dense_top5", TOP5)
def _(t):
    """Block product, top 5 per query."""
    q, b = vector_sets(t)
    return dense_topk(q, "vec_id", "embedding", b, "vec_id", "embedding", 5)


@query("s11_dense_index", TOP5)
def _(t):
    """The bank stored as matrix blocks, opened again and searched by bounds; the list of the block product."""
    q, b = vector_sets(t)
    path = scratch_path(t.spark, "dense")
    dense_index(b, "vec_id", "embedding", path)
    return indexed_topk(q, "vec_id", "embedding", open_dense_index(t.spark, path), 5)


@query("dense_range", f"WITH {VECTORS} SELECT query_id, min(score) AS lo, max(score) AS hi FROM vpairs GROUP BY 1")
def _(t):
    """Score range of each query over the whole bank."""
    q, b = vector_sets(t)
    return dense_range(q, "vec_id", "embedding", b, "vec_id", "embedding")


@query("dedupe_fetch", f"WITH {ranked_vectors()} SELECT query_id, rank, bank_id, score, entity FROM ranked")
def _(t):
    """Fetch 25 rows, best row per entity, cut to 5."""
    return ranked_vector_rows(t).select("query_id", "rank", "bank_id", "score", "entity")


@query("w08_without_overfetch", f"WITH {ranked_vectors(5, 5)} SELECT query_id, rank, bank_id, score, entity FROM ranked")
def _(t):
    """Top 5 rows first, then distinct entities: often fewer than 5."""
    return ranked_vector_rows(t, 5, 5).select("query_id", "rank", "bank_id", "score", "entity")


@query("z11_prediction_rows", f"""WITH {ranked_vectors(5, 5)} SELECT query_id, max(gold) AS gold, max(entity) FILTER (rank = 1) AS pred_top1,
 array_to_string(list(entity ORDER BY rank), ',') AS pred_top5, max(score) FILTER (rank = 1) AS top1_score,
 (max(entity) FILTER (rank = 1) = max(gold))::INT AS top1_correct, max((entity = gold)::INT) AS top5_correct FROM ranked GROUP BY query_id""")
def _(t):
    """One prediction row per query."""
    from phrasebench.functions.numeric import equal_flag, gold_in_first
    ranked = ranked_vector_rows(t, 5, 5)
    lists = R.prediction_lists(ranked, 5)
    heads = ranked.where(F.col("rank") == 1).select("query_id", "gold", F.col("entity").alias("pred_top1"), F.col("score").alias("top1_score"))
    rows = heads.join(lists, "query_id")
    return rows.select("query_id", "gold", "pred_top1", F.array_join(F.col("preds").cast("array<string>"), ",").alias("pred_top5"), "top1_score",
                       equal_flag("pred_top1", "gold").alias("top1_correct"), gold_in_first("preds", "gold", 5).alias("top5_correct"))


@query("j05_bank_rows", f"WITH {ranked_vectors()} SELECT r.query_id, r.rank, r.bank_id, v.label, round(v.v[1], 6) AS first_value FROM ranked r JOIN vs v ON v.vec_id = r.bank_id")
def _(t):
    """Bank rows of the candidates."""
    bank = t.embeddings.select(F.col("vec_id").alias("bank_id"), "label", r6(F.col("embedding")[0]).alias("first_value"))
    return ranked_vector_rows(t).select("query_id", "rank", "bank_id").join(bank, "bank_id")


@query("j12_align", f"WITH {ranked_vectors()} SELECT e.vec_id AS query_id, e.label AS gold, r.entity AS pred FROM ranked r JOIN embeddings e ON e.vec_id = r.query_id WHERE r.rank = 1")
def _(t):
    """Predictions beside their source rows, by id."""
    top = ranked_vector_rows(t).where(F.col("rank") == 1).select("query_id", F.col("entity").alias("pred"))
    src = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold"))
    return top.join(src, "query_id")


# ---- lexical -------------------------------------------------------------------------------------

@query("lexical_stats", f"""WITH w AS (SELECT doc_id, {tokens_of('text')} AS w FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL),
st AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term),
raw AS (SELECT *, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM st)
SELECT term, df, cf, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END, 6) AS idf FROM raw""")
def _(t):
    """Document frequency, collection frequency and floored idf of every term."""
    return bench_index(t).term_stats().select("term", "df", "cf", r6("idf").alias("idf"))


@query("bm25_top10", f"WITH {lexical_sql(*BENCH_ON_DOCS)} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10")
def _(t):
    """Passages as queries, all documents as bank."""
    return Z.lexical_retrieval(t.benchmark, "item_id", "text", bench_index(t), 10)


@query("bm25_recall_curve", f"""WITH {lexical_sql(*BENCH_ON_DOCS)},
d AS (SELECT doc_id, ' ' || array_to_string({norm_of('text')}, ' ') || ' ' AS q FROM documents),
p AS (SELECT item_id, ' ' || array_to_string({norm_of('text')}, ' ') || ' ' AS p FROM benchmark),
gold AS (SELECT item_id AS query_id, doc_id FROM d, p WHERE contains(q, p)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10),
g AS (SELECT query_id, min(rank) AS gold_rank FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN (SELECT query_id, rank FROM rk JOIN gold USING (query_id, doc_id)) USING (query_id) GROUP BY 1)
SELECT k::INT AS k, round(count_if(gold_rank <= k) / count(*), 6) AS recall FROM g, range(1, 11) t(k) GROUP BY k""")
def _(t):
    """Recall of the documents that hold the passage, k = 1..10."""
    from phrasebench.operators.metrics import recall_curve
    docs = spread(t.documents.select("doc_id", "text")).select("doc_id", normal_tokens("text").alias("q"))
    items = t.benchmark.select("item_id", normal_tokens("text").alias("p"))
    gold = token_run_matches(docs, "doc_id", "q", items, "item_id", "p").select(
        F.col("phrase_id").alias("query_id"), F.col("query_id").alias("doc_id"))
    ranked = Z.lexical_retrieval(t.benchmark, "item_id", "text", bench_index(t), 10)
    hit = gold.join(ranked, ["query_id", "doc_id"], "left")
    ranks = hit.groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    return recall_curve(ranks, 10).withColumn("recall", r6("recall"))


# ---- hybrid --------------------------------------------------------------------------------------

@query("hybrid_bank", f"""WITH {hybrid_sql(*BENCH_ON_DOCS)},
rng AS (SELECT query_id, CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN 0 ELSE min(dense) END AS d0, max(dense) AS d1,
 CASE WHEN count(*) < (SELECT count(*) FROM documents) THEN 0 ELSE min(lexical) END AS l0, max(lexical) AS l1 FROM sp GROUP BY 1),
f AS (SELECT query_id, doc_id, round(0.8::DOUBLE * CASE WHEN d1 - d0 < 1e-12 THEN 0 ELSE (dense - d0) / (d1 - d0) END
 + (1 - 0.8::DOUBLE) * CASE WHEN l1 - l0 < 1e-12 THEN 0 ELSE (lexical - l0) / (l1 - l0) END, 6) AS score FROM sp JOIN rng USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def _(t):
    """Ranges over the whole bank, fused, top 10."""
    out = Z.hybrid_whole_bank(t.benchmark, "item_id", "text", t.documents, "doc_id", "text", 10, index=bench_index(t))
    return out.select("query_id", "doc_id", "score", "rank")


@query("hybrid_pool", f"""{POOL} SELECT query_id, doc_id, entity, round(hybrid, 6) AS hybrid_score, phrase_boost, score,
 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fbest QUALIFY rank <= 5""")
def _(t):
    """Documents as queries, passages as bank."""
    out = Z.hybrid_pooled(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", "text", "text", index=passage_index(t))
    return out.select("query_id", "doc_id", "entity", r6("hybrid_score").alias("hybrid_score"), "phrase_boost", "score", "rank")


@query("j08_merge_pools", f"""WITH {hybrid_sql(*BENCH_ON_DOCS)},
d AS (SELECT query_id, doc_id, dense FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) <= 20),
l AS (SELECT query_id, doc_id, lexical FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) <= 20)
SELECT query_id, doc_id, coalesce(dense, 0) AS dense, coalesce(lexical, 0) AS lexical FROM d FULL JOIN l USING (query_id, doc_id)""")
def _(t):
    """Full outer merge of two top-20 lists."""
    pairs = bench_pairs(t)
    d = R.rank_topk(pairs, 20, score="dense", item="doc_id").select("query_id", "doc_id", "dense")
    lx = R.rank_topk(pairs, 20, score="lexical", item="doc_id").select("query_id", "doc_id", "lexical")
    return Fu.merge_pools(d, lx, ["query_id", "doc_id"])


DEMO = f"""WITH {hybrid_sql(*BENCH_ON_DOCS)},
d AS (SELECT query_id, doc_id, dense, lexical FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) <= 20)"""


@query("hybrid_demo", f"""{DEMO} SELECT query_id, doc_id, dense, lexical, round(0.65::DOUBLE * dense + (1 - 0.65::DOUBLE)
 * coalesce(lexical / nullif(max(lexical) OVER (PARTITION BY query_id), 0), 0), 6) AS score FROM d""")
def _(t):
    """Dense top 20 with BM25 over its maximum."""
    pairs = bench_pairs(t)
    d = R.rank_topk(pairs, 20, score="dense", item="doc_id").select("query_id", "doc_id", "dense", "lexical")
    return Fu.fuse_demo(d).select("query_id", "doc_id", "dense", "lexical", r6("score").alias("score"))


@query("j16_attach_lexical", f"""WITH {hybrid_sql(*BENCH_ON_DOCS)},
d AS (SELECT query_id, doc_id, dense FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) <= 20),
l AS (SELECT query_id, doc_id, lexical FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) <= 20)
SELECT query_id, doc_id, dense, coalesce(lexical, 0) AS lexical FROM d LEFT JOIN l USING (query_id, doc_id)""")
def _(t):
    """J16"""
    index = bench_index(t)
    d = R.rank_topk(Z.filled_pairs(t.benchmark, "item_id", "text", index, 20), 20, score="dense", item="doc_id")
    lx = Z.lexical_retrieval(t.benchmark, "item_id", "text", index, 20).select("query_id", "doc_id", "lexical")
    return Fu.attach_lexical(d.select("query_id", "doc_id", "dense"), lx, ["query_id", "doc_id"])


LIST50 = f"""WITH {lexical_sql(*BENCH_ON_DOCS)},
l AS (SELECT query_id, doc_id, lexical FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) <= 50),
r AS (SELECT query_id, min(lexical) AS lo, max(lexical) AS hi FROM l GROUP BY 1)"""


def lexical_pool(t):
    return Z.lexical_retrieval(t.benchmark, "item_id", "text", bench_index(t), 50).select("query_id", "doc_id", "lexical")


@query("w05_minmax", f"""{LIST50} SELECT query_id, doc_id, lexical, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (lexical - lo) / (hi - lo) END, 6) AS lexical_norm
FROM l JOIN r USING (query_id)""")
def _(t):
    """Min-max scaling inside each query's candidate pool."""
    return Fu.minmax_pool(lexical_pool(t), ["lexical"]).withColumn("lexical_norm", r6("lexical_norm"))


@query("a41_max_scale", f"""{LIST50} SELECT query_id, doc_id, lexical, round(coalesce(lexical / nullif(hi, 0), 0), 6) AS lexical_max_norm FROM l JOIN r USING (query_id)""")
def _(t):
    """Over each query's candidate pool."""
    return Fu.max_scale(lexical_pool(t), "lexical").withColumn("lexical_max_norm", r6("lexical_max_norm"))


@query("phrase_boost_search", f"""WITH {hybrid_sql(*DOCS_ON_BENCH)},
d AS (SELECT query_id, doc_id, dense FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) <= 30),
q AS (SELECT doc_id AS query_id, ' ' || array_to_string({norm_of('text')}, ' ') || ' ' AS qrun FROM documents),
p AS (SELECT item_id AS doc_id, text AS entity, ' ' || array_to_string({norm_of('text')}, ' ') || ' ' AS prun FROM benchmark),
b AS (SELECT query_id, doc_id, entity, dense, CASE WHEN contains(qrun, prun) THEN 0.2::DOUBLE ELSE 0 END AS phrase_boost FROM d JOIN q USING (query_id) JOIN p USING (doc_id)),
s AS (SELECT *, round(dense + phrase_boost, 6) AS score FROM b),
e AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, entity ORDER BY score DESC, doc_id) = 1)
SELECT query_id, doc_id, dense, phrase_boost, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM e QUALIFY rank <= 5""")
def _(t):
    """Dense top 30, boost for a contained phrase, best row per entity."""
    index = passage_index(t)
    pairs = Z.filled_pairs(t.documents, "doc_id", "text", index, 30)
    d = R.rank_topk(pairs, 30, score="dense", item="doc_id").select("query_id", "doc_id", "dense")
    boosted = Z.with_boost(d, "dense", t.documents, "doc_id", "text", t.benchmark, "item_id", "text", "text", names=False)
    return R.distinct_topk(boosted, 5, item="doc_id").select("query_id", "doc_id", "dense", "phrase_boost", "score", "rank")


LETTERS = (f"list_transform(string_split('{','.join(ALPHABET)}', ','), lambda c: (length(lower(text)) - length(replace(lower(text), c, '')))::DOUBLE)")


@query("m11_letter_vectors", f"WITH e AS (SELECT doc_id, {LETTERS} AS v FROM documents) SELECT doc_id, array_to_string(list_transform(v, lambda x: x::BIGINT), ',') AS vec FROM e")
def _(t):
    """An embedder adds a vector column."""
    rows = letter_embedder("text")(t.documents.select("doc_id", "text"))
    return rows.select("doc_id", F.array_join(F.col("vec").cast("array<bigint>").cast("array<string>"), ",").alias("vec"))


@query("hybrid_vectors", f"""WITH {lexical_sql(*BENCH_ON_DOCS)},
qv AS (SELECT item_id AS query_id, {LETTERS} AS v FROM benchmark), bv AS (SELECT doc_id, {LETTERS} AS v FROM documents),
c AS (SELECT query_id, doc_id, coalesce(round(list_dot_product(q.v, b.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 6), 0) AS dense FROM qv q, bv b),
s AS (SELECT query_id, doc_id, dense, coalesce(lexical, 0) AS lexical FROM c LEFT JOIN bm USING (query_id, doc_id)),
r AS (SELECT query_id, min(dense) AS d0, max(dense) AS d1, min(lexical) AS l0, max(lexical) AS l1 FROM s GROUP BY 1),
f AS (SELECT query_id, doc_id, dense, lexical, round(0.8::DOUBLE * CASE WHEN d1 - d0 < 1e-12 THEN 0 ELSE (dense - d0) / (d1 - d0) END
 + (1 - 0.8::DOUBLE) * CASE WHEN l1 - l0 < 1e-12 THEN 0 ELSE (lexical - l0) / (l1 - l0) END, 6) AS score FROM s JOIN r USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def _(t):
    """Z07 with vectors, M11: ranges of both scores first, then a block product that carries the lexical scores."""
    embed = letter_embedder("text")
    # vectors are made once and stored, as an encoder's would be
    q = cut_lineage(embed(t.benchmark.select("item_id", "text")))
    b = cut_lineage(embed(t.documents.select("doc_id", "text")))
    return Z.hybrid_vectors(q, "item_id", "text", "vec", b, "doc_id", "text", "vec", 10, index=bench_index(t))


# ---- rerank --------------------------------------------------------------------------------------

@query("w09_hard_negatives", f"""WITH {ranked_vectors(10, 100)} SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS neg_rank
FROM ranked WHERE entity <> gold QUALIFY neg_rank <= 3""")
def _(t):
    """Up to three best-ranked wrong entities of the first ten."""
    return K.hard_negatives(ranked_vector_rows(t, 10, 100)).select("query_id", "entity", "neg_rank")


@query("hard_negatives", f"""WITH {ranked_vectors(10, 100)}, n AS (SELECT query_id, entity FROM ranked WHERE entity <> gold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3)
SELECT vec_id AS query_id, label AS candidate, 1.0::DOUBLE AS label FROM vs WHERE split = 'test' UNION ALL SELECT query_id, entity, 0.0::DOUBLE FROM n""")
def _(t):
    """One positive and up to three hard negatives per query."""
    q, _b = vector_sets(t)
    ranked = ranked_vector_rows(t, 10, 100)
    return Z.mining_set(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")), ranked)


PAIRS = f"""WITH {lexical_sql(*BENCH_ON_DOCS)},
t10 AS (SELECT query_id, doc_id, lexical, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10),
prs AS (SELECT t10.query_id, t10.doc_id AS bank_id, rank, b.text AS query, d.source || ' | ' || d.text AS candidate
 FROM t10 JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id))"""


def pair_rows(t):
    ranked = Z.lexical_retrieval(t.benchmark, "item_id", "text", bench_index(t), 10)
    ranked = ranked.select("query_id", F.col("doc_id").alias("bank_id"), "rank")
    return K.candidate_pairs(ranked, t.benchmark, "item_id", "text", t.documents, "doc_id", "source", "text")


@query("rerank_pairs", f"{PAIRS} SELECT query_id, bank_id, rank, query, candidate FROM prs")
def _(t):
    """(query, entity | meaning) pairs of the first ten."""
    return pair_rows(t).select("query_id", "bank_id", "rank", "query", "candidate")


OVERLAP_STEPS = f""", st2 AS (SELECT *, list_distinct({tokens_of('query')}) AS qs, list_distinct({tokens_of('candidate')}) AS cs2,
 ' ' || array_to_string({norm_of('query')}, ' ') || ' ' AS qr, ' ' || array_to_string({norm_of('candidate')}, ' ') || ' ' AS cr FROM prs),
rs AS (SELECT query_id, bank_id, rank, len(list_intersect(qs, cs2)) / len(list_distinct(list_concat(qs, cs2)))
 + 0.5::DOUBLE * CASE WHEN contains(qr, cr) THEN 1 ELSE 0 END AS raw FROM st2),
rr AS (SELECT query_id, bank_id, rank, round(raw, 6) AS rerank_score FROM rs)"""
OVERLAP = PAIRS + OVERLAP_STEPS

POOL20 = f"""{POOL}, f20 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fbest QUALIFY rank <= 20),
prs AS (SELECT f20.query_id, f20.doc_id AS bank_id, rank, d.text AS query, b.text || ' | ' || b.text AS candidate
 FROM f20 JOIN documents d ON d.doc_id = f20.query_id JOIN benchmark b ON b.item_id = f20.doc_id)"""


def rounded_overlap(pairs):
    return K.overlap_scorer(pairs).withColumn("rerank_score", r6("rerank_score"))


rounded_overlap.wants_words = True


@query("hybrid_rerank", f"""{POOL20}{OVERLAP_STEPS} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, bank_id) AS rerank_rank FROM rr QUALIFY rerank_rank <= 5""")
def _(t):
    """Pooled hybrid search with boost, 20 entities a query, rescored as pairs, first five."""
    out = Z.hybrid_rerank(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", "text", "text", rounded_overlap, index=passage_index(t))
    return out.select("query_id", "bank_id", "rank", "rerank_score", "rerank_rank")


@query("w05_display_scale", f"""{OVERLAP}, x AS (SELECT query_id, min(rerank_score) AS lo, max(rerank_score) AS hi FROM rr GROUP BY 1)
SELECT query_id, bank_id, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (rerank_score - lo) / (hi - lo) END, 6) AS shown FROM rr JOIN x USING (query_id)""")
def _(t):
    """Rerank scores scaled for display inside each list."""
    scored = rounded_overlap(pair_rows(t))
    shown = Fu.minmax_pool(scored, ["rerank_score"])
    return shown.select("query_id", "bank_id", r6("rerank_score_norm").alias("shown"))


@query("tfidf_top_terms", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w),
s AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2 ORDER BY cf DESC, term LIMIT 30000)
SELECT term, df, cf, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS idf FROM s""")
def _(t):
    """Uni- and bigrams, at least two documents, the 30,000 most frequent, smoothed idf."""
    return D.term_table(t.documents, "doc_id", "text").withColumn("idf", r6("idf"))


@query("m08_tfidf_weights", f"""WITH {lexical_sql(*BENCH_ON_DOCS)},
vocab AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS vi FROM st, nn WHERE df >= 2 ORDER BY cf DESC, term LIMIT 30000),
dn AS (SELECT doc_id, sqrt(sum((tf * vi) * (tf * vi))) AS dn FROM tf JOIN vocab USING (term) GROUP BY 1) SELECT doc_id, term, round(tf * vi / dn, 6) AS weight FROM tf JOIN vocab USING (term) JOIN dn USING (doc_id)""")
def _(t):
    """L2-normalised tf-idf weights in table form."""
    index = bench_index(t)
    return L.tfidf_weights(index, L.vocabulary(index)).withColumn("weight", r6("weight"))


def detection_rows(t):
    return t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id")


def detector(rows):
    return D.fit_text_classifier(rows.where(F.col("split") == "train"), "text", "quality")


GROUPS = f"""r AS (SELECT d.doc_id, d.text, l.quality, md5(d.text) AS k FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT k, row_number() OVER (ORDER BY {md5_of('k')}) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM r)),
held AS (SELECT doc_id, quality FROM r JOIN g USING (k) WHERE rn <= ceil(0.2::DOUBLE * n))"""


def held_out_scores(t):
    from phrasebench.operators.split import group_split
    rows = group_split(detection_rows(t).withColumn("k", F.md5("text")), "k")
    return rows, D.detect(detector(rows), rows.where(F.col("split") == "test"), ["doc_id", "quality"])


@query("detector_scores", f"WITH {GROUPS} SELECT doc_id, quality, TRUE AS in_range, TRUE AS agrees FROM held")
def _(t):
    """Classifier fitted on the training groups, scores of the held-out ones. Scores are fitted, so the check
    is on the rows, the range of the scores, and that class and confidence follow from the score."""
    _, scored = held_out_scores(t)
    likely = F.when(F.col("score") > 0.5, F.lit(1)).otherwise(F.lit(0))
    sure = F.abs(F.col("confidence") - F.greatest(F.col("score"), 1 - F.col("score"))) < 1e-9
    return scored.select("doc_id", "quality", F.col("score").between(0, 1).alias("in_range"),
                         ((F.col("class_id") == likely) & sure).alias("agrees"))


@query("z03_baseline", f"""WITH {GROUPS} SELECT quality AS gold, count(*) AS support, TRUE AS cells_add_up FROM held GROUP BY 1""")
def _(t):
    """Detection baseline of the held-out groups; the confusion table's rows add up to the report's support."""
    from phrasebench.operators.split import group_split
    from phrasebench.plans.corpus import detection_baseline
    rows = group_split(detection_rows(t).withColumn("k", F.md5("text")), "k")
    made = detection_baseline(rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test").drop("k", "split"), "text", "quality")
    cells = made["confusion"].groupBy("gold").agg(F.sum("n").alias("cells"))
    truth = cut_lineage(made["scored"].select("quality")).groupBy(F.col("quality").alias("gold")).agg(F.count("*").alias("support"))
    return truth.join(cells, "gold").select("gold", "support", (F.col("cells") == F.col("support")).alias("cells_add_up"))


def judged_pairs(t):
    """The first ten documents of every passage; 1 for those that hold it."""
    pairs = pair_rows(t)
    docs = spread(t.documents.select("doc_id", "text")).select("doc_id", normal_tokens("text").alias("q"))
    items = t.benchmark.select("item_id", normal_tokens("text").alias("p"))
    held = token_run_matches(docs, "doc_id", "q", items, "item_id", "p").select(
        F.col("phrase_id").alias("query_id"), F.col("query_id").alias("bank_id"), F.lit(1.0).alias("label")).distinct()
    return pairs.join(held, ["query_id", "bank_id"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


JUDGED = f"""{PAIRS}, jd AS (SELECT query_id, bank_id, rank, CASE WHEN contains(' ' || array_to_string({norm_of('d.text')}, ' ') || ' ',
 ' ' || array_to_string({norm_of('b.text')}, ' ') || ' ') AND len({norm_of('b.text')}) > 0 THEN 1.0::DOUBLE ELSE 0 END AS label
 FROM prs JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = bank_id)"""


@query("z09_judged_pairs", f"{JUDGED} SELECT query_id, bank_id, rank, label FROM jd")
def _(t):
    """What the pair scorer learns from; a passage's candidates, judged by whether they hold it."""
    return judged_pairs(t).select("query_id", "bank_id", "rank", "label")


@query("z09_mined_pairs", f"""WITH {VECTORS}, tr AS (SELECT *, ('0x' || left({md5_of('vec_id')}, 8))::BIGINT % 2 AS fold FROM vs WHERE split = 'train'),
tp AS (SELECT q.vec_id AS query_id, b.vec_id AS bank_id, q.label AS gold, b.label AS entity,
 round(list_dot_product(q.v, b.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM tr q JOIN tr b ON q.fold <> b.fold),
tt AS (SELECT * FROM tp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_id) <= 100),
tb AS (SELECT * FROM tt QUALIFY row_number() OVER (PARTITION BY query_id, entity ORDER BY score DESC, bank_id) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_id) AS rank FROM tb QUALIFY rank <= 10),
ng AS (SELECT query_id, entity FROM rk WHERE entity <> gold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3),
pr AS (SELECT vec_id AS query_id, label AS candidate, 1.0::DOUBLE AS label FROM tr UNION ALL SELECT query_id, entity, 0 FROM ng),
sp AS (SELECT vec_id AS query_id, CASE WHEN row_number() OVER (ORDER BY {md5_of('vec_id')}) <= ceil(0.1::DOUBLE * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split FROM tr)
SELECT query_id, candidate, label, split FROM pr JOIN sp USING (query_id)""")
def _(t):
    """Pairs mined on the train side, no query against its own fold; queries dealt 90/10."""
    _, train = vector_sets(t)
    return Z.mined_pairs(train, "vec_id", "embedding", "label")


@query("rerank_model", f"{JUDGED} SELECT query_id, bank_id, rank, TRUE AS in_range FROM jd")
def _(t):
    """Pairwise ranker; a query's candidates are scored by a model of the other folds. Scores are fitted, so
    the check is on the rows and on the range of the scores."""
    scored = K.cross_scored(judged_pairs(t))
    return scored.select("query_id", "bank_id", "rank", ((F.col("rerank_score") >= 0) & (F.col("rerank_score") <= 1)).alias("in_range"))


@query("m13_validation", f"{JUDGED} SELECT count(*) AS n, TRUE AS better_than_chance FROM jd")
def _(t):
    """Metrics of the ranker on queries it did not learn from; the area under ROC is above that of a coin. Null
    where all pairs are right or all are wrong: there is no curve then, and nothing is claimed."""
    return validated(cut_lineage(K.cross_scored(judged_pairs(t)).select("rerank_score", "label")))


def validated(scored):
    """(n, better_than_chance) of scored pairs (rerank_score, label)."""
    from phrasebench.operators.metrics import auc
    both = scored.agg((F.min("label") < F.max("label")).alias("both")).scalar()
    above = auc(scored, "rerank_score", "label").select("auc").scalar() > 0.5
    return scored.agg(F.count("*").alias("n")).withColumn("better_than_chance", F.when(both, above))


def answers(t):
    ranked = Z.lexical_retrieval(t.benchmark, "item_id", "text", bench_index(t), 10)
    ranked = ranked.select("query_id", F.col("doc_id").alias("bank_id"), "rank")
    bank = t.examples.select("doc_id", F.col("source").alias("entity"), "lang",
                             F.col("quality").cast("string").alias("meaning_a"), F.col("toxic").cast("string").alias("meaning_b"))
    return Z.meaning_answers(ranked, bank, "doc_id", ["entity", "lang", "meaning_a", "meaning_b"])


@query("meaning_lookup", f"""WITH {lexical_sql(*BENCH_ON_DOCS)}, rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10)
SELECT query_id, doc_id AS bank_id, rank, '{{"entity":"' || source || '","lang":"' || lang || '"' || coalesce(',"meaning_a":"' || quality || '"', '')
 || coalesce(',"meaning_b":"' || toxic || '"', '') || '}}' AS answer FROM rk JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)""")
def _(t):
    """Answers as JSON; a missing meaning is left out."""
    return answers(t).select("query_id", "bank_id", "rank", "answer")


TWO_LAYER = f"""{DEMO}, t20 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS rank,
 round(0.65::DOUBLE * dense + (1 - 0.65::DOUBLE) * coalesce(lexical / nullif(max(lexical) OVER (PARTITION BY query_id), 0), 0), 6) AS fused FROM d),
prs AS (SELECT t20.query_id, t20.doc_id AS bank_id, rank, b.text AS query, dd.source || ' | ' || dd.text AS candidate
 FROM t20 JOIN benchmark b ON b.item_id = t20.query_id JOIN documents dd ON dd.doc_id = t20.doc_id){OVERLAP_STEPS},
e AS (SELECT rr.query_id, rr.bank_id, rerank_score, source AS entity, fused FROM rr JOIN documents ON doc_id = bank_id
 JOIN t20 ON t20.query_id = rr.query_id AND t20.doc_id = rr.bank_id
 QUALIFY row_number() OVER (PARTITION BY rr.query_id, source ORDER BY rerank_score DESC, bank_id) = 1)
SELECT query_id, bank_id, entity, fused, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, bank_id) AS rank
FROM e QUALIFY rank <= 3"""


def two_layer_rows(queries, index, docs):
    """The retrieval half of the two-layer job; the feed runs it too."""
    out = Z.two_layer_answers(queries, "item_id", "text", index, docs, "doc_id", "text", "source", rounded_overlap)
    return out.select("query_id", "bank_id", "entity", "fused", "rerank_score", "rank")


@query("two_layer_retrieval", TWO_LAYER)
def _(t):
    """Dense top 20, fused with BM25, scored as pairs, best row per entity, first three."""
    return two_layer_rows(t.benchmark, bench_index(t), t.documents)


def two_layer_job(t):
    """What answers a batch of queries (item_id, text): verdict and flags beside the retrieved rows."""
    model, index = D.fit_text_classifier(detection_rows(t), "text", "quality"), bench_index(t)

    def answer(batch):
        batch = cut_lineage(batch)
        verdict = D.detect(model, batch.select(F.col("item_id").alias("query_id"), "text"), ["query_id"])
        queries = batch.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
        return Z.two_layer(queries, verdict, two_layer_rows(batch, index, t.documents))
    return answer


@query("two_layer", f"""WITH a AS ({TWO_LAYER}) SELECT a.*, b.text AS query, TRUE AS verdict_known FROM a JOIN benchmark b ON b.item_id = a.query_id""")
def _(t):
    """Detector verdict and flags beside the retrieved answers of every passage."""
    out = two_layer_job(t)(t.benchmark)
    known = F.col("label_name").isNotNull() & F.col("confidence").between(0.5 - 1e-9, 1)
    return out.select("query_id", "query", "bank_id", "entity", "fused", "rerank_score", "rank", known.alias("verdict_known"))


@query("m11_m12_batched_models", """SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^a-zA-Z]', '', 'g'))::BIGINT AS letters, length(coalesce(text, ''))::BIGINT AS chars,
 coalesce(round(length(source) / greatest(length(text), 1)::DOUBLE, 6), 0) AS share FROM documents""")
def _(t):
    """Texts and pairs through models that are fed by length, results back at their rows."""
    def letters():  # stands in for an encoder: letters and characters of each text
        return lambda texts: [[float(sum(c.isascii() and c.isalpha() for c in t)), float(len(t))] for t in texts]

    def share():  # stands in for a pair model: length of the candidate over that of the query
        return lambda pairs: [round(len(c) / max(1, len(q)), 6) if q is not None else 0.0 for q, c in pairs]

    docs = model_embedder(letters, "text")(t.documents.select("doc_id", "text", "source"))
    pairs = docs.select("doc_id", "vec", F.col("text").alias("query"), F.col("source").alias("candidate"))
    out = model_pair_scorer(share)(pairs)
    return out.select("doc_id", F.col("vec")[0].cast("long").alias("letters"), F.col("vec")[1].cast("long").alias("chars"), F.col("rerank_score").alias("share"))
