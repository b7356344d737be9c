"""Ranking and classification metrics, calibration, error analysis, model comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasebench.functions.numeric import r6, round_half_even
from phrasebench.functions.text import error_type, failure_type
from phrasebench.operators import diagnose as G
from phrasebench.operators import metrics as M
from phrasebench.operators import rank as R
from phrasebench.operators.dense import gold_places
from phrasebench.plans import reports as Rep
from phrasebench.queries.registry import (
    SCORED, SCORED_ORDERS, VECTORS, half_even, md5_of, query, ranked_vectors, tokens_of)
from phrasebench.queries.retrieval import ranked_vector_rows, vector_sets
from phrasebench.session import cut_lineage

RANKED = f"WITH {ranked_vectors()}"
TEN = f"WITH {ranked_vectors(10, 100)}"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def gold_ranks(t, k: int = 5, fetch: int = 25) -> DataFrame:
    queries = vector_sets(t)[0].select(F.col("vec_id").alias("query_id"))
    return R.gold_rank(ranked_vector_rows(t, k, fetch), queries=queries)


METRICS = """count(*) AS n_queries, round(avg(coalesce((gold_rank <= 1)::INT, 0)), 6) AS top1, round(avg(coalesce((gold_rank <= 3)::INT, 0)), 6) AS top3,
 round(avg(coalesce((gold_rank <= 5)::INT, 0)), 6) AS top5"""


@query("dense_metrics", f"{RANKED} SELECT {METRICS}, round(avg(coalesce(1.0::DOUBLE / gold_rank, 0)), 6) AS mrr FROM granks")
def _(t):
    """Top-1/3/5 accuracy and MRR of held-out vectors."""
    return rounded(M.ranking_metrics(gold_ranks(t)), "top1", "top3", "top5", "mrr")


@query("w11_gold_rank", f"{TEN} SELECT query_id, gold_rank FROM granks")
def _(t):
    """Null when the gold entity is not in the list."""
    return gold_ranks(t, 10, 100)


@query("a29_mrr_cuts", f"""{TEN} SELECT round(avg(coalesce(1.0::DOUBLE / gold_rank, 0)), 6) AS mrr_full,
 round(avg(CASE WHEN gold_rank <= 5 THEN 1.0::DOUBLE / gold_rank ELSE 0 END), 6) AS mrr_5, round(avg(CASE WHEN gold_rank <= 3 THEN 1.0::DOUBLE / gold_rank ELSE 0 END), 6) AS mrr_3 FROM granks""")
def _(t):
    """MRR of the list of 10 entities (mrr_full, as the check SQL names it) and cut; ``a29_mrr_whole`` ranks all rows."""
    return gold_ranks(t, 10, 100).agg(*[r6(M.mrr("gold_rank", k)).alias(n) for n, k in (("mrr_full", None), ("mrr_5", 5), ("mrr_3", 3))])


@query("a29_mrr_whole", f"""WITH {VECTORS},
best AS (SELECT query_id, score AS s, bank_id AS i FROM vpairs WHERE entity = gold
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_id) = 1),
places AS (SELECT query_id, count(*) FILTER (score > s OR (score = s AND bank_id <= i)) AS gold_rank
  FROM vpairs LEFT JOIN best USING (query_id) GROUP BY query_id)
SELECT round(avg(coalesce(1.0::DOUBLE / nullif(gold_rank, 0), 0)), 6) AS mrr_whole, count(*) AS n_queries FROM places""")
def _(t):
    """MRR over the full ranking of all bank rows."""
    q, b = vector_sets(t)
    places = gold_places(q, "vec_id", "embedding", "label", b, "vec_id", "embedding", "label")
    return places.agg(r6(M.mrr("gold_rank")).alias("mrr_whole"), F.count("*").alias("n_queries"))


@query("recall_curve", f"{TEN} SELECT k::INT AS k, round(count_if(gold_rank <= k) / count(*), 6) AS recall FROM granks, range(1, 11) t(k) GROUP BY k")
def _(t):
    """A30"""
    return rounded(M.recall_curve(gold_ranks(t, 10, 100), 10), "recall")


@query("a31_candidate_recall", f"{TEN} SELECT round(count_if(gold_rank <= 10) / count(*), 6) AS recall_at_10 FROM granks")
def _(t):
    """Ceiling of any reranker of this pool."""
    return gold_ranks(t, 10, 100).agg(r6(M.hit_at("gold_rank", 10)).alias("recall_at_10"))


@query("a32_metrics_by_type", f"""{RANKED} SELECT CASE WHEN e.label < 5 THEN 'canonical' ELSE 'example' END AS input_type, {METRICS},
 round(avg(coalesce(1.0::DOUBLE / gold_rank, 0)), 6) AS mrr FROM granks g JOIN embeddings e ON e.vec_id = g.query_id GROUP BY 1""")
def _(t):
    """A32"""
    kinds = t.embeddings.select(F.col("vec_id").alias("query_id"), F.when(F.col("label") < 5, "canonical").otherwise("example").alias("input_type"))
    out = M.ranking_metrics(gold_ranks(t).join(kinds, "query_id"), by=["input_type"])
    return rounded(out, "top1", "top3", "top5", "mrr")


@query("j09_gold_in_k", f"{RANKED} SELECT query_id, max((rank <= 1 AND entity = gold)::INT) AS in1, max((rank <= 3 AND entity = gold)::INT) AS in3, max((rank <= 5 AND entity = gold)::INT) AS in5 FROM ranked GROUP BY 1")
def _(t):
    """J09"""
    hit = F.col("entity") == F.col("gold")
    return ranked_vector_rows(t).groupBy("query_id").agg(*[
        F.max(((F.col("rank") <= k) & hit).cast("int")).alias(f"in{k}") for k in (1, 3, 5)])


@query("outcome_breakdown", f"""{RANKED}, o AS (SELECT CASE WHEN gold_rank = 1 THEN 'correct' WHEN gold_rank <= 5 THEN 'retrieved_misranked' ELSE 'not_retrieved' END AS outcome FROM granks)
SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM o) * 100, 6) AS pct FROM o GROUP BY 1""")
def _(t):
    """A33, A34"""
    rows = gold_ranks(t).withColumn("outcome", G.outcome("gold_rank"))
    return rounded(G.shares(rows, ["outcome"]), "pct")


@query("a34_correct_shares", f"WITH {SCORED} SELECT correct, count(*) AS n, round(count(*) / (SELECT count(*) FROM scored) * 100, 6) AS pct FROM scored GROUP BY 1")
def _(t):
    """A34"""
    return rounded(G.shares(t.scored, ["correct"]), "pct")


WIDE = f"""{RANKED}, wide AS (SELECT query_id, max(gold) AS gold, max(entity) FILTER (rank = 1) AS pred_1, max(entity) FILTER (rank = 2) AS pred_2, max(entity) FILTER (rank = 3) AS pred_3 FROM ranked GROUP BY 1)"""


def wide_rows(t) -> DataFrame:
    ranked = ranked_vector_rows(t)
    gold = ranked.where(F.col("rank") == 1).select("query_id", "gold")
    return R.wide_predictions(ranked, 3).join(gold, "query_id")


@query("a43_wide_predictions", f"{WIDE} SELECT * FROM wide")
def _(t):
    """A43"""
    return wide_rows(t)


@query("a35_error_types", f"""{WIDE} SELECT CASE WHEN gold = pred_1 THEN 'Correct' WHEN gold IN (pred_2, pred_3) THEN 'Near-miss (Top-3)' ELSE 'Hard error' END AS error_type, count(*) AS n FROM wide GROUP BY 1""")
def _(t):
    """M01, A35, X27"""
    kind = error_type("gold", [F.col(f"pred_{i}") for i in (1, 2, 3)])
    return wide_rows(t).groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"))


TURNS = f"""tn AS (SELECT conv_id || '-' || turn AS id, text AS pred, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations),
ft AS (SELECT id, CASE WHEN len(list_intersect(list_distinct({tokens_of('gold')}), list_distinct({tokens_of('pred')}))) > 0 THEN 'Lexical Confusion'
 WHEN len(list_distinct({tokens_of('gold')})) <= 3 AND len(list_distinct({tokens_of('pred')})) <= 3 THEN 'Short/Ambiguous Idioms' ELSE 'Semantic Confusion' END AS failure_type
 FROM tn WHERE gold IS NOT NULL AND gold <> pred)"""


def turn_rows(t) -> DataFrame:
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.join(nxt, ["conv_id", "turn"]).select(ident.alias("id"), F.col("text").alias("pred"), "gold")


@query("failure_types", f"WITH {TURNS} SELECT failure_type, count(*) AS n FROM ft GROUP BY 1")
def _(t):
    """A36, X26"""
    wrong = turn_rows(t).where(F.col("gold") != F.col("pred"))
    return wrong.groupBy(failure_type("gold", "pred").alias("failure_type")).agg(F.count("*").alias("n"))


@query("z20_failure_analysis", f"""WITH {TURNS}, s AS (SELECT id FROM tn WHERE gold IS NOT NULL ORDER BY {md5_of('id')} LIMIT 1000)
SELECT id, failure_type FROM ft WHERE id IN (SELECT id FROM s)""")
def _(t):
    """Failures among 1,000 sampled predictions, with their type."""
    return Rep.failures(turn_rows(t), "id", "gold", "pred")["failures"].select("id", "failure_type")


@query("a39_recovered", f"{RANKED} SELECT round(avg(coalesce((gold_rank <= 3)::INT, 0)) - avg(coalesce((gold_rank <= 1)::INT, 0)), 6) AS recovered FROM granks")
def _(t):
    """Share recovered between rank 1 and rank 3."""
    return M.ranking_metrics(gold_ranks(t)).select(r6(F.col("top3") - F.col("top1")).alias("recovered"))


@query("a45_candidate_counts", f"{RANKED} SELECT count(*) AS queries, bool_and(n = 5) AS all_full FROM (SELECT query_id, count(*) AS n FROM ranked GROUP BY 1)")
def _(t):
    """A45"""
    return R.candidate_counts(ranked_vector_rows(t), 5)


@query("a42_prediction_lists", f"{RANKED} SELECT query_id, array_to_string(list(entity ORDER BY rank), ',') AS preds FROM ranked GROUP BY 1")
def _(t):
    """A42"""
    lists = R.prediction_lists(ranked_vector_rows(t), 5)
    return lists.select("query_id", F.array_join(F.col("preds").cast("array<string>"), ",").alias("preds"))


# ---- classification ------------------------------------------------------------------------------

@query("confusion", f"""WITH {SCORED}, z AS (SELECT g, p FROM (VALUES (0), (1)) a(g), (VALUES (0), (1)) b(p))
SELECT z.g AS gold, z.p AS pred, count(s.doc_id) AS n FROM z LEFT JOIN scored s ON s.gold = z.g AND s.pred = z.p GROUP BY ALL""")
def _(t):
    """A23"""
    return M.confusion(t.scored, "gold", "pred", [0, 1])


@query("a24_accuracy", f"WITH {SCORED} SELECT round(avg((pred = gold)::INT), 6) AS accuracy FROM scored")
def _(t):
    """A24"""
    return t.scored.agg(r6(M.accuracy("pred", "gold")).alias("accuracy"))


@query("class_report", f"""WITH {SCORED}, per AS (SELECT c::VARCHAR AS label, count_if(gold = c AND pred = c) AS tp, count_if(pred = c) AS pp, count_if(gold = c) AS support
 FROM scored, (VALUES (0), (1)) v(c) GROUP BY c),
m AS (SELECT label, support, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM per),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM m)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM f""")
def _(t):
    """A25"""
    return rounded(M.class_report(M.confusion(t.scored, "gold", "pred", [0, 1])), "precision", "recall", "f1")


ROC = """rc AS (SELECT score AS threshold, count_if(gold = 1) AS p, count_if(gold <> 1) AS n FROM {t} GROUP BY 1),
rr AS (SELECT threshold, p, n, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS fp, sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM rc)"""


@query("roc_points", f"""WITH {SCORED}, {ROC.format(t='scored')} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / tot_p, 6) AS tpr, round(fp / tot_n, 6) AS fpr FROM rr
UNION ALL SELECT NULL, 0, 0, 0, 0""")
def _(t):
    """Running true and false positives per distinct score."""
    out = M.roc(t.scored, "score", "gold")
    return rounded(out, "tpr", "fpr").withColumn("threshold", F.when(F.col("threshold") < float("inf"), F.col("threshold")))


@query("a26_roc_orders", f"""WITH {SCORED_ORDERS}, {ROC.format(t='scored_orders')} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp FROM rr UNION ALL SELECT NULL, 0, 0""")
def _(t):
    """A26, W10 on orders: thousands of distinct scores."""
    out = M.roc(t.scored_orders, "score", "gold")
    return out.select(F.when(F.col("threshold") < float("inf"), F.col("threshold")).alias("threshold"), "tp", "fp")


@query("auc", f"WITH {SCORED}, {ROC.format(t='scored')} SELECT round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 6) AS auc FROM rr")
def _(t):
    """A27"""
    return rounded(M.auc(t.scored, "score", "gold"), "auc")


@query("a19_outcome_stats", f"""WITH {SCORED} SELECT round(avg(score) FILTER (correct = 1), 6) AS mean_correct, round(avg(score) FILTER (correct = 0), 6) AS mean_wrong,
 round(stddev_samp(score) FILTER (correct = 1), 6) AS std_correct, round(stddev_samp(score) FILTER (correct = 0), 6) AS std_wrong,
 round(avg(score) FILTER (correct = 1) - avg(score) FILTER (correct = 0), 6) AS gap FROM scored""")
def _(t):
    """A19"""
    return rounded(G.outcome_stats(t.scored, "score", "correct"), "mean_correct", "mean_wrong", "std_correct", "std_wrong", "gap")


@query("calibration", f"""WITH {SCORED_ORDERS}, r AS (SELECT min(score) AS lo, max(score) AS hi FROM scored_orders),
b AS (SELECT greatest(1, ceil((score - lo) * 10 / (hi - lo)))::INT AS bin, score, correct FROM scored_orders, r)
SELECT bin, round(avg(score), 6) AS mean_score, round(avg(correct), 6) AS accuracy, count(*) AS n FROM b GROUP BY bin HAVING count(*) >= 100""")
def _(t):
    """Ten right-closed bins, at least 100 rows each."""
    return rounded(G.calibration(t.scored_orders, "score", "correct"), "mean_score", "accuracy")


@query("threshold_coverage", f"""WITH {SCORED_ORDERS}, g AS (SELECT round_even((0.5::DOUBLE + 0.05::DOUBLE * i) * 1e2, 0) / 1e2 AS threshold FROM range(10) t(i))
SELECT threshold, count(*) AS n, round(avg(correct), 6) AS accuracy, round(count(*) / (SELECT count(*) FROM scored_orders), 6) AS coverage
FROM scored_orders, g WHERE score >= threshold GROUP BY 1""")
def _(t):
    """A21, A22, X29, P16"""
    return rounded(G.threshold_sweep(t.scored_orders, "score", "correct"), "accuracy", "coverage")


@query("m14_pair_metrics", f"""WITH {SCORED}, c AS (SELECT gold, score, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM scored)
SELECT count(*) AS n, round(avg(((score >= 0.5) = (gold = 1))::INT), 6) AS accuracy, round(count_if(gold = 1 AND score >= 0.5) / count_if(score >= 0.5), 6) AS precision,
 round(count_if(gold = 1 AND score >= 0.5) / count_if(gold = 1), 6) AS recall,
 round(2 * count_if(gold = 1 AND score >= 0.5) / (count_if(score >= 0.5) + count_if(gold = 1)), 6) AS f1,
 round(avg(-CASE WHEN gold = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS loss FROM c""")
def _(t):
    """M14"""
    return rounded(M.pair_scorer_metrics(t.scored, "score", "gold"), "accuracy", "precision", "recall", "f1", "loss")


@query("k03_confident_mistakes", f"WITH {SCORED} SELECT doc_id, score, gold FROM scored WHERE correct = 0 ORDER BY score DESC, doc_id LIMIT 20")
def _(t):
    """K03"""
    return G.hardest(t.scored, F.col("correct") == 0, "score", "doc_id", 20).select("doc_id", "score", "gold")


@query("hard_examples", f"""WITH {SCORED} SELECT * FROM (SELECT 'best' AS kind, doc_id, score FROM scored WHERE correct = 1 ORDER BY score DESC, doc_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'worst', doc_id, score FROM scored WHERE correct = 0 ORDER BY score DESC, doc_id LIMIT 10)""")
def _(t):
    """Most confident right and wrong rows."""
    best = G.hardest(t.scored, F.col("correct") == 1, "score", "doc_id", 10).select(F.lit("best").alias("kind"), "doc_id", "score")
    worst = G.hardest(t.scored, F.col("correct") == 0, "score", "doc_id", 10).select(F.lit("worst").alias("kind"), "doc_id", "score")
    return best.unionByName(worst)


# ---- comparison ----------------------------------------------------------------------------------

FETCHES = (5, 10, 25)


def model_metrics(t) -> dict[str, DataFrame]:
    return {f"fetch_{f}": M.ranking_metrics(gold_ranks(t, 5, f)) for f in FETCHES}


def _model_sql() -> str:
    parts = []
    for f in FETCHES:
        inner = ranked_vectors(5, f)
        parts.append(f"SELECT 'fetch_{f}' AS model, * FROM (WITH {inner} SELECT count(*) AS n_queries, avg(coalesce((gold_rank <= 1)::INT, 0)) AS top1, "
                     "avg(coalesce((gold_rank <= 5)::INT, 0)) AS top5, avg(coalesce(1.0::DOUBLE / gold_rank, 0)) AS mrr FROM granks)")
    return "mm AS (" + " UNION ALL ".join(parts) + ")"


@query("model_gains", f"""WITH {_model_sql()} SELECT model, n_queries, round(top1, 6) AS top1, round(top5, 6) AS top5, round(mrr, 6) AS mrr,
 round(top5 - (SELECT top5 FROM mm WHERE model = 'fetch_5'), 6) AS top5_gain, round(mrr - (SELECT mrr FROM mm WHERE model = 'fetch_5'), 6) AS mrr_gain FROM mm""")
def _(t):
    """Runs with different over-fetch beside each other, gains over the first."""
    out = Rep.model_comparison(model_metrics(t), "fetch_5", ["top5", "mrr"])
    return rounded(out, "top1", "top5", "mrr", "top5_gain", "mrr_gain").select("model", "n_queries", "top1", "top5", "mrr", "top5_gain", "mrr_gain")


@query("a44_long_wide", f"""WITH {_model_sql()} SELECT 'top1' AS metric, round(max(top1) FILTER (model = 'fetch_5'), 6) AS fetch_5, round(max(top1) FILTER (model = 'fetch_25'), 6) AS fetch_25 FROM mm
UNION ALL SELECT 'mrr', round(max(mrr) FILTER (model = 'fetch_5'), 6), round(max(mrr) FILTER (model = 'fetch_25'), 6) FROM mm""")
def _(t):
    """Metrics unpivoted to long form, then one column per model."""
    runs = model_metrics(t)
    rows = reduce(DataFrame.unionByName, [runs[m].withColumn("model", F.lit(m)) for m in ("fetch_5", "fetch_25")])
    long = M.to_long(rows, ["top1", "mrr"]).withColumn("value", r6("value"))
    return long.groupBy("metric").pivot("model", ["fetch_5", "fetch_25"]).agg(F.max("value"))


@query("z19_recall_curves", " UNION ALL ".join(
    f"SELECT 'fetch_{f}' AS model, * FROM (WITH {ranked_vectors(10, f)} SELECT k::INT AS k, round(count_if(gold_rank <= k) / count(*), 6) AS recall FROM granks, range(1, 11) t(k) GROUP BY k)" for f in FETCHES))
def _(t):
    """Recall curves of several runs in one aggregate."""
    return rounded(Rep.recall_curves({f"fetch_{f}": gold_ranks(t, 10, f) for f in FETCHES}), "recall")


@query("z12_reliability", f"""{RANKED}, p AS (SELECT query_id, max(score) FILTER (rank = 1) AS score, min(rank) FILTER (entity = gold) AS gold_rank FROM ranked GROUP BY 1)
SELECT 'outcomes' AS report, CASE WHEN gold_rank = 1 THEN 'correct' WHEN gold_rank <= 5 THEN 'retrieved_misranked' ELSE 'not_retrieved' END AS item, count(*)::DOUBLE AS value FROM p GROUP BY 2
UNION ALL SELECT 'gap', 'gap', round(avg(score) FILTER (gold_rank = 1) - avg(score) FILTER (gold_rank IS NULL OR gold_rank <> 1), 6) FROM p
UNION ALL SELECT 'recall', k::VARCHAR, round(count_if(gold_rank <= k) / count(*), 6) FROM p, range(1, 6) t(k) GROUP BY k
UNION ALL SELECT * FROM (SELECT 'worst', query_id::VARCHAR, score FROM p WHERE gold_rank IS NULL OR gold_rank <> 1 ORDER BY score DESC, query_id LIMIT 10)""")
def _(t):
    """Reliability report of the dense run, its tables in one long table."""
    ranked = cut_lineage(ranked_vector_rows(t))  # searched once; every table of the report reads what is stored
    heads = ranked.where(F.col("rank") == 1).select("query_id", "score")
    preds = heads.join(R.gold_rank(ranked), "query_id")
    preds = cut_lineage(preds.withColumn("correct", F.coalesce((F.col("gold_rank") == 1).cast("int"), F.lit(0))))
    parts = Rep.reliability(preds, "score", "correct", "gold_rank", "query_id")
    return (
        parts["outcomes"].select(F.lit("outcomes").alias("report"), F.col("outcome").alias("item"), F.col("n").cast("double").alias("value"))
        .unionByName(parts["gap"].select(F.lit("gap").alias("report"), F.lit("gap").alias("item"), r6("gap").alias("value")))
        .unionByName(parts["recall"].select(F.lit("recall").alias("report"), F.col("k").cast("string").alias("item"), r6("recall").alias("value")))
        .unionByName(parts["worst"].select(F.lit("worst").alias("report"), F.col("query_id").cast("string").alias("item"), F.col("score").alias("value")))
    )


@query("z23_inspection", f"""{RANKED}, s AS (SELECT query_id FROM (SELECT DISTINCT query_id FROM ranked) ORDER BY {md5_of('query_id')} LIMIT 5)
SELECT query_id, rank, entity, score, (entity = gold)::INT AS hit FROM ranked WHERE rank <= 3 AND query_id IN (SELECT query_id FROM s)""")
def _(t):
    """Top predictions of five sampled queries with hit marker."""
    return Rep.inspection(ranked_vector_rows(t), "query_id", 5).select("query_id", "rank", "entity", "score", "hit")


@query("x22_rounding", f"SELECT l_returnflag, {half_even('avg(l_tax)', 2)} AS r2, {half_even('avg(l_tax)', 3)} AS r3, {half_even('avg(l_tax)', 4)} AS r4 FROM lineitem GROUP BY 1")
def _(t):
    """X22"""
    mean = F.avg("l_tax")
    return t.lineitem.groupBy("l_returnflag").agg(*[round_half_even(mean, p).alias(f"r{p}") for p in (2, 3, 4)])


@query("z04_diagnostics", f"""WITH {SCORED}, {ROC.format(t='scored')}
SELECT 'auc' AS report, round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 6) AS value FROM rr
UNION ALL SELECT 'gap', round(avg(score) FILTER (correct = 1) - avg(score) FILTER (correct = 0), 6) FROM scored
UNION ALL SELECT 'errors', count_if(correct = 0)::DOUBLE FROM scored""")
def _(t):
    """Area under ROC, score gap and error count of a scored table."""
    from phrasebench.plans.corpus import detection_diagnostics
    rows = t.scored.drop("correct").withColumnsRenamed({"pred": "class_id"}).withColumn("confidence", F.col("score"))
    parts = detection_diagnostics(rows, "gold", "doc_id")
    return (
        parts["auc"].select(F.lit("auc").alias("report"), r6("auc").alias("value"))
        .unionByName(parts["outcome"].select(F.lit("gap").alias("report"), r6("gap").alias("value")))
        .unionByName(parts["errors"].agg(F.count("*").cast("double").alias("value")).select(F.lit("errors").alias("report"), "value"))
    )


@query("z15_heldout_set", f"""WITH b AS (SELECT conv_id, conv_id || '-' || turn AS id, text, CASE WHEN role = 'system' THEN 'canonical' ELSE 'example' END AS input_type FROM conversations),
h AS (SELECT * FROM b WHERE input_type = 'example' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY {md5_of('id')}, id) = 1)
SELECT 'eval' AS part, id FROM h UNION ALL SELECT 'index', id FROM b WHERE text NOT IN (SELECT text FROM h)""")
def _(t):
    """One held-out example per entity, and the index bank without those texts."""
    from phrasebench.plans.corpus import heldout_set
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    kind = F.when(F.col("role") == "system", "canonical").otherwise("example")
    bank = t.conversations.select("conv_id", ident.alias("id"), "text", kind.alias("input_type"))
    parts = heldout_set(bank, "conv_id", "id", "text")
    return parts["eval"].select(F.lit("eval").alias("part"), "id").unionByName(parts["index_bank"].select(F.lit("index").alias("part"), "id"))
