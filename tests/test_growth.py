"""Work that must not outgrow its input: tasks of bounded size, one shuffle where one will do, results as before."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasebench.operators import lexical as L
from phrasebench.session import cut_lineage


def corpus(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(800)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice((2, 9, 30))))) for i in range(150)] + [(150, ""), (151, None)]
    return docs, spark.createDataFrame(docs, "d long, text string")


def test_index_keeps_bounds_with_its_postings(spark, tmp_path):
    _, d = corpus(spark)
    index = L.lexical_index(d, "d", "text", path=str(tmp_path / "index"), range_units=40)
    assert index.facts["ranges"] > 1 and not (tmp_path / "index" / "tops").exists()
    want = index.blocks.groupBy("part", "number", "range").agg(F.count("*").alias("n"), F.max("w").alias("top_w"), F.max("c").alias("top_c"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, index.tops.collect()))


@pytest.mark.parametrize("most", [0, 5, 1 << 17])
def test_norms_with_and_without_common_terms(spark, most):
    docs, d = corpus(spark)
    index = L.lexical_index(d, "d", "text")
    assert L.common_terms(index.terms, most).count() <= most
    idf = {r["term"]: r["smooth_idf"] for r in index.terms.collect()}
    got = {r["doc_id"]: r["norm"] for r in L.document_norms(index.postings, index.terms, most).collect()}
    want = {i: math.sqrt(sum((n * idf[w]) ** 2 for w, n in Counter(text.split()).items())) for i, text in docs if text}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_texts_are_split_in_as_many_tasks_as_their_bytes_ask_for(spark, monkeypatch):
    from phrasebench.operators import detect as D
    _, d = corpus(spark)
    for module, made in ((L, lambda: L.query_terms(d, "d", "text")), (D, lambda: D.term_table(d, "d", "text"))):
        asked = []
        monkeypatch.setattr(module, "bucket_count", lambda _spark, size, asked=asked: asked.append(size) or 7)
        plan = made()._jdf.queryExecution().toString()
        assert asked[0] > 5000 and ", 7), REPARTITION_BY_NUM" in plan, plan


@pytest.mark.parametrize("units", [40, 8192])
def test_fused_search_by_ranges_is_that_of_all_pairs(spark, units):
    from phrasebench.operators.dense import fused_topk
    docs, d = corpus(spark)
    d = d.unionByName(d.where("d in (3, 9)"))  # repeated ids
    rng = np.random.default_rng(5)
    vec = F.udf(lambda i: [float(x) for x in np.random.default_rng(i).integers(-2, 3, 4)], "array<double>")
    d = d.withColumn("v", vec("d")).localCheckpoint()
    q = spark.createDataFrame([(i, f"w1 w2 {docs[i * 7][1]}") for i in range(9)] + [(20, "nothing"), (2, f"w1 w2 {docs[14][1]}")], "q long, text string")
    q = q.withColumn("v", vec(F.col("q") + 1000)).localCheckpoint()
    limits = [(i, -1.0, 1.0, 0.0, 5.0 + rng.random()) for i in [*range(9), 20]]
    ranges = spark.createDataFrame(limits, "query_id long, lo_dense double, hi_dense double, lo_lexical double, hi_lexical double")
    index = L.lexical_index(d, "d", "text", range_units=units, cosine=False)
    assert (index.facts["ranges"] > 1) == (units == 40)
    runs = [fused_topk(q, "q", "v", d, "d", "v", lexical, ranges, 6) for lexical in (L.bm25_scores(q, "q", "text", index), L.asked_terms(q, "q", "text", index))]
    pairs, whole = ({(r["query_id"], r["rank"]): r for r in run.collect()} for run in runs)
    assert len(pairs) == 60 and pairs.keys() == whole.keys()
    for at, row in pairs.items():
        assert all(abs(row[c] - whole[at][c]) < 2e-6 for c in ("dense", "lexical", "score")), at


def test_first_of_rows_is_a_stable_sort():
    from phrasebench.operators.dense import _first_of_rows
    scores = np.round(np.random.default_rng(1).normal(size=(40, 200)), 1)
    scores[3], scores[4, ::2], scores[5, 1] = 0.0, np.nan, -0.0
    scores[6] = np.nan
    for keep in (1, 7, 200):
        rows, cols = _first_of_rows(scores, keep)
        assert rows.tolist() == np.repeat(np.arange(40), keep).tolist()
        assert cols.reshape(40, keep).tolist() == np.argsort(-scores, axis=1, kind="stable")[:, :keep].tolist()


def test_blocks_bound_what_a_block_pair_hands_on(spark):
    from phrasebench.operators import dense as De
    q = spark.range(300_000)
    n_q, n_b = De._block_counts(q, spark.range(100_000), De.BLOCK_ROWS, k=100)
    assert 300_000 / n_q * 100 <= De.OUT_ROWS and 100_000 / n_b <= De.BLOCK_ROWS


def test_reliability_report_reads_a_stored_search(spark):
    from phrasebench.queries import QUERIES
    plan = QUERIES["z12_reliability"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" not in plan


def test_classifier_passes_over_stored_counts(spark, monkeypatch):
    from phrasebench.operators import detect as D
    _, d = corpus(spark)
    rows = d.where("text is not null").withColumn("label", (F.col("d") % 2).cast("int"))
    stored, cut = [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    model = D.fit_text_classifier(rows)
    assert ["label", "_tf"] in stored
    # the terms of the model are words of two or more characters and pairs of neighbours
    odd = spark.createDataFrame([(1, "Ab a ÉCOLE x_1, ab"), (2, ""), (3, "word")], "d long, text string")
    terms = {r["d"]: r["_terms"] for r in model.transform(odd).select("d", "_terms").collect()}
    assert terms == {1: ["ab", "école", "x_1", "ab", "ab école", "école x_1", "x_1 ab"], 2: [], 3: ["word"]}


def test_words_are_made_of_named_candidates_only(spark, monkeypatch):
    from phrasebench.operators import rerank as K
    bank = spark.createDataFrame([(i, f"e{i}", f"meaning {i}") for i in range(100)] + [(7, "e7", "other")], "b long, entity string, m string")
    q = spark.createDataFrame([(1, "one"), (2, "two")], "q long, t string")
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 1), (2, None, 2), (3, 9, 1)], "query_id long, bank_id long, rank int")
    stored, cut = [], K.cut_lineage
    monkeypatch.setattr(K, "cut_lineage", lambda df: stored.append(df) or cut(df))
    rows = K.candidate_words(ranked, q, "q", "t", bank, "b", "entity", "m")
    assert [df.count() for df in stored if "c_words" in df.columns] == [4]  # 7 twice, 8 and 9
    assert sorted((r["query_id"], r["bank_id"]) for r in rows.collect()) == [(1, 7), (1, 7), (1, 8), (2, 7), (2, 7)]
    texts = K.candidate_pairs(ranked, q, "q", "t", bank, "b", "entity", "m")
    assert sorted(r["candidate"] for r in texts.where("query_id = 1").collect()) == ["e7 | meaning 7", "e7 | other", "e8 | meaning 8"]
    assert "LeftSemi" in texts._jdf.queryExecution().toString()


def test_filled_lists_shuffle_no_rows_to_fill_in(spark):
    from phrasebench.operators import rank as R
    scored = spark.createDataFrame([(1, 5, 0.5), (1, 2, 0.4), (2, 0, 0.1), (2, 9, 0.1)], "query_id long, doc_id long, s double")
    q = spark.createDataFrame([(1,), (2,), (3,), (None,)], "q long")
    bank = spark.createDataFrame([(i,) for i in (5, 0, 9, 1, 2, None)], "d long")
    out = R.fill_lists(scored, q, "q", bank, "d", 4, ["s"])
    got = sorted((r["query_id"] or -1, r["doc_id"], r["s"]) for r in out.collect())
    assert got == [(-1, i, 0.0) for i in (0, 1, 2)] + [(1, 0, 0.0), (1, 1, 0.0), (1, 2, 0.4), (1, 5, 0.5), (2, 0, 0.1), (2, 1, 0.0), (2, 2, 0.0), (2, 9, 0.1),
                   *[(3, i, 0.0) for i in (0, 1, 2)]]
    assert "LeftAnti" not in out._jdf.queryExecution().toString()


def test_pools_and_boosts_are_ranked_without_texts(spark, monkeypatch):
    from phrasebench.operators import fusion as Fu
    from phrasebench.plans import retrieval as Z
    rng = random.Random(4)
    rows = [(q, d, rng.randint(0, 9) / 10, rng.randint(0, 9) / 10) for q in range(5) for d in range(20)]
    pool = Fu.pool_union(spark.createDataFrame(rows, "query_id long, doc_id long, dense double, lexical double"), 4)
    want = []
    for q in range(5):
        own = [r for r in rows if r[0] == q]
        dense, lexical = (set(sorted(own, key=lambda r: (-r[c], r[1]))[:4]) for c in (2, 3))
        want += [(*r[:2], r[2] if r in dense else 0.0, r[3]) for r in dense | lexical]
    assert sorted(map(tuple, pool.collect())) == sorted(want) and "Join" not in pool._jdf.queryExecution().toString()

    docs = spark.createDataFrame([(1, "red fox runs"), (2, "blue fish")], "d long, text string")
    bank = spark.createDataFrame([(10, "red fox", "E"), (11, "fox runs", "E"), (12, "fish", None), (13, "fox", None)], "b long, text string, e string")
    asked = []
    monkeypatch.setattr(Z, "bucket_count", lambda _spark, size: asked.append(size) or 7)
    out = Z.hybrid_pooled(docs, "d", "text", bank, "b", "text", "e", "text", k=4)
    assert len(asked) == 1 and asked[0] >= Z.PAIR_BYTES * 8
    got = {(r["query_id"], r["doc_id"]): (r["entity"], r["phrase_boost"] > 0) for r in out.collect()}
    assert {x: y for x, y in got.items() if x[0] == 1} in ({(1, 10): ("E", True), (1, 13): (None, True)}, {(1, 11): ("E", True), (1, 13): (None, True)})
    assert got[(2, 12)] == (None, True) and len(got) == 4


def test_a_cut_leaves_no_shuffle_files(spark):
    def held():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before = held()
    rows = cut_lineage(spark.range(5000).repartition(7, "id"))
    for _ in range(50):  # they are removed in the background
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and rows.count() == 5000
