"""Draws, kernel sums, the pairwise ranker, train-side mining, the keyed feed, the catalogue."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from phrasebench.operators import diagnose as G
from phrasebench.operators import metrics as M
from phrasebench.operators import rerank as K
from phrasebench.operators import split as S
from phrasebench.plans import retrieval as Z
from phrasebench.queries.retrieval import validated
from phrasebench.sources import tables
from phrasebench.streaming.feed import run_feed


def test_draws_are_distinct_uniform_and_independent(spark):
    rows = spark.range(6000).select(F.concat(F.lit("q"), F.col("id")).alias("k"), F.lit(5).cast("long").alias("m"))
    got = [tuple(r["d"]) for r in rows.select(S.distinct_draws("k", "m", 2).alias("d")).collect()]
    assert all(len(set(d)) == 2 and set(d) <= set(range(5)) for d in got)
    pairs = Counter(got)
    assert len(pairs) == 20 and all(abs(n - 300) < 90 for n in pairs.values())  # every ordered pair, equally often
    for m in (0, 1, 2, 3, 7):
        draws = [r["d"] for r in rows.limit(50).select("k", F.lit(m).cast("long").alias("m")).where("m > 0").select(S.distinct_draws("k", "m", 9).alias("d")).collect()]
        assert all(sorted(d) == list(range(m)) for d in draws)


def test_binned_kernel_sums(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(50, 9, 3000), rng.exponential(400, 200), [9000.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").union(spark.createDataFrame([(None,)], "v double"))
    exact, binned = ({r["i"]: (r["x"], r["density"]) for r in G.kde(df, "v", steps=s).collect()} for s in (None, 1024))
    h = x.std(ddof=1) * len(x) ** -0.2
    assert exact.keys() == binned.keys() == set(range(100))
    for i in exact:
        want = np.exp(-0.5 * ((exact[i][0] - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi))
        assert abs(exact[i][1] - want) < 1e-12 and abs(binned[i][1] - want) <= 0.05 / (h * 1024 ** 2) + 1e-15 and binned[i][0] == exact[i][0]
    assert G.kde(df.limit(0), "v").count() == 0 and G.kde(df.where("v = 9000"), "v").count() == 0


def judged(spark, n=60):
    """A query's good candidate shares its words, the others some of them."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for q in range(n):
        query = rng.sample(words, 8)
        for i in range(6):
            own = query[:6] if i == 0 else rng.sample(query, rng.randrange(0, 4))
            rows.append((q, 10 * q + i, " ".join(query), " ".join(own + rng.sample(words, 4)), float(i == 0)))
    return spark.createDataFrame(rows, "query_id long, bank_id long, query string, candidate string, label double")


def test_ranker_learns_which_of_two_is_better(spark):
    rows = judged(spark)
    model = K.fit_ranker(rows)
    assert model.stages[-1].intercept == 0.0
    scored = K.cross_scored(rows)
    assert scored.count() == rows.count() and M.auc(scored, "rerank_score", "label").first()["auc"] > 0.95
    # a fold's scores do not change when its own labels do
    flipped = rows.withColumn("label", F.when(K.fold_of("query_id", 3) == 0, 1 - F.col("label")).otherwise(F.col("label")))
    same = lambda df: {r["bank_id"]: round(r["rerank_score"], 9) for r in K.cross_scored(df).where(K.fold_of("query_id", 3) == 0).collect()}
    assert same(rows) == same(flipped)


def test_ranker_without_a_wrong_candidate_prefers_none(spark):
    rows = judged(spark, 4).withColumn("label", (F.col("query_id") % 2).cast("double"))
    model = K.fit_ranker(rows)
    got = K.model_scorer(model)(rows).select("rerank_score").collect()
    assert len(got) == 24 and {r[0] for r in got} == {0.5}


def test_validation_claims_nothing_without_a_wrong_pair(spark):
    for labels, want in (((1.0, 1.0), None), ((0.0, 0.0), None), ((1.0, 0.0), True), ((0.0, 1.0), False)):
        rows = spark.createDataFrame(list(zip((0.9, 0.1), labels)), "rerank_score double, label double")
        assert [tuple(r) for r in validated(rows).collect()] == [(2, want)]


def test_words_made_once_score_as_texts_do(spark):
    rows = judged(spark, 12)
    queries = rows.select("query_id", "query").distinct()
    bank = rows.select("bank_id", F.substring_index("candidate", " ", 1).alias("e"), "candidate")
    ranked = rows.select("query_id", "bank_id", F.lit(1).alias("rank"))
    texts = K.candidate_pairs(ranked, queries, "query_id", "query", bank, "bank_id", "e", "candidate")
    words = K.candidate_words(ranked, queries, "query_id", "query", bank, "bank_id", "e", "candidate")
    assert "query" not in words.columns
    got, want = ({(r["query_id"], r["bank_id"]): r["rerank_score"] for r in K.overlap_scorer(df).collect()} for df in (words, texts))
    assert got == want and len(want) == 72


def test_mining_never_meets_the_own_fold(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 5) for i in range(120)], "id long, v array<double>, e int")
    got = Z.mined_pairs(rows, "id", "v", "e").collect()
    gold = {i: i % 5 for i in range(120)}
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert by.keys() == gold.keys()
    for q, own in by.items():
        assert [r["candidate"] for r in own if r["label"] == 1] == [gold[q]] and len({r["split"] for r in own}) == 1
        assert gold[q] not in [r["candidate"] for r in own if r["label"] == 0] and sum(r["label"] == 0 for r in own) == 3
    assert Counter(own[0]["split"] for own in by.values()) == {"train": 108, "val": 12}


def test_feed_answers_a_query_once(spark, tmp_path):
    source, ddl = str(tmp_path / "in"), "item_id long, text string"
    put = lambda rows: spark.createDataFrame(rows, ddl).repartition(1).write.mode("append").parquet(source)
    opened = []

    def job():
        opened.append(1)
        return lambda batch: batch.withColumn("answer", F.upper("text"))

    def go():
        run_feed(spark, source, ddl, str(tmp_path / "ckpt"), str(tmp_path / "out"), job(), key="item_id").awaitTermination()
        return sorted((r["item_id"], r["answer"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put([(1, "one"), (2, "two"), (2, "two"), (3, "  "), (4, "quit"), (5, "exit")])
    first = go()
    assert [i for i, _ in first][:2] == [1, 2] and 3 not in [i for i, _ in first] and len({i for i, _ in first}) == len(first)
    put([(2, "two"), (6, "six")])  # a repeated query in a later file, after a restart from the checkpoint
    second = go()
    assert second == sorted([*first, (6, "SIX")]) and len(opened) == 2
    assert go() == second  # nothing new


def test_catalogue_keeps_faults_as_rows(spark, tmp_path):
    root = str(tmp_path / "a.b(c)")
    spark.range(5).write.parquet(f"{root}/good/all")
    for split, content in (("empty", b""), ("corrupt", b"PAR1 no parquet")):
        folder = tmp_path / "a.b(c)" / "bad" / split
        folder.mkdir(parents=True)
        (folder / "part.parquet").write_bytes(content)
    rows = {(r["config"], r["split"]): r["error"] for r in tables.catalogue(spark, root).collect()}
    assert rows.keys() == {("good", "all"), ("bad", "empty"), ("bad", "corrupt")}
    assert rows["good", "all"] is None and rows["bad", "empty"] == "empty split" and rows["bad", "corrupt"].startswith("cannot be opened")
    assert tables.first_split(spark, root, "good") == "all"
