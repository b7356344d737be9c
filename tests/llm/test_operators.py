"""Operators of the corpus subpackage: brute force, round trips, and odd rows."""

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasebench.llm import bpe, chat, components, mincut, mixing, ordermin, perplexity, pii, toxicity, vptree, warc
from phrasebench.llm.queries import tokenizer
from phrasebench.session import cut_lineage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score string, pii string, _mix_n long, kept string"


def frame(spark, rows):
    """(doc_id, text, lang, source) rows with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, "x", "y", 2, "z") for i, t, lang, s in rows], SCHEMA)


def words(rng, n, size=3000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# ---- 1 -------------------------------------------------------------------------------------------

def plan(shares, a):
    q = {s: (n / sum(shares.values())) ** a for s, n in shares.items()}
    return {s: v / sum(q.values()) for s, v in q.items()}


def entropy(w):
    return -sum(v * math.log(v) for v in w.values() if v)


def test_exponent_meets_entropy_and_repetition(spark):
    shares = {"a": 9000, "b": 700, "c": 290, None: 10}
    docs = spark.createDataFrame([(s, n) for s, n in shares.items()], "source string, n long")
    key = lambda s: "n" if s is None else "s" + s
    for share, limit in ((0.6, None), (None, 3.0), (0.9, 2.0), (0.1, None)):
        got = {r["_mix_source"]: r for r in mixing.weights(docs, "source", F.col("n"), share, limit).collect()}
        w = {s: got[key(s)]["_mix_weight"] for s in shares}
        assert abs(sum(w.values()) - 1) < 1e-9
        if limit:
            assert max(w[s] * 10000 / n for s, n in shares.items()) <= limit + 1e-6
        if share and not limit:
            assert entropy(w) >= share * math.log(4) - 1e-9
            assert share < 0.3 or entropy(w) < share * math.log(4) + 1e-3  # the largest exponent that does


def test_draw_and_mix_agree_and_keep_to_the_budget(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(0, 30)), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(600)]
    rows += [(5, "twin row", "en", "a"), (None, "no id here", "en", "b"), (900, None, "en", "b"), (901, "", "en", "empty")]
    docs, tokens = frame(spark, rows), mixing.count_words(F.col("text"))
    sources = mixing.weights(docs, "source", tokens, 0.99, 5.0)
    targets = {r["_mix_source"]: (r["_mix_tokens"], r["_mix_target"]) for r in sources.collect()}
    mixed = mixing.mix(docs, "doc_id", "source", tokens, sources, 500).collect()
    drawn = mixing.draw(docs, "doc_id", "source", tokens, sources)
    assert drawn.columns == [c for c in docs.columns if not c.startswith("_mix")] + ["_mix_epoch"]
    assert Counter((r.doc_id, r.epoch) for r in mixed) == Counter((r.doc_id, r["_mix_epoch"]) for r in drawn.collect())
    used = Counter()
    for r in mixed:
        used["n" if r.source is None else "s" + r.source] += r.tokens
    for s, (whole, target) in targets.items():
        assert target - 60 <= used[s] <= target  # short of the budget by less than the next rows
    assert "sempty" not in used
    blocks = {r.block for r in mixed}
    assert blocks == set(range(max(blocks) + 1))


def test_mixing_cover_loses_no_row_and_takes_empty_tables(spark):
    docs = frame(spark, [(i, "a b c", "en", "x" if i % 7 else "y") for i in range(70)])
    tokens = mixing.count_words(F.col("text"))
    drawn = mixing.draw(docs, "doc_id", "source", tokens, mixing.weights(docs, "source", tokens, None, 2.0, None))
    counts = Counter(r.doc_id for r in drawn.collect())
    assert set(counts) == set(range(70)) and max(counts.values()) == 2
    none = docs.where("false")
    assert mixing.mix(none, "doc_id", "source", tokens, mixing.weights(none, "source", tokens, 0.9, 2.0), 10).count() == 0


# ---- 2 -------------------------------------------------------------------------------------------

FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"


@pytest.mark.parametrize("compression,split", [("none", "2k"), ("gzip", "128m")])
def test_warc_chains_reject_magic_in_payloads(spark, tmp_path, compression, split):
    payloads = ["<p>a</p>", None, "", "x" * 5000, "pre" + FAKE + "post", FAKE * 20, "\r\n\r\n", "WARC/1.1\r\n", "é\r\n\r\nWARC/1.",
                "\r\n" + FAKE, "q" * 300 + "\r", "\r\n\r\n\r\nWARC/1.0"] * 2
    rows = [(i, None if i % 7 == 3 else f"http://x/{i}\r\nWARC/1.1", p) for i, p in enumerate(payloads)] + [(None, "u", "nokey")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        warc.write(df, str(tmp_path / "w"), "page_id", "url", "html", 3, compression=compression)
        got = warc.read(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(rows)
    by = {r.headers.get(warc.KEY_HEADER): r for r in got}
    holder = {p: i for i, _, p in rows if i is not None and p and len(p.encode()) >= 3}
    for i, url, p in rows:
        r = by[None if i is None else str(i)]
        response = i is None or holder.get(p, i) == i
        assert r.headers["WARC-Type"] == ("response" if response else "revisit")
        assert bytes(r.payload) == ((p or "").encode() if response else b"")
        digest = base64.b32encode(hashlib.sha1((p or "").encode()).digest()).decode()
        assert r.headers["WARC-Payload-Digest"] == "sha1:" + digest
        assert ("WARC-Target-URI" in r.headers) == (url is not None)


def test_warc_pointer_jumping_is_reachability(spark):
    rng = random.Random(4)
    rows = [(f, o, rng.choice([o + 1, o + 2, o + 5, 10_000])) for f in "ab" for o in range(200)]
    want = set()
    nxt = {(f, o): n for f, o, n in rows}
    for f in "ab":
        o = 0
        while (f, o) in nxt:
            want.add((f, o))
            o = nxt[f, o]
    got = {tuple(r) for r in warc.reachable(spark.createDataFrame(rows, "file string, offset long, next long")).collect()}
    assert got == want


# ---- 3 -------------------------------------------------------------------------------------------

def brute_nearest(rows, queries, k):
    out = {}
    for qi in queries:
        q = rows[qi]
        scored = [(-round(float(np.einsum("j,j->", v, q) / (np.linalg.norm(v) * np.linalg.norm(q))), 12), i) for i, v in rows.items() if i != qi]
        out[qi] = [i for _, i in sorted(scored)[:k]]
    return out


def test_vantage_points_with_factor_one_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = {i: rng.normal(size=8) for i in range(700)}
    rows |= {i: np.ones(8) for i in range(700, 1000)}  # one very common vector
    bad = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] + [1.0] * 7), (2004, [float("inf")] * 8), (2005, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()] + bad, "vec_id long, embedding array<double>").repartition(5)
    trees = vptree.index(df, "vec_id", "embedding", shard_rows=300)
    wanted = [i for i in rows if i % 50 == 0]
    got = vptree.nearest(trees, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, factor=1.0, block_rows=7).collect()
    found = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in wanted}
    assert found == brute_nearest(rows, wanted, 5)
    assert {r.query_id for r in got} == set(wanted)


@pytest.mark.parametrize("dim", [4, 8, 16])
@pytest.mark.parametrize("shards", [1, 8])
def test_vantage_points_recall_at_the_factor_used(dim, shards):
    rng = np.random.default_rng(dim)
    n, k = 4096 * shards, 5
    unit = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids, asked = np.arange(n), np.arange(0, n, n // 100)[:100]
    found = [[] for _ in asked]
    for s in range(shards):
        own = unit[s::shards]
        for out, rows in zip(found, vptree.search(vptree.build_tree(own), own, ids[s::shards], unit[asked], asked, k, vptree.FACTOR)):
            out += ids[s::shards][rows].tolist()
    hits = 0
    for q, out in zip(asked, found):
        score = unit @ unit[q]
        score[q] = -9
        best = np.array(out)[np.argsort(-score[out], kind="stable")[:k]]
        hits += len(set(best.tolist()) & set(np.argsort(-score, kind="stable")[:k].tolist()))
    assert hits >= 0.95 * k * len(asked)


def test_vantage_points_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = vptree.nearest(vptree.index(df, "vec_id", "embedding"), df.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    none = df.where("false")
    assert vptree.nearest(vptree.index(none, "vec_id", "embedding"), none, "vec_id", "embedding", 5).count() == 0


# ---- 4 -------------------------------------------------------------------------------------------

def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at:at + rng.choice([0, 1])] = [f"e{rng.randrange(10**6)}"] * rng.choice([0, 1])
        out = out or ["x"]
    return out


def test_banded_alignment_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        b = [c for c in edited(rng, a, rng.randrange(8))]
        d = plain_distance(a, b)
        for limit in (1, 2, 4, 9, 20):
            assert ordermin.edit_distance(a, b, limit) == min(d, limit + 1)
    a = [str(i) for i in range(400)]
    assert ordermin.edit_distance(a, a[50:] + ["z"] * 20, 120) == 70


def test_near_duplicate_classes_against_brute_force(spark):
    rng = random.Random(7)
    base = [words(rng, rng.randrange(30, 120)).split() for _ in range(25)]
    texts = [" ".join(edited(rng, b, rng.randrange(len(b) // 10))) for b in base for _ in range(rng.randrange(1, 9))]
    passage = words(rng, 60)  # shared by many, but under 0.8 of each
    texts += [passage + " " + words(rng, 80) for _ in range(30)]
    texts += [" ".join(base[0])] * 40 + [None, "", " \n", "one two", "one two", "one three"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in ordermin.mark(frame(spark, rows), "doc_id", "text").collect()}
    split = [(t or "").split() for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if ordermin.similar(split[i], split[j]) is not None:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    assert got == {i: top(i) for i in range(len(texts))}


def brute_classes(texts):
    split, root = [(t or "").split() for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if ordermin.similar(split[i], split[j]) is not None:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {i: top(i) for i in range(len(texts))}


def test_one_large_bucket_of_unlike_texts_leaves_no_link_unmet(spark, monkeypatch):
    rng, real = random.Random(23), ordermin.sign
    monkeypatch.setattr(ordermin, "sign", lambda *a: real(*a).withColumn("sketches", F.array(F.lit(7).cast("long"))))
    shared = words(rng, 30)
    texts = [shared + " " + words(rng, 40) for _ in range(150)]
    texts += [" ".join(edited(rng, t.split(), 8)) for t in texts[:30]]  # links of single texts
    base = words(rng, 100).split()
    swap = lambda t, lo, hi: [f"s{rng.randrange(10**6)}" if lo <= i < hi else w for i, w in enumerate(t)]
    left, right = swap(base, 0, 10), swap(base, 90, 100)  # alike by exactly 0.8
    texts += [" ".join(x) for x in (left, right)] + [" ".join(swap(left, 40 + i, 50 + i)) for i in range(20)] + [" ".join(swap(right, 40 + i, 50 + i)) for i in range(20)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in ordermin.mark(frame(spark, rows), "doc_id", "text").collect()}
    assert got == brute_classes(texts)


@pytest.mark.parametrize("similarity,least", [(0.8, 0.98), (0.85, 0.99), (0.9, 0.99)])
def test_scattered_edits_share_a_sketch(similarity, least):
    rng = np.random.default_rng(29)
    met, tries = 0, 600
    for i in range(tries):
        n = int(rng.integers(60, 400))
        a = rng.integers(1, 2**62, n).astype(np.uint64)
        b = a.copy()
        b[rng.choice(n, int(n * (1 - similarity) + 1e-9), replace=False)] = rng.integers(1, 2**62, int(n * (1 - similarity) + 1e-9)).astype(np.uint64)
        met += bool((ordermin.sketch(a) == ordermin.sketch(b)).any())
    print("share a sketch", similarity, met / tries)
    assert met >= least * tries


def test_bags_reject_no_link_and_words_meet_once_for_all_buckets(spark):
    rng = random.Random(37)
    base = words(rng, 60).split()
    texts = [" ".join(edited(rng, base, rng.randrange(1, 12))) for _ in range(12)] + [words(rng, 60) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, t string")
    signed = ordermin.sign(docs, "key", "t")
    made = signed.join(docs, signed["id"] == docs["key"]).select("id", "n", "bag", "t").localCheckpoint()
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)]
    kept = {(r.a, r.b) for r in ordermin.may_link(spark.createDataFrame(pairs, "a long, b long"), made).collect()}
    links = {(i, j) for i, j in pairs if ordermin.similar(texts[i].split(), texts[j].split()) is not None}
    assert links <= kept
    assert len(kept) < len(pairs) / 2  # texts of their own are told apart without their words
    rows = made.crossJoin(spark.range(10).withColumnRenamed("id", "bucket")).select("bucket", "id", "n")
    parts = ordermin._apart(rows, spark.createDataFrame([], "node long, root long")).localCheckpoint()
    assert parts.groupBy("bucket", "band").agg(F.max("own").alias("own")).where("NOT own").count() == 0
    met = ordermin._met(parts, made)
    assert met.count() == met.select("k1", "no").distinct().count()  # not once for each of the ten buckets


def test_near_duplicates_odd_ids(spark):
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (None, "a b c", "en", "s"), (2, "a b c", "en", "s")]
    out = ordermin.mark(frame(spark, rows), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in out) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert ordermin.mark(frame(spark, []), "doc_id", "text").count() == 0


def test_near_duplicates_of_every_text_of_a_repeated_id(spark):
    rng = random.Random(31)
    texts = [words(rng, 80) for _ in range(24)]
    rows = [(100 + i // 2, t, "en", "s") for i, t in enumerate(texts)]  # twelve ids of two unlike texts each
    rows += [(i, " ".join(edited(rng, t.split(), 3)), "en", "s") for i, t in enumerate(texts)]  # a near copy of every text
    got = {r.id: r.class_id for r in ordermin.classes(frame(spark, rows), "doc_id", "text").collect()}
    assert got == {**{i: i for i in range(24)}, **{100 + i: 2 * i for i in range(12)}}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400, i) for i in range(401, 460)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: top(x) for x in nodes}


# ---- 5 -------------------------------------------------------------------------------------------

def test_counting_holds_one_text_of_a_batch_at_a_time(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    class Fed:
        """Stands for the table; keeps the function that workers run."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def groupBy(self, *_):
            return self

        agg = groupBy

    monkeypatch.setattr(perplexity, "STRETCH", 1 << 14)
    fed, text = Fed(), " ".join(f"w{i % 50}" for i in range(1000))
    perplexity.count_ngrams(fed, "text", running_text=True)
    batch = pa.RecordBatch.from_arrays([pa.array([text, None, ""] * 300)], names=["text"])
    tracemalloc.start()
    made = list(fed.run([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sum(b.column("n").to_pylist()) for b in made) == 300 * (len(text) + 1)
    assert most < 8_000_000  # the words of all texts took 13 MB and more


def test_model_is_a_distribution_and_counts_all_words(spark):
    rng = random.Random(3)
    texts = [words(rng, 60, 40) for _ in range(30)] + [None, "", "é ü\tx"]
    df = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    counted = {r.code: r.n for r in perplexity.count_ngrams(df, "text").collect()}
    want = Counter()
    for t in texts:
        for w in (t or "").encode().split():
            padded = b" " * 4 + w + b"\n"
            want.update(int.from_bytes(padded[i:i + 5], "big") for i in range(len(w) + 1))
    assert counted == want
    model = perplexity.fit(df, "text")
    for context in (b"    ", b"  w1", b"zzzz", b"   w"):
        start = int.from_bytes(context, "big") << 8
        assert abs(np.exp(perplexity.log_prob(model, np.arange(256, dtype=np.int64) + start)).sum() - 1) < 1e-9


def test_model_keeps_every_ngram_of_a_large_vocabulary(spark):
    spread = F.explode(F.sequence(F.lit(0), F.lit(39)))
    made = spark.range(5000).select("id", spread.alias("i")).groupBy("id").agg(F.concat_ws(" ", F.collect_list(F.substring(F.base64(F.unhex(F.md5(F.concat("id", F.lit("|"), "i")))), 1, 12))).alias("text"))
    df = made.select("text").localCheckpoint()
    model = perplexity.fit(df, "text")
    raw = {w for r in df.collect() for w in r.text.encode().split()}
    inner = {w[i:i + 5] for w in raw for i in range(len(w) - 4)}
    assert len(inner) > 1_000_000 and len(model[-1]["code"]) > 1_000_000
    codes = np.fromiter((int.from_bytes(x, "big") for x in inner), dtype=np.int64)
    assert np.isin(codes, model[-1]["code"]).all()


def test_word_order_counts_in_the_score(spark):
    rng = random.Random(31)
    chain = ["alpha", "of", "x", "beta", "running", "to", "gamma", "delta"]
    plain = [" ".join(chain * 6)] * 40
    shuffled = chain * 6
    rng.shuffle(shuffled)
    df = frame(spark, [(i, t, "en", "s") for i, t in enumerate([*plain, " ".join(shuffled)])])
    model = perplexity.fit(df, "text")
    out = {r.doc_id: (r.log_prob, r.n_bytes) for r in perplexity.score(df, "doc_id", "text", "lang", model).collect()}
    assert out[0][1] == out[40][1] and out[40][0] < 2 * out[0][0]
    for i, t in ((0, plain[0]), (40, " ".join(shuffled))):
        raw = b" " * 4 + b"".join(w.encode() + b"\n" for w in t.split())
        codes = np.array([int.from_bytes(raw[j:j + 5], "big") for j in range(len(raw) - 4)])
        assert abs(perplexity.log_prob(model, codes).sum() - out[i][0]) < 1e-6


def test_base_rule_against_plain_counts_and_odd_rows(spark):
    rng = random.Random(9)
    block = words(rng, 12)
    texts = [None, "", " \t\n", "one", block + "\n" + block + "\n\n x # $ \n x # $ ", "a " * 400, words(rng, 200), words(rng, 5000), "é ü \x0b z\x0c"] + [words(rng, 50)] * 3
    rows = [(i if i else None, t, None if i % 2 else "en", "s") for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in perplexity.judge(frame(spark, rows), "doc_id", "text", "lang").collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        t, r = t or "", out[i if i else None]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        runs = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
        covered = {j + k for j in range(len(w) - 7) if runs[tuple(w[j:j + 8])] > 1 for k in range(8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), again, len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not r.kept or not r.base_failed)


def test_bands_reject_junk_and_keep_prose(spark):
    rng = random.Random(11)
    parts = ["ba", "lo", "mi", "ten", "ra", "su", "del"]
    prose = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    junk = lambda n: " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(8)) for _ in range(n))
    rows = [(i, prose(rng.randrange(40, 200)), "en", "s") for i in range(300)] + [(i, junk(100), "en", "s") for i in range(300, 310)]
    out = {r.doc_id: r.kept for r in perplexity.judge(frame(spark, rows), "doc_id", "text", "lang").collect()}
    assert all(out[i] for i in range(300)) and not any(out[i] for i in range(300, 310))
    assert perplexity.judge(frame(spark, []), "doc_id", "text", "lang").count() == 0


# ---- 6 -------------------------------------------------------------------------------------------

def test_minimum_cut_is_the_least_cost_labelling():
    rng = random.Random(3)
    for _ in range(600):
        n = rng.randint(1, 8)
        u = [rng.uniform(-3, 3) for _ in range(n)]
        e = [(a, b, rng.random() * 2) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda lab: sum((max(-x, 0) if k else max(x, 0)) for x, k in zip(u, lab)) + sum(w for a, b, w in e if lab[a] != lab[b])
        best = min(cost(lab) for lab in itertools.product([False, True], repeat=n))
        assert abs(cost(mincut.min_cut(u, e)) - best) < 1e-9


PAGE = """<html><head><title>T</title></head><body><header class="top"><a href=x>Home</a></header><div id="cookie-notice">We use cookies</div>
<div class="wrap"><div class="post-content"><h1>T &amp; U</h1><p><b>One two
 three.<br><p>Next&nbsp;one.</p><aside>side</aside><form><label>Name</label></form><script>var t="</p>";</script><!-- <p>no</p> -->
<p>Four <a href=q title="a>b">link</a> six.</p></div><section class="comments"><p>I liked it very much, thank you.</p></section></div>
<div class="sidebar"><p>Other</p></div><footer>c</footer></body></html>"""


def test_extraction(spark):
    want = "T & U\n\nOne two three.\n\nNext one.\n\nFour link six."
    assert mincut.main_text(PAGE) == want
    cut = "<nav><ul><li>m</li></ul><article><p>a &lt; b</p><p>tail &am"
    pages = spark.createDataFrame([(1, PAGE, "t"), (2, None, "t"), (3, "", "t"), (4, cut, "t"), (4, cut, "t"), (5, "<p>a</p" * 3, "t"), (6, "<!-- x", "t")],
                                  "page_id long, html string, text string")
    out = [(r.page_id, r.text) for r in mincut.extract(pages, "html").collect()]
    assert sorted(out)[:5] == [(1, want), (2, ""), (3, ""), (4, "a < b\n\ntail &am"), (4, "a < b\n\ntail &am")]
    long = "<article>" + "<p>word word.</p>" * 20_000 + "</article>"
    assert mincut.main_text(long).count("word.") == 20_000
    assert mincut.extract(pages.where("false"), "html").count() == 0


# ---- 7 -------------------------------------------------------------------------------------------

def test_bpe_round_trip_and_cuts(spark):
    ranks, pattern = tokenizer()
    enc = bpe.encoder(ranks, pattern)
    texts = [None, "", "a b\n c  d" * 10, "é" * 5 + " " * 7 + "x" * 300, "word " * 30000, "x" * 70000 + " y" * 40000,
             "a's don't \t\n\n  12345 ümläut ###", "日本語 " * 30000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts * 40)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, "text", ranks, pattern), "ids", ranks, pattern).collect()
    assert len(out) == len(texts) * 40
    for r in out:
        assert list(r.ids) == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert len(bpe.pieces("word " * 30000)) > 1 and "".join(bpe.pieces("word " * 30000)) == "word " * 30000
    assert bpe.encode(df.where("false"), "text", ranks, pattern).count() == 0


# ---- 8 -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("toxic, ordinary", [(700, 6000), (toxicity.TOXIC_ROWS, toxicity.ORDINARY_ROWS), (1500, 1500)])
def test_toxicity_learns_from_a_full_sample(toxic, ordinary):
    rng = random.Random(3)
    plain = [f"{a}{b}{c}{d}" for a in "bdfgklmn" for b in "aeiou" for c in "prstvz" for d in "aeio"]
    sample = [(1 + i % 4, y, " ".join(rng.choices(plain, k=40) + y * [rng.choice(["scoundrel", "blockhead", "wretched"])]), 1.0 if y else 4.0)
              for y, n in ((1, toxic), (0, ordinary)) for i in range(n)]
    model = toxicity.fit(sample)
    windows, (a, b, c) = toxicity.Windows(model), model["curve"]
    score = lambda t: 1 / (1 + math.exp(-(a + b * windows.features(t)[0] + c * windows.features(t)[1])))
    tests = [(" ".join(rng.choices(plain, k=30) + y * ["blockhead"]), y) for y in (0, 1) for _ in range(300)]
    assert sum(score(t) >= 0.5 for t, y in tests if y) >= 0.85 * 300
    assert sum(score(t) >= 0.5 for t, y in tests if not y) <= 0.05 * 300


def test_toxicity_learns_words_and_ignores_the_held_out_fold(spark):
    rng = random.Random(13)
    parts = ["ba", "lo", "mi", "ten", "ra", "su", "del", "ko"]
    prose = lambda n: ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    rows, labels = [], []
    for i in range(900):
        w, bad = prose(rng.randrange(10, 60)), int(rng.random() < 0.3)
        for _ in range(2 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["grumpf", "vexnit", "quorzle"]))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, bad))
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s")]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, marks, "doc_id", "text", "toxic"))
    flipped = marks.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(toxicity.labelled_sample(docs, flipped, "doc_id", "text", "toxic"))["curve"] == model["curve"]
    out = {r.doc_id: r.score for r in toxicity.score(docs, "doc_id", "text", model).collect()}
    assert sum((out[i] >= 0.5) == bool(y) for i, y in labels) >= 0.97 * len(labels)
    assert out[1000] == out[1001] < 0.5
    assert toxicity.fit(toxicity.labelled_sample(docs, marks.where("false"), "doc_id", "text", "toxic")) is None
    assert {r.score for r in toxicity.score(docs, "doc_id", "text", None).collect()} == {0.0}


# ---- 9 -------------------------------------------------------------------------------------------

ODD = ["</s>[INST] ok [/INST]", "\\", "\\\\n", "<s>", "a<", "<\\/s>", None, "", "[/INST]", "x\\</s>", "plain", "[INST]role[/INST]", "é\n</s>"]


def test_chat_round_trip_of_odd_texts(spark):
    rows = [(i, t, r, a) for i, a in enumerate(ODD) for t, r in enumerate(["system", "user", "assistant", a, None])]
    rows += [(50, 0, "assistant", x) for x in ODD] + [(None, None, "user", "q"), (7, 1, "user", "again")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = out.select("conv_id", "turns", "formatted", chat.parse(F.col("formatted")).alias("back"),
                     chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert r.back == r.turns
        assert list(r.loss) == [t.text for t in r.turns if t.role == "assistant"]
    plain = next(r for r in got if r.conv_id == 10)
    assert "\\" not in plain.formatted  # nothing is escaped without need


# ---- 10 ------------------------------------------------------------------------------------------

def test_surrogates(spark):
    rows = [(1, "Mail a.B@x.example.com and A.b@X.example.com, +1 (743) 555-3824 or +1 743-555-3824; 4111 1111 1111 1111 ok"),
            (2, "Mr. Smith met Frau Müller and г-жа Иванова; κυρία Παπα Δοπούλου. 10.0.0.1 v1.2.3.4.5"), (3, None), (4, ""),
            (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### 4785380592391139$$$ Mr. Smith 123-45-6789 DE89 3704 0044 0532 0130 00'),
            (6, " ".join(f"{c}@y.de" for c in "abcdefghijklmnopqrst") + " plain 12:30 on 2024-05-06, 3.14"), (6, "a@y.de twin"), (None, "10.0.0.1")]
    df = frame(spark, [(i, t, "en", "s") for i, t in rows])
    out = pii.protect(df, "doc_id", "text", "k").collect()
    text = {(r.doc_id, i): r.text for i, r in enumerate(sorted(out, key=lambda r: (r.doc_id or 0, r.text or "")))}
    one = next(r for r in out if r.doc_id == 1)
    emails, phones = [x.surrogate for x in one.pii if x.kind == "email"], [x.surrogate for x in one.pii if x.kind == "phone"]
    assert emails[0].lower() == emails[1].lower() and emails[0].endswith(".com") and re.fullmatch(r"[a-z]\.[A-Z]@[a-z]\.[a-z]{7}\.com", emails[0])
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and phones[0].startswith("+1 (")
    card = re.sub(r"\D", "", next(x.surrogate for x in one.pii if x.kind == "card"))
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card))) % 10 == 0
    two = next(r for r in out if r.doc_id == 2)
    assert [x.kind for x in two.pii] == ["name"] * 4 + ["ip"] and "v1.2.3.4.5" in two.text
    names = [x.surrogate for x in two.pii[:4]]
    assert names[0].startswith("Mr. ") and names[2].endswith("ова") and names[3].split()[1] in pii.GIVEN["greek", "f"]
    five = next(r for r in out if r.doc_id == 5)
    assert names[0] in five.text and re.search(r'"[0-9a-f]{40}"###', five.text) and [x.kind for x in five.pii] == ["secret", "card", "name", "ssn", "iban"]
    six = next(r for r in out if r.doc_id == 6 and len(r.pii) > 1)
    made = [x.surrogate for x in six.pii]
    assert len(set(made)) == 20 and not set(made) & {f"{c}@y.de" for c in "abcdefghijklmnopqrst"}
    assert six.text.endswith("plain 12:30 on 2024-05-06, 3.14")
    twin = next(r for r in out if r.doc_id == 6 and len(r.pii) == 1)
    assert twin.text == made[0] + " twin"
    assert {r.doc_id: r.text for r in out if r.doc_id in (3, 4)} == {3: None, 4: ""} and len(text) == len(rows)
    assert pii.protect(df.where("false"), "doc_id", "text", "k").count() == 0


def test_every_kind_of_entity_passes_the_search_filter(spark):
    key = "ABCDEFGHIJKLMNOP"
    bare = [("secret", "AKIA" + key), ("secret", "ASIA" + key), ("secret", "abcdef" * 6), ("secret", "ABCDEF" * 6), ("secret", "ghp_" + "x" * 36),
            ("secret", "sk-" + "y" * 20), ("email", "a.b@host.example")] + [("name", t + " Xyz") for t in pii.MALE_TITLES + pii.FEMALE_TITLES]
    digits = [("secret", "0123456789abcdef" * 2), ("ip", "10.0.0.1"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"),
              ("phone", "+1 743-555-3824"), ("phone", "(743) 555-3824"), ("card", "4111 1111 1111 1111")]
    rows = bare + digits
    out = {r.doc_id: r for r in pii.protect(frame(spark, [(i, f"it is {v} here", "en", "s") for i, (_, v) in enumerate(rows)]), "doc_id", "text", "k").collect()}
    for i, (kind, value) in enumerate(rows):
        assert [x.kind for x in out[i].pii] == [kind] and value not in out[i].text


# ---- pipeline ------------------------------------------------------------------------------------

def test_filtering_stages_decide_by_row(spark):
    import corpus_pipeline
    rng = random.Random(21)
    parts = ["ba", "lo", "mi", "ten", "ra", "su", "del"]
    prose = lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    clean = [(None, prose(80), "en", "s"), (None, prose(90), "en", "s"), (3, prose(100), "en", "s"), (4, prose(100), None, "s")]
    junk = [(None, "too short", "en", "s"), (3, "again too short", "en", "s"), (4, None, None, "s"), (None, None, "en", "s")]
    docs = frame(spark, clean + junk)
    out = corpus_pipeline.keep_fluent(spark, docs, "")
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t) for i, t, _, _ in clean)
    base = prose(100)
    rows = [(1, base, "en", "s"), (5, base + " end", "en", "s"), (5, prose(100), "en", "s"), (6, prose(60), "en", "s"), (None, base, "en", "s"),
            (7, prose(70), "en", "s"), (7, prose(70), "en", "s"), (8, None, "en", "s")]
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t) for n, (i, t, _, _) in enumerate(rows) if n != 1)


def test_texts_that_are_not_wanted_stay_where_they_lie(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("key"), F.concat(F.lit("text  of "), F.col("id")).alias("t"))
    name = F.struct(F.col("key").alias("id"), F.xxhash64(F.unhex(F.md5(F.concat(F.lit("text of "), F.col("key"))))).alias("h"))
    wanted = cut_lineage(docs.where("key % 10 = 0").select(name.alias("id"), F.lit(3).cast("long").alias("n"), F.lit(b"x").alias("bag")))
    moved, real = [], ordermin._likely
    monkeypatch.setattr(ordermin, "_likely", lambda *a: (moved.append(real(*a)), moved[0])[1])
    assert {r.id.id for r in ordermin._texts(docs, wanted).collect()} == set(range(0, 3000, 10))
    assert 300 <= moved[0].count() < 600
    monkeypatch.setattr(ordermin, "SLOT_BITS", 8)  # too few bits move more texts, and give the same ones
    del moved[:]
    assert ordermin._texts(docs, wanted).count() == 300 and moved[0].count() > 2000
