"""Packing, clustering and conversation repair: brute force, exact round trips, odd rows, hot keys."""

import hashlib
import heapq
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasebench.llm import retpack, shallot, turnrepair
from phrasebench.llm.queries import word_vocabulary

# ---- clustering ----------------------------------------------------------------------------------


def plain_means(ids, vectors, k, rounds):
    """All distances in every round, in integers."""
    x = np.floor(256 * np.asarray(vectors, dtype=np.float64)).astype(np.int64)
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"2:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = np.stack([((x - one) ** 2).sum(1) for one in c], 1)
        a = d.argmin(1)
        if r == rounds:
            return a, d.min(1), c
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].sum(0) // (a == j).sum()


def clustered(spark, rows, k=5, rounds=3, width=4):
    df = spark.createDataFrame([(i, v, "near", 7, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, block long, id long")
    made, centroids = shallot.cluster(df, "vec_id", "embedding", k, rounds, width=width)
    return made.collect(), centroids


@pytest.mark.parametrize("seed, spread", [(1, 1.0), (2, 0.02), (3, 1000.0)])
def test_clusters_equal_those_of_all_distances(spark, seed, spread):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(700, 4)) * spread + rng.integers(0, 3, (700, 1)), 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, centroids = clustered(spark, rows, 12, 4)
    a, d, c = plain_means(list(range(700)), x, 12, 4)
    assert (centroids == c).all() and [r.cluster for r in sorted(got, key=lambda r: r.vec_id)] == a.tolist()
    assert [r.distance for r in sorted(got, key=lambda r: r.vec_id)] == d.tolist()
    for r in got:
        assert r.inertia == d.sum() and r.cluster_inertia == d[a == r.cluster].sum()
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_search_from_any_remembered_pair_is_exact_and_skips():
    rng = np.random.default_rng(4)
    c = np.unique(rng.integers(-900, 900, (60, 8)), axis=0).astype(np.int64)
    x = (c[rng.integers(0, len(c), 500)] + rng.integers(-40, 40, (500, 8))).astype(np.int64)
    start = rng.integers(0, len(c), 500)
    near, second, d1, d2 = shallot.search(x, start, (start + 1 + rng.integers(0, len(c) - 1, 500)) % len(c), shallot.Centres(c))
    d = shallot.squared(x, c)
    assert (near == d.argmin(1)).all() and (d1 == d.min(1)).all()
    assert (d2 == np.sort(d, axis=1)[:, 1]).all()
    # moved a little, most vectors keep their centroid without a distance
    state = shallot.assign(x, None, shallot.Centres(c))
    moved = c + rng.integers(-2, 3, c.shape)
    read = []
    plain = shallot.search
    shallot.search = lambda v, *rest: (read.append(len(v)), plain(v, *rest))[1]
    try:
        after = shallot.assign(x, state, shallot.Centres(moved, c))
    finally:
        shallot.search = plain
    assert (after[0] == shallot.squared(x, moved).argmin(1)).all() and sum(read) < 250


def test_squared_distances_of_large_components():
    x = np.array([[shallot.LARGEST, -shallot.LARGEST], [3, 4]], dtype=np.int64)
    c = np.array([[-shallot.LARGEST, shallot.LARGEST], [0, 0]], dtype=np.int64)
    assert shallot.squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 0.0, 0.0]), (5, [nan, 0.0, 0.0, 0.0]), (6, [inf, 0.0, 0.0, 0.0]), (7, [1e30, 0.0, 0.0, 0.0])]
    fine = [(10, [0.0] * 4), (10, [0.0] * 4), (11, [-0.3, 0.7, 0.1, -2.5]), (None, [0.5, 0.5, 0.5, 0.5])]
    got, centroids = clustered(spark, odd + fine, 40, 5)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 10), (False, 10), (False, 11), (True, 0)]
    a, d, c = plain_means([i for i, _ in fine], [v for _, v in fine], 40, 5)
    assert len(centroids) == 4 and sorted(r.distance for r in got) == sorted(d.tolist())
    assert clustered(spark, odd)[0] == [] and clustered(spark, [])[0] == []
    one, _ = clustered(spark, [(1, [0.1] * 4)] * 300 + [(2, [9.0] * 4)], 1, 2)
    assert len(one) == 301 and {r.cluster for r in one} == {0}


# ---- packing -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    made = Tokenizer.from_str(word_vocabulary())
    made.encode_special_tokens = True
    return made


def packed(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x", 1, 2, b"") for i, t in rows], "doc_id long, text string, sketch string, digest long, n long, ids binary")
    return retpack.pack(df, "doc_id", "text", word_vocabulary(), **how).collect()


def whole(pieces, rows, library, window):
    """Every id of every row in exactly one piece; sequences gapless, full or a power of two."""
    want = sorted((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    by_key, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, dtype="<i4").tolist()
        assert len(ids) == p.length > 0
        by_key.setdefault(-1 if p.key is None else p.key, []).append((p.start, ids, p.doc_tokens))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    if len(by_key) == len(rows):  # ids are unique
        got = sorted((k, [i for _, ids, _ in sorted(v) for i in ids]) for k, v in by_key.items())
        assert got == want and all(n == len(ids) for (k, ids) in got for _, _, n in by_key[k])
    assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in want)


def test_pieces_cover_every_document_once(spark, library):
    rng = random.Random(5)
    topics = [[f"{a}{b}{c}" for b in "aeiou" for c in "dklmnrst"] for a in ("gar", "pel", "vun", "sho")]
    rows = [(i, " ".join(rng.choices(topics[i % 4] + ["the", "of", "and"], k=rng.randrange(0, 90)))) for i in range(400)]
    rows += [(1000, " ".join(rng.choices(topics[0], k=900))), (1001, ""), (1002, None), (1003, "a\tb\nc\r\nd  e f é <|endoftext|> It's 42!?"), (None, "no id")]
    pieces = packed(spark, rows, window=256, shard_tokens=20_000, range_tokens=30_000)
    whole(pieces, rows, library, 256)
    # windows hold neighbours: documents of one topic meet far more often than by chance (one in four)
    by = {}
    for p in pieces:
        if p.key is not None and p.key < 400 and p.doc_tokens > 20:
            by.setdefault(p.sequence_id, set()).add(p.key % 4)
    alone = [len(v) == 1 for v in by.values()]
    assert sum(alone) / len(alone) > 0.6


def test_neighbours_are_those_of_a_full_scan():
    rng = np.random.default_rng(6)
    df = np.bincount(rng.integers(0, 80, 900), minlength=80)
    idf = retpack.weights_of(200, df)
    items = [retpack.item(i, rng.integers(0, 80, rng.integers(1, 60)).astype(np.int32), idf, 30.0) for i in range(200)]
    shard = retpack.Shard(items)
    for i in rng.permutation(200)[:150]:  # past the point where postings are thinned out
        shard.use(int(i))
    for i in (0, 7, 133):
        told = dict(zip(items[i].terms.tolist(), itertools.repeat(1)))
        score = [sum(w for t, w in zip(o.terms.tolist(), o.weights.tolist()) if t in told) for o in items]
        left = sorted(np.flatnonzero(shard.unused).tolist(), key=lambda j: (-round(score[j], 9), j))
        for space in (1, 50, 400, 10_000):
            got, sizes = shard.neighbours(i, space), np.cumsum([len(items[j].ids) for j in left])
            assert got == left[:int(np.searchsorted(sizes, space)) + 1]


def test_packing_of_odd_tables(spark, library):
    assert packed(spark, []) == []
    copies = [(i % 3, "one text that stands here a thousand times over") for i in range(1000)]  # a hot text and repeated ids
    whole(packed(spark, copies, range_tokens=2000), copies, library, 2048)
    long = [(1, "word " * 30_000 + "x" * 5000)]
    whole(packed(spark, long), long, library, 2048)
    nothing = [(1, None), (2, ""), (None, None)]
    assert sorted(p.doc_tokens for p in packed(spark, nothing)) == [1, 1, 1]


def test_words_are_encoded_as_whole_texts_are(library):
    texts = ["", " ", "Über-Straße ÀÉ İstanbul ΣΑΣ", "tab\tnew\nline\x0bvt\x0cff\x1cfs em nbsp", "don't I'll we've 'tis 'S",
             "a" * 5000, "é́ ́x", "日本語 テスト 123 ४५", "<|startoftext|> x<|endoftext|>y", "😀😀 !!!??? ..", "\u0001 \u0001x y\u0001", "\u0000a﻿b"]
    words = retpack.Words(word_vocabulary(), 1)
    for again in range(2):
        ids, ends = words.ids(pa.array([*texts, None], pa.string()))
        for text, start, end in zip([*texts, ""], [0, *ends], ends):
            assert ids[start:end].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text


# ---- perplexity ----------------------------------------------------------------------------------

def plain_kneser_ney(texts, order):
    """P(byte | bytes before it) of an interpolated modified Kneser-Ney model, from dictionaries."""
    from collections import Counter, defaultdict

    from phrasebench.llm.perplexity import discounts
    counts = {order: Counter(t[i:i + order] for t in texts for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])  # distinct bytes before it
    cuts = {k: (0.0, *discounts([sum(n == c for n in counts[k].values()) for c in (1, 2, 3, 4)])) for k in counts}
    after = {k: defaultdict(list) for k in counts}
    for k, table in counts.items():
        for g, n in table.items():
            after[k][g[:-1]].append(n)

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        seen = after[k].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        n, cut = counts[k].get(gram, 0), cuts[k]
        spare = sum(cut[min(x, 3)] for x in seen) / sum(seen)
        return max(n - cut[min(n, 3)], 0) / sum(seen) + spare * p(gram[1:])
    return p


def test_model_and_scores_are_those_of_plain_kneser_ney(spark):
    from phrasebench.llm import perplexity
    rng = random.Random(11)
    words = ["sol", "mare", "ventus", "solis", "ma", "ar", "é", "x"]
    docs = [" ".join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(60)] + ["", "  ", "sol " * 400]
    df = spark.createDataFrame([(i, t, "la") for i, t in enumerate(docs)], "id long, text string, lang string")
    whole = [perplexity.running(t.encode().split()) for t in docs]
    p, n = plain_kneser_ney([t for t in whole if t], perplexity.ORDER), perplexity.ORDER
    stretch = perplexity.STRETCH
    perplexity.STRETCH = 40  # texts are cut into many parts
    try:
        model = perplexity.fit(df, "text")
        got = {r["id"]: r for r in perplexity.score(df, "id", "text", "lang", model).collect()}
    finally:
        perplexity.STRETCH = stretch
    for i, t in enumerate(whole):
        want = sum(np.log(p(t[j:j + n])) for j in range(len(t) - n + 1)) if t else 0.0
        assert abs(got[i]["log_prob"] - want) < 1e-8 * max(1, abs(want)) and got[i]["n_bytes"] == max(0, len(t) - n + 1)


# ---- repair --------------------------------------------------------------------------------------

def cheapest(symbols):
    """Least (cost, audit) by search over all edits, a row at a time."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(symbols) and last in ("", "a"):
            return cost, audit
        role = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, role))
        if i < len(symbols):
            kind, fault = divmod(symbols[i], 4)
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if fault not in (1, 2):
                more = fault == 3
                own = "sua?"[kind]
                if own == role or (own == "s" and last == "" and not set(audit) - {"D"}):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, own))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, role))


def runs_of(symbols):
    return [(s, len(list(g))) for s, g in itertools.groupby(symbols)]


def test_repair_is_the_cheapest_and_least():
    rng, solver = random.Random(7), turnrepair.Repair()
    for n in [*range(0, 7)] * 30 + [12, 20, 33] * 8:
        symbols = [rng.choice((0, 4, 4, 8, 8, 12, 5, 10, 7, 11, 3)) for _ in range(n)]
        if rng.random() < 0.5:
            symbols = [s for s in symbols for _ in range(rng.choice((1, 1, 2, 5)))]
        assert solver.solve(runs_of(symbols)) == cheapest(symbols), symbols


def test_repair_of_long_runs_takes_few_steps():
    solver = turnrepair.Repair()
    cost, audit = solver.solve([(0, 1), (4, 1_000_000), (10, 3_000_001)])
    assert audit == "K" + "KI" * 1_000_000 + "D" * 3_000_001 or cost < 2_000_000 + 9_000_003
    assert len(solver.powers) < 100 and len(solver.blocks) < 2000
    small = [0] + [4] * 37 + [10] * 9 + [8] * 12
    assert solver.solve(runs_of(small)) == cheapest(small)


def plain_repair(rows):
    """(conv → result columns) by the contract's words, a row at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, symbols = set(), []
        for _, role, text in own:
            told = [c for c in text if c not in turnrepair.WHITE]
            fault = 1 if not told else 2 if (role, text) in seen else 0 if told[-1] in ".!?" else 3
            seen.add((role, text))
            symbols.append(4 * ("sua".index(role[0]) if role and role[0] in "sua" else 3) + fault)
        cost, audit = cheapest(symbols)
        lines, i, last = [], 0, ""
        for letter in audit:
            role, text = (own[i][1], own[i][2]) if letter != "I" else ("", "")
            i += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[0]
        turns = [t for t, _, _ in own if t is not None]
        legal = {("s", "u"), ("u", "a"), ("a", "u")}
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(s % 4 == f for s in symbols) for f in (1, 2, 3)],
                     sum((a[1][:1], b[1][:1]) not in legal for a, b in zip(own, own[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, b"k") for r in rows], "conv_id long, turn long, role string, text string, audit string, n long, digest binary")
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turnrepair.repair_all(df, df).collect()}


def test_repair_of_odd_conversations(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (2, None, None, None), (2, 5, "tool", "x"), (2, 9, "", "y."),
            (None, 1, "assistant", "no id"), (None, 0, "user", "Q!"), (3, 4, "user", "Same."), (3, 4, "user", "Same."), (3, 6, "user", "Same."),
            (3, 4, "assistant", "Tie."), (4, None, "user", " \t\x0b"), (5, 0, "system", "S."), (5, 1, "system", "T."), (5, 2, "user", "end. \n"),
            (6, 0, "user", "a "), (7, 0, "assistant", "long " * 60_000 + "."), (7, 0, "assistant", " " * 200_000)]
    assert repaired(spark, rows) == plain_repair(rows)
    assert repaired(spark, []) == {}


def test_repair_of_one_hot_conversation_among_many(spark):
    rng = random.Random(8)
    line = lambda: rng.choice(["Yes.", "No!", "", "go on", "Why?", f"t{rng.randrange(999)}."])
    rows = [(0, rng.randrange(900), rng.choice(["user", "assistant"]), line()) for _ in range(1500)]
    rows += [(rng.randrange(1, 400), rng.randrange(8), rng.choice(["user", "assistant", "system"]), line()) for _ in range(2500)]
    assert repaired(spark, rows) == plain_repair(rows)


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B? C!") for c in range(40) for t in range(8)] + [(None, None, None, None), (None, 3, None, "x.")]
    got = {}
    for r in turnrepair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        one = ("user" if kind == 4 else role, "" if kind == 1 else text.translate({46: None, 33: None, 63: None}) if kind == 2 else text)
        assert got.get((c, t), []) == [one] * {0: 0, 3: 2}.get(kind, 1)
    kept = spark.createDataFrame([(9, 1, "user", "gone")], "conv_id long, turn long, role string, text string")
    none = turnrepair.repair_all(kept, kept.where(F.lit(False))).first()
    assert tuple(none[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
