"""Quality rules: repetition rules and perplexity bands of a byte n-gram language model.

The model is a modified Kneser-Ney model over the bytes of the running text, of order 5: words with one end mark
after each, so n-grams cross from word to word and the order of words counts. Spark counts the n-grams of all texts
(as codes of stretches of bounded size, summed inside a task, so what is shuffled is about a row per n-gram and task);
lower orders count distinct left extensions. An n-gram's code is its bytes packed into one integer, a hash without
collisions; the model is a set of arrays sorted by code. Every n-gram is kept, also those seen once, so the model grows
with the number of distinct n-grams: it is built in the driver and each worker holds a copy.

A text's score is its mean negative log probability per byte. Each language has a band around the median of its
own scores, as many robust deviations wide on either side as stated, and wider for short texts, whose means vary
more; a text outside its band is rejected. The deviation comes from the 10th and 90th percentile, so a third of
equal rows does not close the band.

Cases: a null text has no words; a text without words has no score and fails the base rule; a null language is
a language of its own; a language whose scores all agree has the least band width; repeated rows are scored each
for itself and count as often as they occur; an empty table gives an empty table. Only the key, text and language
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.session import cut_lineage

ORDER = 5
#: Bytes of text whose codes are made at once, and distinct codes a task holds while counting.
STRETCH, MAX_CODES = 1 << 20, 2_000_000
#: Rows whose texts are held at once in a worker.
ROWS = 512
START, END = b" ", b"\n"  # neither occurs in a word
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Band: width below and above the median in robust deviations, the least deviation, and how many more deviations
#: a text of one byte gets (falling with the square root of its length, as the error of a mean does).
BAND = {"below": 2.0, "above": 2.0, "least": 0.015, "slack": 60.0}


# ---- n-grams ------------------------------------------------------------------------------------

def running(words: list[bytes]) -> bytes:
    """The text that n-grams run over: START before it, END after each word; empty without words."""
    return START * (ORDER - 1) + END.join(words) + END if words else b""


def stretches(texts: Iterable[bytes]):
    """Lists of (number of the text, part of it), of about ``STRETCH`` bytes; parts of a text overlap by a context."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - (ORDER - 1), STRETCH):
            part = t[at:at + STRETCH + ORDER - 1]
            held.append((i, part))
            size += len(part)
            if size >= STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def slide(parts: list[bytes]):
    """Codes of all n-grams inside the parts, and their number per part."""
    import numpy as np
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    codes = np.zeros(len(raw), dtype=np.int64)
    for back in range(ORDER):
        codes[back:] |= raw[:len(raw) - back].astype(np.int64) << (8 * back)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    own = np.ones(len(raw), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    for back in range(ORDER - 1):
        own[starts + back] = False
    return codes[own], sizes - (ORDER - 1)


def count_ngrams(df: DataFrame, text: str, running_text: bool = False) -> DataFrame:
    """(code, n): n-grams of the highest order over all words of all texts, each alone or in the running text."""

    def run(batches):
        import numpy as np

        def table(codes, counts):
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

        def merged(codes, counts):
            order = np.argsort(codes, kind="stable")  # of sorted runs
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
            return [codes[first], np.add.reduceat(counts, first)]

        def texts(batch):
            """One at a time: the words of a whole batch take some twenty times its bytes."""
            for v in batch.column(text):
                words = (v.as_py() or "").encode().split()
                yield from [running(words)] if running_text else (running([x]) for x in words)

        held = [np.zeros(0, dtype=np.int64)] * 2
        for batch in batches:
            for some in stretches(texts(batch)):
                codes, counts = np.unique(slide([part for _, part in some])[0], return_counts=True)
                held = [np.concatenate(x) for x in zip(held, (codes, counts))]
                if len(held[0]) > MAX_CODES:
                    held = merged(*held)
                    if len(held[0]) > MAX_CODES // 2:
                        yield table(*held)
                        held = [np.zeros(0, dtype=np.int64)] * 2
        if len(held[0]):
            yield table(*held)

    made = df.select(text).mapInArrow(run, "code bigint, n bigint")
    return made.groupBy("code").agg(F.sum("n").alias("n"))


# ---- model ---------------------------------------------------------------------------------------

def discounts(counts_of_counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    n = [max(c, 1) for c in counts_of_counts]
    y = n[0] / (n[0] + 2 * n[1])
    made = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(d, 0.1), k - 0.1) for k, d in zip((1, 2, 3), made))


def build_model(codes, counts, top: list[int]) -> list[dict]:
    """Arrays per order, lowest first: code, logp (interpolated), ctx, backoff. ``top``: counts of counts of the highest order."""
    import numpy as np
    levels = [None] * ORDER
    at = np.argsort(codes)
    code, count = codes[at], counts[at].astype(np.float64)
    for k in range(ORDER, 0, -1):
        levels[k - 1] = (code, count)
        code, count = np.unique(code & ((1 << 8 * (k - 1)) - 1), return_counts=True) if k > 1 else (None, None)
        count = count.astype(np.float64) if count is not None else None
    model: list[dict] = []
    for k, (code, count) in enumerate(levels, start=1):
        seen = top if k == ORDER else [int((count == c).sum()) for c in (1, 2, 3, 4)]
        cut = np.array([0.0, *discounts(seen)])[np.minimum(count, 3).astype(int)]
        ctx, place = np.unique(code >> 8, return_inverse=True)
        total = np.bincount(place, weights=count)
        backoff = np.bincount(place, weights=cut) / total
        lower = np.exp(log_prob(model, code & ((1 << 8 * (k - 1)) - 1))) if k > 1 else np.full(len(code), 1 / 256)
        p = (count - cut) / total[place] + backoff[place] * lower
        model.append({"code": code, "logp": np.log(p), "ctx": ctx, "backoff": np.log(backoff)})
    return model


def _find(keys, wanted):
    import numpy as np
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)


def log_prob(model: list[dict], codes):
    """Log probability of the last byte of each code given the bytes before it."""
    import numpy as np
    out = np.zeros(len(codes))
    left = np.arange(len(codes))
    for k in range(len(model), 0, -1):
        level, code = model[k - 1], codes[left] & ((1 << 8 * k) - 1)
        at, hit = _find(level["code"], code)
        out[left[hit]] += level["logp"][at[hit]]
        left, code = left[~hit], code[~hit]
        at, known = _find(level["ctx"], code >> 8)
        out[left[known]] += level["backoff"][at[known]]
    out[left] += math.log(1 / 256)
    return out


def fit(df: DataFrame, text: str) -> list[dict]:
    """The model of all texts: what reaches the driver is one row of 16 bytes per distinct n-gram."""
    import numpy as np
    counted = cut_lineage(count_ngrams(df, text, running_text=True))
    seen = counted.agg(*[F.count(F.when(F.col("n") == c, 1)).alias(f"c{c}") for c in (1, 2, 3, 4)]).first()
    whole = counted.toArrow()
    codes, counts = (whole.column(c).to_numpy() for c in ("code", "n"))
    return build_model(codes.astype(np.int64), counts, [seen[f"c{c}"] for c in (1, 2, 3, 4)])


# ---- texts ---------------------------------------------------------------------------------------

def repeated_words(ids) -> int:
    """Words inside 8-word windows that occur twice or more in the text."""
    import numpy as np
    if len(ids) <= WINDOW:
        return 0
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.zeros(len(ids) - WINDOW + 1, dtype=np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + mixed[j:j + len(h)]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(h, twice).astype(np.int64)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:len(h)] += starts
    edge[WINDOW:] -= starts
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_repeats(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


SCORES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, log_prob double, n_bytes bigint"


def score(df: DataFrame, key: str, text: str, lang: str, model: list[dict]) -> DataFrame:
    """Per row: key, lang, the counts of the base rule, log_prob and n_bytes of its words."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = dict(df.dtypes)

    def run(batches):
        import numpy as np
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                rows, texts, sizes = [], [], []
                for t in batch.column(text).to_pylist():
                    t = t or ""
                    raw = t.encode()
                    words = raw.split()
                    names: dict[bytes, int] = {}
                    own = np.fromiter([names.setdefault(w, len(names)) for w in words], dtype=np.int64, count=len(words))
                    blank = sum(map(t.count, SPACES))
                    rows.append((len(words), len(t) - blank, sum(map(t.count, SYMBOLS)), line_repeats(t), repeated_words(own)))
                    sizes.append(len(raw) - blank + len(words))
                    texts.append(running(words))
                totals = np.zeros(len(rows))
                for some in stretches(texts):
                    codes, each = slide([part for _, part in some])
                    found, place = np.unique(codes, return_inverse=True)
                    sums = np.add.reduceat(log_prob(shared.value, found)[place], np.cumsum(each) - each)
                    np.add.at(totals, [i for i, _ in some], sums)
                made = list(zip(*rows)) if rows else [()] * 5
                columns = [batch.column(key), batch.column(lang), *[pa.array(c, type=pa.int64()) for c in made],
                           pa.array(totals), pa.array(sizes, type=pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, lang, *[x.split()[0] for x in SCORES.split(", ")]])

    return df.select(key, lang, text).mapInArrow(run, f"`{key}` {kinds[key]}, `{lang}` {kinds[lang]}, {SCORES}")


def bands(scored: DataFrame, lang: str, least: float) -> DataFrame:
    """Per language (_lang): median _mid and robust deviation _dev of the mean negative log probability."""
    x = F.when(F.col("n_bytes") > 0, -F.col("log_prob") / F.col("n_bytes"))
    rows = scored.select(F.col(lang).alias("_lang"), x.alias("x")).where("x IS NOT NULL")
    q = F.percentile_approx("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), 10_000)
    mid = rows.groupBy("_lang").agg(q.alias("q"))
    return mid.select("_lang", F.col("q")[1].alias("_mid"),
                      F.greatest((F.col("q")[2] - F.col("q")[0]) / F.lit(2.563), F.lit(least)).alias("_dev"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def judge(docs: DataFrame, key: str, text: str, lang: str, below: float = BAND["below"], above: float = BAND["above"],
          least: float = BAND["least"], slack: float = BAND["slack"]) -> DataFrame:
    """Per row: key, lang, the counts, perplexity, base_failed, kept."""
    scored = cut_lineage(score(docs, key, text, lang, fit(docs, text)))
    n = F.nullif(F.col("n_bytes"), F.lit(0))
    x = -F.col("log_prob") / n
    off = (x - F.col("_mid")) / F.col("_dev")
    more = F.lit(slack) / F.sqrt(n)
    inside = F.coalesce((off >= -(F.lit(below) + more)) & (off <= F.lit(above) + more), F.lit(False))
    joined = scored.join(bands(scored, lang, least), F.col(lang).eqNullSafe(F.col("_lang")), "left")
    return (joined.withColumn("perplexity", F.exp(x))
            .withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)
            .drop("_lang", "_mid", "_dev", "log_prob", "n_bytes"))
