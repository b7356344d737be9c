"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is a word in lower case, without punctuation at its ends, between spaces and behind a carrier that both
dictionaries end with; letters are two bytes wide, so that a match pays even for a short word. Its value is how
many bytes shorter the toxic dictionary makes it. Both dictionaries share a body of ordinary words; the toxic one
adds words of toxic texts that hold a run of letters (from a word's start) that is far more frequent there than in
ordinary texts, the ordinary one adds as many bytes of other ordinary words. A text's features are its largest
window value and the sum of its three largest; a logistic curve, calibrated on a fold of its own, makes the score.

Only labelled rows outside the held-out fold are learned from, at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` of
them, by hash order, of at most ``ROW_CHARS`` characters each; near copies among them are used once. Labels,
languages, sources and ids are no inputs of a score. Every text is scored whole.

Cases: a null or empty text has no windows and gets the curve's value at zero; without labelled rows of both
classes every score is 0; a label that is null is not used, and an id labelled twice is learned from once;
repeated rows are scored each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.llm.workers import cached

TOXIC_ROWS, ORDINARY_ROWS, ROW_CHARS = 3000, 6000, 16_384
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
BODY_WORDS, LEVEL, RUN = 12_000, 12, 4
#: Words of a run, and minima, by which near copies of the sample are found; how much likelier a word must be in toxic texts.
COPY_WORDS, COPY_MINIMA, TIMES = 5, 4, 3
MAX_WORDS = 500_000
STRIP = b".,;:!?*$%&#|\"'()[]"
CARRIER = "0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_of(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


def words_of(text: str) -> list[bytes]:
    return [w for w in (x.strip(STRIP) for x in text.lower().encode().split()) if w]


def _starts(word: str) -> set[str]:
    return {word[:k] for k in range(RUN, min(len(word), 12) + 1)} | {word + " "}


def _runs(word: str) -> set[str]:
    return {word[i:i + RUN] for i in range(len(word) - RUN + 1)}


def _tail(hits: int, n: int, share: float) -> float:
    """Chance of at least ``hits`` of ``n`` at ``share``; a normal bound for large n."""
    if n > 300:
        z = (hits - n * share) / math.sqrt(n * share * (1 - share))
        return 0.5 * math.erfc(z / math.sqrt(2))
    return sum(math.comb(n, k) * share ** k * (1 - share) ** (n - k) for k in range(hits, n + 1))


def distinct_texts(texts: list[str]) -> list[str]:
    """``texts`` without those that share a minimum of their five-word runs with an earlier one."""
    import xxhash
    seen, out = set(), []
    for t in texts:
        words = t.split()
        runs = {" ".join(words[i:i + COPY_WORDS]) for i in range(max(1, len(words) - COPY_WORDS + 1))}
        own = {(seed, min(xxhash.xxh3_64_intdigest(r, seed) for r in runs)) for seed in range(COPY_MINIMA)}
        if not own & seen:
            out.append(t)
        seen |= own
    return out


def telling_words(toxic: list[str], ordinary: list[str]) -> tuple[list[str], list[str]]:
    """Words for the toxic dictionary, least frequent first, and other words of ordinary texts, in a fixed mixed order."""
    sets = [[{w.decode(errors="ignore") for w in words_of(t)} for t in texts] for texts in (toxic, ordinary)]
    bad, good = (Counter(s for own in side for s in set().union(*map(_starts, own))) for side in sets)
    share = len(toxic) / (len(toxic) + len(ordinary))
    # rates are compared, so the outcome does not hang on how many texts of each class the sample has room for
    often = lambda s, n: n * len(ordinary) > TIMES * good[s] * len(toxic)
    telling = {s for s, n in bad.items() if n >= 4 and often(s, n) and _tail(n, n + good[s], share) < 1e-7}
    chosen = Counter(w for own in sets[0] for w in own if _starts(w) & telling)
    body = {w for own in sets[1] for w in own if not _starts(w) & telling}
    import xxhash
    return ([w for w, _ in sorted(chosen.items(), key=lambda x: (x[1], x[0]))],
            sorted(body, key=lambda w: (xxhash.xxh3_64_intdigest(w.encode()), w)))


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> dict | None:
    """Contents of the two dictionaries, and the runs of letters that the toxic one adds."""
    chosen, body = telling_words(distinct_texts(toxic), distinct_texts(ordinary))
    if not chosen or not body:
        return None
    wide = lambda words: (" " + " ".join(words) + " ").encode("utf-16-le")
    extra, other, size = wide(chosen), [], 0
    for w in body[BODY_WORDS:] or body:
        if size >= len(extra):
            break
        other.append(w)
        size += 2 * len(w) + 2
    shared, carrier = wide(body[:BODY_WORDS]), CARRIER.encode("utf-16-le")
    return {"toxic": shared + extra + carrier, "ordinary": shared + wide(other) + carrier,
            "runs": frozenset().union(*map(_runs, chosen))}


class Windows(dict):
    """Window value by word. A word without a run of four letters of the toxic words has nothing to match: 0."""

    def __init__(self, trained: dict):
        import zstandard
        self.runs, self.carrier = trained["runs"], CARRIER.encode("utf-16-le")

        def make(content: bytes):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.toxic, self.ordinary = make(trained["toxic"]), make(trained["ordinary"])

    def __missing__(self, word: bytes) -> int:
        text = word.decode(errors="ignore")
        value = 0
        if any(text[i:i + RUN] in self.runs for i in range(len(text) - RUN + 1)):
            window = self.carrier + f" {text} ".encode("utf-16-le")
            value = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        self[word] = value
        return value

    def features(self, text: str) -> tuple[float, float]:
        if len(self) > MAX_WORDS:
            self.clear()
        top = sorted(map(self.__getitem__, words_of(text)), reverse=True)[:3]
        return float(max(top[0], 0)) if top else 0.0, float(sum(v for v in top if v > 0))


def calibrate(rows: list[tuple[float, float]], labels: list[int], weights: list[float]) -> list[float]:
    """Logistic curve over the features by Newton steps with a small ridge; a row counts by its weight."""
    import numpy as np
    x = np.column_stack([np.ones(len(rows)), np.array(rows, dtype=float)])
    y, v, w = np.array(labels, dtype=float), np.array(weights, dtype=float), np.zeros(x.shape[1])
    v = v * len(v) / v.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (v * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w)), x.T @ (v * (y - p)) - 1e-3 * w)
        w = w + step
        if abs(step).max() < 1e-9:
            break
    return w.tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> list[tuple[int, int, str, float]]:
    """(fold, label, text, weight): a bounded sample of the labelled rows outside the held-out fold.

    A row's weight is how many labelled rows of its class it stands for, so scores follow the true share of toxic texts
    however many rows of a class the sample holds.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold_of(F.col(key)) != HELD_OUT))
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("y"))
    order = F.md5(F.col(key).cast("string").cast("binary"))
    parts = [known.where(F.col("y") == y).orderBy(order).limit(n) for y, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    ids = parts[0].union(parts[1])  # at most TOXIC_ROWS + ORDINARY_ROWS rows of two numbers
    texts = docs.select(key, F.col(text).alias("t")).where((F.length("t") > 0) & (F.length("t") <= ROW_CHARS))
    rows = texts.join(F.broadcast(ids), key).groupBy(key).agg(F.max("y").alias("y"), F.min("t").alias("t"))
    got = rows.select(fold_of(F.col(key)).alias("f"), "y", "t", order.alias("o")).toPandas().sort_values("o")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two classes
    return [(int(f), int(y), t, total[y] / n) for f, y, t, n in zip(got["f"], got["y"], got["t"], got.groupby("y")["t"].transform("size"))]


def fit(sample: list[tuple[int, int, str, float]]) -> dict | None:
    """Dictionaries from the sample's other folds, curve from its calibration fold; None when a class is missing."""
    side = lambda y: [t for f, v, t, _ in sample if f != CALIBRATION and v == y]
    trained = train_dictionaries(side(1), side(0)) if side(1) and side(0) else None
    tests = [(v, t, w) for f, v, t, w in sample if f == CALIBRATION]
    if trained is None or len({v for v, _, _ in tests}) < 2:
        return None
    windows = Windows(trained)
    return trained | {"curve": calibrate([windows.features(t) for _, t, _ in tests], [v for v, _, _ in tests], [w for _, _, w in tests])}


def score(docs: DataFrame, key: str, text: str, model: dict | None, out: str = "score") -> DataFrame:
    """(key, score) of every row."""
    if model is None:
        return docs.select(key, F.lit(0.0).alias(out))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        a, b, c = shared.value["curve"]
        windows = cached(("toxicity", hash(shared.value["toxic"])), lambda: Windows(shared.value))
        for batch in batches:
            made = []
            for value in batch.column(text).to_pylist():
                most, three = windows.features(value or "")
                made.append(1 / (1 + math.exp(-max(min(a + b * most + c * three, 30.0), -30.0))))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(made, type=pa.float64())], names=[key, out])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, `{out}` double")
