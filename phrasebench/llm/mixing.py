"""Temperature mixing of sources to target weights, in DataFrame expressions only.

A source with token share p gets weight p**a / sum(p**a). The exponent a is bisected on a grid of 2**-25: the
largest a whose weights reach the target entropy (a share of the greatest possible one), raised where needed to
the smallest a at which no source is repeated more than the limit. Weights times the budget give each source's
tokens. A source is passed in epochs; every epoch is a new permutation of its rows, by md5 of seed, epoch and id;
the last epoch ends before the row that would exceed the source's tokens. The drawn stream of each source is dealt
over blocks of equal budget, so every block has the target weights; inside a block rows stand in hash order.

Cases: a null source is a source of its own; a null text has no tokens; a source without tokens gets no share and
is not drawn; rows with equal ids stand together (all are drawn, or none) in a permutation; an empty table gives
an empty table; further columns are carried through, except names starting with ``_mix``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phrasebench.session import cut_lineage

#: Bisections of the exponent, and how many of them one pass over the totals makes.
STEPS, STEPS_A_PASS = 25, 5
#: Rows that share a key while positions are summed; a hot source is spread over so many keys.
ROWS_A_KEY = 256
#: Keys that are summed together before their sums are.
KEYS_A_GROUP = 1024
#: Source tables up to this many rows (about 100 bytes each) are broadcast.
BROADCAST_ROWS = 10_000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    """Text key under which a null source joins like any other."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _bisect(totals: DataFrame, holds) -> int:
    """Largest step k in 0..2**STEPS for which ``holds`` (true first, then false) is true, -1 if none.

    ``holds`` takes the exponent, sum and log-sum columns. One pass tests 2**STEPS_A_PASS points: so many
    bisections at once, each an aggregate over the sources.
    """
    lo, hi = -1, (1 << STEPS) + 1
    while hi - lo > 1:
        gap = max(1, (hi - lo) >> STEPS_A_PASS)
        points = list(range(lo + gap, hi, gap))
        grid = totals.select("p", F.explode(F.array(*[F.lit(k) for k in points])).alias("k"))
        q = F.pow(F.col("p"), F.col("k") / F.lit(float(1 << STEPS)))
        sums = grid.groupBy("k").agg(F.sum(q).alias("z"), F.sum(q * F.log(q)).alias("s"), F.min("p").alias("least"))
        good = {r["k"] for r in sums.where(holds(F.col("k") / F.lit(float(1 << STEPS)), F.col("z"), F.col("s"), F.col("least"))).select("k").collect()}
        first_bad = next((k for k in points if k not in good), None)
        lo, hi = (first_bad - gap, first_bad) if first_bad is not None else (points[-1], hi)
    return lo


def exponent(totals: DataFrame, entropy_share: float | None, max_repetition: float | None,
             budget_share: float | None) -> float:
    """The exponent for a table of shares ``p``.

    ``entropy_share``: entropy wanted, as a share of log(number of sources). ``max_repetition``: passes over a
    source at most. ``budget_share``: budget over all tokens; None when the budget is what passes every source
    at least once, so that the largest number of passes is (greatest share / least share)**(1 - a).
    """
    n, most = totals.agg(F.count("*").alias("n"), F.max("p").alias("m")).first()
    step = 1 << STEPS
    if entropy_share is not None and n > 1:
        want = F.log(F.lit(float(n))) * F.lit(entropy_share)
        step = max(0, _bisect(totals, lambda a, z, s, least: F.log(z) - s / z >= want))
    if max_repetition is not None and n > 0:
        def too_often(a, z, s, least):
            passes = (F.pow(least, a - 1) / z * F.lit(budget_share) if budget_share is not None
                      else F.pow(F.lit(most) / least, 1 - a))
            return passes > F.lit(max_repetition)
        low = _bisect(totals, too_often) + 1
        step = max(step if entropy_share is not None else 0, min(low, 1 << STEPS))
    return step / (1 << STEPS)


def weights(docs: DataFrame, source: str, tokens: Column, entropy_share: float | None = None,
            max_repetition: float | None = None, budget_share: float | None = 1.0) -> DataFrame:
    """Per source with tokens: _mix_source, _mix_tokens, _mix_weight, _mix_target (tokens to draw)."""
    counted = docs.select(source_key(source).alias("_mix_source"), tokens.alias("t"))
    totals = cut_lineage(counted.groupBy("_mix_source").agg(F.sum("t").alias("_mix_tokens")).where("_mix_tokens > 0"))
    whole = totals.agg(F.sum("_mix_tokens")).first()[0] or 0
    shares = totals.withColumn("p", F.col("_mix_tokens") / F.lit(float(max(whole, 1))))
    a = exponent(shares, entropy_share, max_repetition, budget_share)
    q = F.pow(F.col("p"), F.lit(a))
    z, scale = shares.agg(F.sum(q), F.max(F.col("p") / q)).first()
    budget = float(whole) * (budget_share if budget_share is not None else (scale or 0.0) * (z or 0.0))
    weight = q / F.lit(z or 1.0)
    return shares.select("_mix_source", "_mix_tokens", weight.alias("_mix_weight"),
                         F.round(weight * F.lit(budget)).cast("long").alias("_mix_target"))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Equi-join on the source; the source side is broadcast when its counted rows are few."""
    if sources.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sources = F.broadcast(sources)
    return rows.join(sources, "_mix_source")


def order_key(key: str, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def _placed(rows: DataFrame, key: str, tokens: str, seed: int) -> DataFrame:
    """Adds _mix_key (place in the permutation) and _mix_end (tokens of the epoch up to this row).

    Sums are taken inside (source, epoch, hash range), then over ranges, then over groups of ranges, so no key
    holds more than about ROWS_A_KEY rows however hot the source is.
    """
    rows = rows.withColumn("_mix_key", order_key(key, F.col("_mix_epoch"), seed))
    ranges = max(1, -(-rows.count() // ROWS_A_KEY))
    number = F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_mix_range", F.floor(number * F.lit(ranges) / F.lit(float(1 << 32))))
    by = ["_mix_source", "_mix_epoch"]
    sums = rows.groupBy(*by, "_mix_range").agg(F.sum(tokens).alias("s"))
    sums = sums.withColumn("g", F.floor(F.col("_mix_range") / F.lit(KEYS_A_GROUP)))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    groups = sums.groupBy(*by, "g").agg(F.sum("s").alias("gs")).withColumn(
        "g0", F.coalesce(F.sum("gs").over(before(W.partitionBy(*by).orderBy("g"))), F.lit(0)))
    sums = sums.withColumn("r0", F.coalesce(F.sum("s").over(before(W.partitionBy(*by, "g").orderBy("_mix_range"))), F.lit(0)))
    starts = sums.join(groups.select(*by, "g", "g0"), [*by, "g"]).select(*by, "_mix_range", (F.col("g0") + F.col("r0")).alias("r0"))
    inside = F.sum(tokens).over(W.partitionBy(*by, "_mix_range").orderBy("_mix_key"))  # equal keys share one sum
    return (rows.join(starts, [*by, "_mix_range"]).withColumn("_mix_end", F.col("r0") + inside)
            .drop("r0", "_mix_range"))


def _copies(rows: DataFrame) -> DataFrame:
    """One row per begun epoch."""
    last = F.floor(F.col("_mix_target") / F.col("_mix_tokens"))
    return rows.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))


def draw(docs: DataFrame, key: str, source: str, tokens: Column, sources: DataFrame, seed: int = 42) -> DataFrame:
    """All columns of ``docs``, one row per drawn copy, plus ``_mix_epoch``.

    The last row of each source's last epoch is found on narrow rows; then every row of ``docs`` decides by its
    own key, so texts are not shuffled.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("_mix")])
    narrow = docs.select(key, source_key(source).alias("_mix_source"), tokens.alias("_mix_n"))
    left = sources.select("_mix_source", F.floor(F.col("_mix_target") / F.col("_mix_tokens")).alias("_mix_epoch"),
                          (F.col("_mix_target") % F.col("_mix_tokens")).alias("rest")).where("rest > 0")
    placed = _placed(_with_sources(narrow, left), key, "_mix_n", seed)
    cuts = placed.where("_mix_end <= rest").groupBy("_mix_source").agg(F.max("_mix_key").alias("_mix_cut"))
    plan = cut_lineage(sources.join(cuts, "_mix_source", "left").select(
        "_mix_source", F.floor(F.col("_mix_target") / F.col("_mix_tokens")).alias("_mix_full"), "_mix_cut"))
    rows = _with_sources(docs.withColumn("_mix_source", source_key(source)), plan)
    part = F.col("_mix_cut").isNotNull() & (order_key(key, F.col("_mix_full"), seed) <= F.col("_mix_cut"))
    n = F.col("_mix_full") + part.cast("long")
    epochs = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.expr("CAST(array() AS ARRAY<BIGINT>)"))
    return rows.withColumn("_mix_epoch", F.explode(epochs)).drop("_mix_source", "_mix_full", "_mix_cut")


def mix(docs: DataFrame, key: str, source: str, tokens: Column, sources: DataFrame, block_tokens: int,
        seed: int = 42) -> DataFrame:
    """The drawn order as narrow rows: key, source, tokens, epoch, block, order_key.

    ``block_tokens``: budget of a block. Sorting by block and order_key gives the mixed stream.
    """
    narrow = docs.select(key, F.col(source).alias("source"), source_key(source).alias("_mix_source"), tokens.alias("tokens"))
    placed = _placed(_copies(_with_sources(narrow, sources)), key, "tokens", seed)
    whole = F.col("_mix_epoch") < F.floor(F.col("_mix_target") / F.col("_mix_tokens"))
    kept = placed.where(whole | (F.col("_mix_end") <= F.col("_mix_target") % F.col("_mix_tokens")))
    total = sources.agg(F.sum("_mix_target")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    at = (F.col("_mix_epoch") * F.col("_mix_tokens") + F.col("_mix_end") - F.col("tokens")).cast("double")
    block = F.least(F.floor(at / F.greatest(F.col("_mix_target"), F.lit(1)).cast("double") * F.lit(float(blocks))), F.lit(blocks - 1))
    return kept.select(key, "source", "tokens", F.col("_mix_epoch").alias("epoch"), block.cast("long").alias("block"),
                       F.col("_mix_key").alias("order_key"))
