"""Lexical top-k search over postings by term, with exact block-max pruning.

Documents are laid out by length, which orders them by impact, and cut into ranges of bounded size. A block is the
postings of one term in one range, heaviest first; a table of its own has every block's largest BM25 and cosine weight.
Both are stored in folders by a hash of the term. A search reads only the folders of its terms:

1. From the blocks' maxima alone (no postings are read) every range gets an upper bound for each query.
2. The ranges with the best bounds are scored in full; the k-th score found is the query's threshold.
3. Of the other ranges only those whose bound reaches the threshold are scored. Nothing that could enter the first k
   is left out, so the result is that of scoring all pairs.

A task scores a range for a chunk of queries and hands on at most ``k`` rows a query and goal. A goal is what a list is
ranked by: BM25, cosine, or both scaled and fused; one pass serves several goals. No table of all pairs is written.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phrasebench.fixed import EPSILON, K1, B
from phrasebench.functions.numeric import bm25_weight, minmax_scale, r6
from phrasebench.operators.ordering import running_sums, top_k_per
from phrasebench.session import bucket_count, cut_lineage

# the scoring function travels with the job, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A range ends at so many units; a document is one unit and one more for every ``UNIT_TOKENS`` tokens.
RANGE_UNITS, UNIT_TOKENS = 8192, 512
FILE_RANGES = 64
#: Queries that share a copy of a range's blocks; ranges scored before the threshold is known.
QUERY_ROWS, FIRST = 4096, 2
#: Bytes that a term of a query takes where it is weighed.
TERM_BYTES = 100
#: What rounding to six places can add to a bound.
ROUNDING = 2e-6


@dataclass(frozen=True)
class Goal:
    """What a list is ranked by: ``weight`` · dense + (1 - weight) · lexical, scaled by the query's ranges or plain."""

    weight: float
    scaled: bool = False

    def column(self, dense: Column, lexical: Column) -> Column:
        if self.scaled:
            dense, lexical = minmax_scale(dense, "lo_dense", "hi_dense"), minmax_scale(lexical, "lo_lexical", "hi_lexical")
        if self.weight in (0.0, 1.0):
            return dense if self.weight else lexical
        return r6(F.lit(self.weight) * dense + F.lit(1 - self.weight) * lexical)


DENSE, LEXICAL = Goal(1.0), Goal(0.0)
LIMITS = ["lo_dense", "hi_dense", "lo_lexical", "hi_lexical"]


# ---- layout --------------------------------------------------------------------------------------

def number_of(term: Column | str, seed: int) -> Column:
    """A term's number, a 64-bit hash; an index takes a seed under which all its terms have different numbers."""
    return F.xxhash64(F.lit(seed), term)


def part_of(number: Column | str, parts: int) -> Column:
    return F.pmod(number, F.lit(parts)).cast("int")


def place_documents(lengths: DataFrame, range_units: int = RANGE_UNITS) -> DataFrame:
    """(doc_id, range, slot): documents by length, cut into ranges; slots of a range follow the ids."""
    units = lengths.withColumn("_u", F.lit(1) + F.floor(F.col("dl") / UNIT_TOKENS))
    run = running_sums(units, [F.col("dl"), F.col("doc_id")], {"_u": "_sum"})
    ranged = run.select("doc_id", F.floor((F.col("_sum") - F.col("_u")) / F.lit(range_units)).cast("int").alias("range"))
    return ranged.withColumn("slot", F.row_number().over(W.partitionBy("range").orderBy("doc_id")) - 1)


def weighted(rows: DataFrame, facts: dict, avg_length: float, k1: float = K1, b: float = B) -> DataFrame:
    """(part, number, range, slot, w, c) from rows (term, tf, dl, norm, range, slot).

    ``w`` is the BM25 weight without idf, ``c`` the share of the document's tf-idf vector; idf comes with the query.
    """
    w = bm25_weight("tf", "dl", F.lit(1.0), F.lit(avg_length), k1, b)
    numbered = rows.withColumn("number", number_of("term", facts["seed"]))
    return numbered.select(part_of(F.col("number"), facts["parts"]).alias("part"), "number", "range", "slot", w.alias("w"),
                           (F.col("tf") / F.col("norm")).alias("c"))


#: What the first row of a block has beside its posting: the block's postings, largest BM25 and largest cosine weight.
TOPS = ["n", "top_w", "top_c"]


def store_blocks(rows: DataFrame, root: str, files: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, tops): the postings by part, number and range, and (part, number, range, n, top_w, top_c) of every block.

    One shuffle for both; a part takes a file for every ``FILE_RANGES`` ranges, so a term of all documents is spread over
    many. Maxima lie in columns of their own, set in a block's first row only: bounds are read without the postings.
    """
    keyed = rows.withColumn("_files", F.floor(F.col("range") / F.lit(FILE_RANGES)))
    block = W.partitionBy("part", "_files", "number", "range")  # as the rows are dealt out, so without a further shuffle
    heaviest = block.orderBy(F.desc("w"), "slot")
    ordered = keyed.repartition(files, "part", "_files").withColumn("_first", F.row_number().over(heaviest) == 1)
    made = {"n": F.count("*").over(block), "top_w": F.max("w").over(block), "top_c": F.max("c").over(block)}
    ordered = ordered.withColumns({c: F.when(F.col("_first"), v) for c, v in made.items()})
    ordered.select(*rows.columns, *TOPS).write.mode("overwrite").partitionBy("part").parquet(f"{root}/blocks")
    return open_blocks(rows.sparkSession, f"{root}/blocks", {f.name: f.dataType.simpleString() for f in rows.schema})


def open_blocks(spark, path: str, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``blocks`` and ``tops`` of the files that ``store_blocks`` wrote; ``kinds``: types of the postings' columns."""
    stored = ", ".join(f"{c} {t}" for c, t in {**kinds, "n": "bigint", "top_w": "double", "top_c": "double"}.items())
    rows, heads = (spark.read.schema(stored).parquet(path) for _ in range(2))  # joined with each other, so opened apart
    return rows.select(*kinds), heads.where(F.col("n").isNotNull()).select("part", "number", "range", *TOPS)


# ---- queries -------------------------------------------------------------------------------------

class Asked:
    """Weighted terms of all queries, and the blocks that hold them."""

    def __init__(self, counts: DataFrame, index):
        """``counts``: (query_id, term, qf)."""
        self.index = index
        facts = index.facts
        counts = cut_lineage(counts.withColumn("part", part_of(number_of("term", facts["seed"]), facts["parts"])))
        self.parts = sorted(r["part"] for r in counts.select("part").distinct().collect())  # at most ``parts`` numbers
        known = index.terms.where(F.col("part").isin(self.parts))
        idf = F.when(F.col("raw_idf") < 0, F.lit(EPSILON * (facts["mean_idf"] or 0.0))).otherwise(F.col("raw_idf"))
        rows = counts.select("query_id", "term", "qf").join(known.select("term", "number", idf.alias("idf"), "smooth_idf"), "term")
        own = F.col("qf") * F.col("smooth_idf")
        norm = F.sqrt(F.sum(own * own).over(W.partitionBy("query_id")))
        # terms of a query meet in tasks of bounded size, however many queries there are
        self.tasks = bucket_count(counts.sparkSession, TERM_BYTES * counts.count())
        rows = rows.repartition(self.tasks, "query_id")
        self.terms = cut_lineage(rows.select(
            "query_id", "number", (F.col("qf") * F.col("idf")).alias("ql"), (own * F.col("smooth_idf") / norm).alias("qd")))
        lists = F.sort_array(F.collect_list(F.struct("number", "ql", "qd")))  # a query's own terms
        self.lists = self.terms.groupBy("query_id").agg(lists.alias("e")).select(
            "query_id", F.col("e.number").alias("numbers"), F.col("e.ql").alias("ql"), F.col("e.qd").alias("qd"))
        queries = self.terms.agg(F.count_distinct("query_id")).first()[0]
        cores = self.terms.sparkSession.sparkContext.defaultParallelism
        wanted = min(-(-queries // 64), -(-2 * cores // max(1, index.facts["ranges"])))
        self.chunks = max(1, -(-queries // QUERY_ROWS), wanted)

    def of_parts(self, table: DataFrame) -> DataFrame:
        return table.where(F.col("part").isin(self.parts))

    def bounds(self) -> DataFrame:
        """(query_id, range, up_dense, up_lexical, cover): what a range's rows can score at most, and the postings it has."""
        tops = self.of_parts(self.index.tops).select("number", "range", "n", "top_w", "top_c")
        up = lambda q, top: F.sum(F.greatest(F.col(q) * F.col(top), F.lit(0.0)))
        return self.terms.join(tops, "number").groupBy("query_id", "range").agg(
            (up("qd", "top_c") + F.lit(ROUNDING)).alias("up_dense"), (up("ql", "top_w") + F.lit(ROUNDING)).alias("up_lexical"),
            F.sum("n").alias("cover"))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _goal_scores(goal: Goal, dense: np.ndarray, lexical: np.ndarray, limits: tuple) -> np.ndarray:
    if goal.scaled:
        lo_d, hi_d, lo_l, hi_l = limits
        dense = (dense - lo_d) / (hi_d - lo_d) if hi_d - lo_d >= 1e-12 else np.zeros_like(dense)
        lexical = (lexical - lo_l) / (hi_l - lo_l) if hi_l - lo_l >= 1e-12 else np.zeros_like(lexical)
    if goal.weight in (0.0, 1.0):
        return dense if goal.weight else lexical
    return np.rint((goal.weight * dense + (1 - goal.weight) * lexical) * 1e6) / 1e6


def _score_range(asked: pa.Table, blocks: pa.Table, k: int, goals: list[Goal]) -> tuple[list, list, list, list, list]:
    """(row of ``asked``, slot, dense, lexical, hits) of the best rows of a range; slot -1 sums a query's hits up."""
    out: tuple[list, list, list, list, list] = ([], [], [], [], [])
    number = blocks.column("number").to_numpy()
    order = np.argsort(number, kind="stable")
    slots, w, c = (blocks.column(n).to_numpy()[order] for n in ("slot", "w", "c"))
    known, starts, sizes = np.unique(number[order], return_index=True, return_counts=True)
    width = int(slots.max(initial=-1)) + 1
    numbers = asked.column("numbers").combine_chunks()
    ends, flat = np.cumsum(pc.list_value_length(numbers).to_numpy()), numbers.flatten().to_numpy()
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    at = np.where(known[at] == flat, at, -1)
    ql, qd = (asked.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in ("ql", "qd"))
    limits = list(zip(*(asked.column(n).to_pylist() for n in LIMITS))) if "lo_dense" in asked.column_names else None
    for i in range(asked.num_rows):
        own = np.arange(ends[i - 1] if i else 0, ends[i])
        own = own[at[own] >= 0]
        n = sizes[at[own]]
        rows = _spans(starts[at[own]], n)
        where = slots[rows]
        hits = np.flatnonzero(np.bincount(where, minlength=width))
        if not len(hits):
            continue
        dense = np.rint(np.bincount(where, c[rows] * np.repeat(qd[own], n), width)[hits] * 1e6) / 1e6
        lexical = np.rint(np.bincount(where, w[rows] * np.repeat(ql[own], n), width)[hits] * 1e6) / 1e6
        best = set()
        for goal in goals:
            best.update(np.argsort(-_goal_scores(goal, dense, lexical, limits[i] if limits else ()), kind="stable")[:k].tolist())
        best = sorted(best)
        for values, more, last in zip(out, ([i] * len(best), hits[best].tolist(), dense[best].tolist(), lexical[best].tolist(), [0] * len(best)),
                                      (i, -1, float(dense.min()), float(lexical.min()), len(hits))):
            values += [*more, last]
    return out


def packed(posts: DataFrame, columns: list[str]) -> DataFrame:
    """(range, number, lists): one row for a block, so that workers are fed blocks and not single postings."""
    return posts.groupBy("range", "number").agg(*[F.collect_list(c).alias(c) for c in columns])


def unpacked(blocks: pa.Table, columns: list[str]) -> pa.Table:
    """The postings of ``packed`` blocks, one row each."""
    lists = {c: blocks.column(c).combine_chunks() for c in columns}
    sizes = pc.fill_null(pc.list_value_length(lists[columns[0]]), 0).to_numpy(zero_copy_only=False)
    number = np.repeat(blocks.column("number").to_numpy(), sizes)
    return pa.table({"number": number, **{c: x.flatten() for c, x in lists.items()}})


def score_pairs(asked: Asked, pairs: DataFrame, k: int, goals: list[Goal]) -> DataFrame:
    """(query_id, range, slot, dense, lexical, hits) of the best rows of every (query_id, range) pair."""
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(asked.chunks)).cast("int")
    left = pairs.join(asked.lists, "query_id").withColumn("chunk", chunk)
    needed = pairs.select("range", chunk.alias("chunk")).distinct()
    # asked numbers and ranges are joined to the postings by size or by hash, as Spark finds them
    posts = asked.of_parts(asked.index.blocks).join(asked.terms.select("number").distinct(), "number")
    posts = posts.join(needed.select("range").distinct(), "range", "left_semi").withColumn("c", F.coalesce("c", F.lit(0.0)))
    right = packed(posts, ["slot", "w", "c"]).join(needed, "range").select("range", "chunk", "number", "slot", "w", "c")
    kind = left.schema["query_id"].dataType.simpleString()

    def run(asks: pa.Table, blocks: pa.Table) -> pa.Table:
        found = _score_range(asks, unpacked(blocks, ["slot", "w", "c"]), k, goals) if asks.num_rows and blocks.num_rows else ([], [], [], [], [])
        take = pa.array(found[0], pa.int64())
        return pa.table({"query_id": asks.column("query_id").take(take), "range": asks.column("range").take(take),
                         "slot": pa.array(found[1], pa.int32()), "dense": pa.array(found[2], pa.float64()),
                         "lexical": pa.array(found[3], pa.float64()), "hits": pa.array(found[4], pa.int64())})

    sides = (rows.repartition(asked.tasks, "range", "chunk").groupBy("range", "chunk") for rows in (left, right))
    return next(sides).cogroup(next(sides)).applyInArrow(
        run, f"query_id {kind}, range int, slot int, dense double, lexical double, hits bigint")


# ---- search --------------------------------------------------------------------------------------

def first_pairs(bounds: DataFrame, goals: list[Goal], first: int = FIRST) -> DataFrame:
    """Per query and goal the ranges with the best bounds."""
    keep = None
    for goal in goals:
        up = goal.column(F.col("up_dense"), F.col("up_lexical"))
        own = top_k_per(bounds.withColumn("_up", up), ["query_id"], [F.desc("_up"), F.col("range")], first).select("query_id", "range")
        keep = own if keep is None else keep.union(own)
    return keep.distinct()


def other_pairs(bounds: DataFrame, taken: DataFrame, found: DataFrame, k: int, goals: list[Goal], whole: DataFrame | None = None) -> DataFrame:
    """The pairs not ``taken`` whose bound reaches the k-th score found for some goal; all of them for queries in ``whole``."""
    rest = bounds.join(taken, ["query_id", "range"], "left_anti")
    reach = F.lit(False)
    hits = found.where("slot >= 0")
    for i, goal in enumerate(goals):
        limits = bounds.select("query_id", *LIMITS).distinct() if goal.scaled else None
        scored = hits if limits is None else hits.join(limits, "query_id")
        scored = scored.select("query_id", "range", "slot", goal.column(F.col("dense"), F.col("lexical")).alias("_s"))
        kth = top_k_per(scored, ["query_id"], [F.desc("_s"), F.col("range"), F.col("slot")], k).groupBy("query_id").agg(
            F.when(F.count("*") >= k, F.min("_s")).alias(f"_kth{i}"))
        rest = rest.join(kth, "query_id", "left")
        up = goal.column(F.col("up_dense"), F.col("up_lexical"))
        reach = reach | F.col(f"_kth{i}").isNull() | (up + F.lit(ROUNDING) >= F.col(f"_kth{i}"))
    if whole is not None:
        rest = rest.join(whole.select("query_id", F.lit(True).alias("_whole")), "query_id", "left")
        reach = reach | F.coalesce("_whole", F.lit(False))
    return rest.where(reach).select(*taken.columns)


def _wave(asked: Asked, pairs: DataFrame, ranges: DataFrame | None, k: int, goals: list[Goal]) -> DataFrame:
    pairs = pairs if ranges is None else pairs.join(ranges, "query_id")
    return cut_lineage(score_pairs(asked, pairs, k, goals))


def found_rows(asked: Asked, k: int, goals: list[Goal], ranges: DataFrame | None = None, lows: bool = False,
               first: int = FIRST) -> DataFrame:
    """Rows that hold each goal's first ``k`` of every query, as ``score_pairs`` gives them.

    ``ranges``: (query_id, LIMITS) for scaled goals. ``lows``: go on until it is known whether every document shares a
    term with the query, which takes all ranges only for queries that no range scored so far leaves a document out of.
    """
    if asked.index.facts["ranges"] <= first:  # all of them are in the first wave
        pairs = asked.lists.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(asked.index.facts["ranges"] - 1))).alias("range"))
        return _wave(asked, pairs, ranges, k, goals)
    bounds = asked.bounds()
    bounds = cut_lineage(bounds if ranges is None else bounds.join(ranges, "query_id"))
    taken = cut_lineage(first_pairs(bounds, goals, first))
    found = _wave(asked, taken, ranges, k, goals)
    whole = None
    if lows:
        sizes = asked.index.places.groupBy("range").agg(F.count("*").alias("docs"))
        gaps = found.where("slot < 0").join(sizes, "range").where("hits < docs").select("query_id").distinct()
        whole = taken.select("query_id").distinct().join(gaps, "query_id", "left_anti")
    more = cut_lineage(other_pairs(bounds, taken, found, k, goals, whole))
    return found.unionByName(_wave(asked, more, ranges, k, goals))


def with_ids(found: DataFrame, index) -> DataFrame:
    """(query_id, doc_id, dense, lexical) of the rows found."""
    return found.where("slot >= 0").join(index.places, ["range", "slot"]).select("query_id", "doc_id", "dense", "lexical")


def score_limits(found: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, LIMITS) over the whole bank; 0 is the least score where a document shares no term."""
    high = found.where("slot >= 0").groupBy("query_id").agg(F.max("dense").alias("hi_dense"), F.max("lexical").alias("hi_lexical"))
    low = found.where("slot < 0").groupBy("query_id").agg(
        F.sum("hits").alias("_n"), F.min("dense").alias("_d"), F.min("lexical").alias("_l"))
    all_hit = F.col("_n") >= F.lit(n_docs)
    return high.join(low, "query_id").select(
        "query_id", F.when(all_hit, F.col("_d")).otherwise(F.lit(0.0)).alias("lo_dense"), "hi_dense",
        F.when(all_hit, F.col("_l")).otherwise(F.lit(0.0)).alias("lo_lexical"), "hi_lexical")
