"""Exact dense search as a block product.

Vectors are hashed into blocks of bounded size. Query blocks and bank blocks meet on a block-pair
key, one task multiplies the two matrices and emits only each query's best ``k`` rows of that bank
block (or its score range), so what is shuffled afterwards is queries × blocks × k, never
queries × bank.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasebench.fixed import DENSE_WEIGHT
from phrasebench.operators.blockmax import RANGE_UNITS, packed, unpacked
from phrasebench.operators.ordering import top_k_per

# the block functions travel with the job, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 16384
#: A query block holds so many times the rows of a bank block: the bank is copied once per query block, and a block's
#: queries are multiplied a chunk at a time, so only their vectors take memory.
QUERY_FACTOR = 4
#: Scores held at once, and rows that a block pair hands on: what a worker's memory is made of, whatever the tables' size.
CELLS, OUT_ROWS = 1 << 21, 1 << 20
#: Fewest queries that a block is cut down to so that every core has one.
LEAST_ROWS = 512


def _block(n: int, col: str = "id") -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def _block_counts(queries: DataFrame, bank: DataFrame, block_rows: int, factor: int = QUERY_FACTOR, k: int = 1) -> tuple[int, int]:
    """Blocks of queries and of bank rows: of bounded rows and, ``k`` rows a query, of bounded results; two a core where the queries do."""
    asked, held = queries.count(), bank.count()
    n_b = max(1, -(-held // block_rows))
    least = -(-asked // max(1, min(factor * block_rows, OUT_ROWS // max(1, k))))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return max(1, least, min(-(-asked // LEAST_ROWS), -(-2 * cores // n_b))), n_b


def _chunks(rows: int, width: int):
    """Starts and ends of stretches of ``rows`` whose scores against ``width`` others are at most ``CELLS``."""
    step = max(1, CELLS // max(1, width))
    return ((start, min(rows, start + step)) for start in range(0, rows, step))


def _first_of_rows(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``keep`` largest scores of every row, largest first, ties by column; NaN comes last."""
    if not keep or not scores.size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ranked = np.where(np.isnan(scores), -np.inf, scores)
    least = np.partition(ranked, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
    rows, cols = np.nonzero(ranked >= least[:, None])
    last = np.isnan(scores[rows, cols])
    order = np.lexsort((cols, last, -ranked[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < keep], cols[place < keep]


def _spread(queries: DataFrame, bank: DataFrame, n_q: int, n_b: int) -> tuple[DataFrame, DataFrame]:
    """Every query block to every bank block: a row is copied once per block of the other side."""
    q = queries.withColumn("qb", _block(n_q)).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))))
    b = bank.withColumn("bb", _block(n_b)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    return q, b


def _blocked(queries: DataFrame, bank: DataFrame, block_rows: int, k: int = 1) -> tuple[DataFrame, DataFrame]:
    return _spread(queries, bank, *_block_counts(queries, bank, block_rows, k=k))


def _matrix(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    ids = table.column("id").combine_chunks()
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = flat.astype(np.float64).reshape(len(ids), -1)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return ids, np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _by_id(ids: pa.Array, vectors: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    order = pa.compute.sort_indices(ids)
    return ids.take(order), vectors[order.to_numpy()]


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Id and vector; a null or empty vector has no direction and takes no part."""
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(F.size("vec") > 0)


def dense_topk(queries: DataFrame, query_id: str, query_vec: str,
               bank: DataFrame, bank_id: str, bank_vec: str, k: int,
               decimals: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, bank_id, score, rank) of the ``k`` nearest rows by cosine; ties go to the lower id."""
    q, b = _blocked(_vectors(queries, query_id, query_vec), _vectors(bank, bank_id, bank_vec), block_rows, k)
    q_type, b_type = (df.schema["id"].dataType.simpleString() for df in (q, b))

    def best_of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_b, out_s = [], [], []
        if left.num_rows and right.num_rows:
            q_ids, q_vec = _matrix(left)
            b_ids, b_vec = _by_id(*_matrix(right))
            keep = min(k, len(b_ids))
            for start, end in _chunks(len(q_ids), len(b_ids)):
                scores = np.round(q_vec[start:end] @ b_vec.T, decimals)
                rows, cols = _first_of_rows(scores, keep)
                out_q.append(q_ids.take(pa.array(rows + start)))
                out_b.append(b_ids.take(pa.array(cols)))
                out_s.append(pa.array(scores[rows, cols]))
        if not out_q:
            return pa.table({"query_id": left.column("id").slice(0, 0),
                             "bank_id": right.column("id").slice(0, 0),
                             "score": pa.array([], pa.float64())})
        return pa.table({"query_id": pa.chunked_array(out_q), "bank_id": pa.chunked_array(out_b),
                         "score": pa.chunked_array(out_s)})

    found = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(
        best_of_block, f"query_id {q_type}, bank_id {b_type}, score double")
    return top_k_per(found, ["query_id"], [F.desc("score"), F.col("bank_id")], k)


def gold_places(queries: DataFrame, query_id: str, query_vec: str, gold: str,
                bank: DataFrame, bank_id: str, bank_vec: str, entity: str,
                decimals: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, gold_rank): place of each query's best row of its gold entity among all bank rows; null without one.

    A first block product finds the best gold row, a second counts the rows above it (score, then lower id); per block
    pair one row a query is handed on, and no list is cut.
    """
    qs = queries.select(F.col(query_id).alias("id"), F.col(query_vec).alias("vec"), F.col(gold).alias("label")).where(F.size("vec") > 0)
    bs = bank.select(F.col(bank_id).alias("id"), F.col(bank_vec).alias("vec"), F.col(entity).alias("label")).where(F.size("vec") > 0)
    n_q, n_b = _block_counts(qs, bs, block_rows)
    q_type, b_type = (df.schema["id"].dataType.simpleString() for df in (qs, bs))

    def products(left: pa.Table, right: pa.Table):
        """(first query, scores) per chunk of queries."""
        _, q_vec = _matrix(left)
        _, b_vec = _matrix(right)
        for start, end in _chunks(len(q_vec), len(b_vec)):
            yield start, np.round(q_vec[start:end] @ b_vec.T, decimals) + 0.0

    def best_gold(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, cols, best = [], [], []
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            names = pa.compute.unique(pa.compute.drop_null(right.column("label")))
            of_bank, of_query = (pa.compute.fill_null(pa.compute.index_in(t.column("label"), names), none).to_numpy()
                                 for t, none in ((right, -1), (left, -2)))
            for start, scores in products(left, right):
                same = of_query[start:start + len(scores), None] == of_bank[None, :]
                at = np.where(same, scores, -np.inf).argmax(axis=1)
                hit = np.flatnonzero(same.any(axis=1))
                rows.append(hit + start)
                cols.append(at[hit])
                best.append(scores[hit, at[hit]])
        take = [pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)) for x in (rows, cols)]
        return pa.table({"query_id": left.column("id").take(take[0]), "bank_id": right.column("id").take(take[1]),
                         "score": pa.array(np.concatenate(best) if best else np.zeros(0))})

    def above(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = []
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_numpy()
            own, least = left.column("own").to_numpy()[:, None], left.column("least").to_numpy()[:, None]
            for start, scores in products(left, right):
                part = slice(start, start + len(scores))
                first = (scores > least[part]) | ((scores == least[part]) & (ids[None, :] < own[part]))
                counts.append((first & (ids[None, :] != own[part])).sum(axis=1))
        n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        return pa.table({"query_id": left.column("id").slice(0, len(n)), "n": pa.array(n.astype(np.int64))})

    def meet(q: DataFrame, what, ddl: str) -> DataFrame:
        q, b = _spread(q, bs, n_q, n_b)
        return q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(what, ddl)

    found = meet(qs, best_gold, f"query_id {q_type}, bank_id {b_type}, score double")
    best = found.groupBy(F.col("query_id").alias("id")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("bank_id").alias("i"))).alias("best"))
    asked = qs.join(best, "id").select("id", "vec", F.col("best.i").alias("own"), (-F.col("best.s")).alias("least"))
    places = meet(asked, above, f"query_id {q_type}, n bigint").groupBy("query_id").agg((F.sum("n") + F.lit(1)).alias("gold_rank"))
    return queries.select(F.col(query_id).alias("query_id")).distinct().join(places, "query_id", "left")


def dense_range(queries: DataFrame, query_id: str, query_vec: str,
                bank: DataFrame, bank_id: str, bank_vec: str,
                decimals: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, lo, hi): each query's score range over the whole bank."""
    q, b = _blocked(_vectors(queries, query_id, query_vec), _vectors(bank, bank_id, bank_vec), block_rows)
    q_type = q.schema["id"].dataType.simpleString()

    def range_of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"query_id": left.column("id").slice(0, 0),
                             "lo": pa.array([], pa.float64()), "hi": pa.array([], pa.float64())})
        q_ids, q_vec = _matrix(left)
        _, b_vec = _matrix(right)
        lo, hi = np.empty(len(q_ids)), np.empty(len(q_ids))
        for start, end in _chunks(len(q_ids), len(b_vec)):
            scores = np.round(q_vec[start:end] @ b_vec.T, decimals)
            lo[start:end], hi[start:end] = scores.min(axis=1), scores.max(axis=1)
        return pa.table({"query_id": q_ids, "lo": pa.array(lo), "hi": pa.array(hi)})

    found = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(
        range_of_block, f"query_id {q_type}, lo double, hi double")
    return found.groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


LIMITS = ["lo_dense", "hi_dense", "lo_lexical", "hi_lexical"]
FUSED = ["query_id", "doc_id", "dense", "lexical", "score"]


def _fused_block(asked: pa.Table, bank: pa.Table, lexical_of, k: int, weight: float, decimals: int) -> list[pa.Table]:
    """Best ``k`` rows of a bank block (sorted by id) for every query of ``asked``; ``lexical_of(start, end)`` gives the
    lexical scores of a stretch of queries against the block."""
    q_ids, q_vec = _matrix(asked)
    b_ids, b_vec = _matrix(bank)
    lo_d, hi_d, lo_l, hi_l = (asked.column(c).to_numpy().astype(np.float64)[:, None] for c in LIMITS)
    parts = []

    def scaled(x, lo, hi):
        span = hi - lo
        return np.where(span < 1e-12, 0.0, (x - lo) / np.where(span < 1e-12, 1.0, span))

    for start, end in _chunks(len(q_ids), len(b_ids)):
        part = slice(start, end)
        dense, lex = np.round(q_vec[part] @ b_vec.T, decimals), lexical_of(start, end)
        score = np.round(weight * scaled(dense, lo_d[part], hi_d[part]) + (1 - weight) * scaled(lex, lo_l[part], hi_l[part]), decimals)
        rows, cols = _first_of_rows(score, min(k, len(b_ids)))
        parts.append(pa.table([q_ids.take(pa.array(rows + start)), b_ids.take(pa.array(cols)),
                               *(pa.array(m[rows, cols]) for m in (dense, lex, score))], names=FUSED))
    return parts


def _fused_table(parts: list[pa.Table], left: pa.Array, right: pa.Array) -> pa.Table:
    if parts:
        return pa.concat_tables(parts)
    none = pa.array([], pa.float64())
    return pa.table([left.slice(0, 0), right.slice(0, 0), none, none, none], names=FUSED)


def fused_topk(queries: DataFrame, query_id: str, query_vec: str,
               bank: DataFrame, bank_id: str, bank_vec: str,
               lexical: DataFrame, ranges: DataFrame, k: int, weight: float = DENSE_WEIGHT,
               decimals: int = 6, block_rows: int = BLOCK_ROWS // 8) -> DataFrame:
    """(query_id, doc_id, dense, lexical, score, rank): exact top ``k`` of scaled dense + lexical.

    ``lexical`` holds the non-zero lexical scores (query_id, doc_id, lexical); they travel to the block
    pair of their two rows. Or it is the terms asked of an index (``blockmax.Asked``): then the bank is cut into the
    index's ranges and a block pair makes its lexical scores from the range's postings, so that no table of pairs
    exists. ``ranges`` has lo/hi of both scores over the whole bank per query.
    """
    qs, bs = _vectors(queries, query_id, query_vec), _vectors(bank, bank_id, bank_vec)
    if not isinstance(lexical, DataFrame):
        return _fused_by_ranges(qs, bs, lexical, ranges, k, weight, decimals)
    n_q, n_b = _block_counts(qs, bs, block_rows, 1)  # a block pair also holds its lexical scores
    q, b = _spread(qs, bs, n_q, n_b)
    q = q.join(ranges.select(F.col("query_id").alias("id"), *LIMITS), "id")
    pairs = lexical.select(_block(n_q, "query_id").alias("qb"), _block(n_b, "doc_id").alias("bb"),
                           F.col("query_id").alias("id"), "doc_id", "lexical")
    left = q.unionByName(pairs, allowMissingColumns=True)
    q_type, b_type = (df.schema["id"].dataType.simpleString() for df in (q, b))

    def best_of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        is_query = pa.compute.is_valid(left.column("vec"))
        asked, found = left.filter(is_query), left.filter(pa.compute.invert(is_query))
        if not (asked.num_rows and right.num_rows):
            return _fused_table([], left.column("id"), right.column("id"))
        right = right.sort_by("id")
        rows = pa.compute.index_in(found.column("id").combine_chunks(), asked.column("id").combine_chunks()).to_numpy(zero_copy_only=False)
        cols = pa.compute.index_in(found.column("doc_id").combine_chunks(), right.column("id").combine_chunks()).to_numpy(zero_copy_only=False)
        vals = found.column("lexical").to_numpy()
        known = ~(np.isnan(rows.astype(float)) | np.isnan(cols.astype(float)))
        rows, cols, vals = rows[known].astype(int), cols[known].astype(int), vals[known]

        def lexical_of(start: int, end: int) -> np.ndarray:
            lex = np.zeros((end - start, right.num_rows))
            here = (rows >= start) & (rows < end)
            lex[rows[here] - start, cols[here]] = vals[here]
            return lex

        return _fused_table(_fused_block(asked, right, lexical_of, k, weight, decimals), left.column("id"), right.column("id"))

    found = left.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(
        best_of_block, f"query_id {q_type}, doc_id {b_type}, dense double, lexical double, score double")
    return top_k_per(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def _fused_by_ranges(qs: DataFrame, bs: DataFrame, asked, ranges: DataFrame, k: int, weight: float, decimals: int) -> DataFrame:
    """``fused_topk`` with the bank in the ranges of an index; rows that have no terms are dealt to ranges of their own."""
    facts = asked.index.facts
    n_q, n_b = _block_counts(qs, bs, RANGE_UNITS, 1, k)
    n_q = max(n_q, asked.chunks)
    limits = ranges.select(F.col("query_id").alias("id"), *LIMITS)
    lists = asked.lists.select(F.col("query_id").alias("id"), "numbers", "ql")
    places = asked.index.places.select(F.col("doc_id").alias("id"), "range", "slot")
    b = bs.join(places, "id", "left").withColumn("range", F.coalesce("range", F.lit(facts["ranges"]) + _block(n_b)))
    here = F.explode(F.sequence(F.lit(0), F.lit(facts["ranges"] + n_b - 1))).alias("range")
    q = qs.join(limits, "id").join(lists, "id", "left").select("*", _block(n_q).alias("qb"), here)
    every = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb")
    of_chunk = asked.terms.select(_block(n_q, "query_id").alias("qb"), "number").distinct()
    posts = asked.of_parts(asked.index.blocks).join(of_chunk.select("number").distinct(), "number")
    posts = packed(posts, ["slot", "w"]).join(of_chunk, "number").select("range", "qb", "number", F.col("slot").alias("slots"), "w")
    right = b.select("range", every, "id", "vec", "slot").unionByName(posts, allowMissingColumns=True)
    q_type, b_type = (df.schema["id"].dataType.simpleString() for df in (qs, bs))

    def best_of_range(left: pa.Table, right: pa.Table) -> pa.Table:
        is_row = pa.compute.is_valid(right.column("vec"))
        bank, posts = right.filter(is_row).sort_by("id"), right.filter(pa.compute.invert(is_row))
        if not (left.num_rows and bank.num_rows):
            return _fused_table([], left.column("id"), bank.column("id"))
        # a repeated id has its scores once, at its first row
        q_first, b_first = (_first_places(t.column("id").combine_chunks()) for t in (left, bank))
        slot = pa.compute.fill_null(bank.column("slot"), -1).to_numpy()
        column = np.full(int(slot.max(initial=-1)) + 2, -1)
        column[slot[b_first]] = b_first
        column[-1] = -1
        posts = unpacked(posts, ["slots", "w"])
        number, at, w = (posts.column(c).to_numpy() for c in ("number", "slots", "w"))
        order = np.argsort(number, kind="stable")
        inside = column[np.minimum(at[order], len(column) - 1)]
        number, w = number[order], w[order]
        lists = left.column("numbers").combine_chunks()
        ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
        asks, ql = (left.column(c).combine_chunks().flatten().to_numpy() for c in ("numbers", "ql"))
        lows, highs = (np.searchsorted(number, asks, side) for side in ("left", "right"))
        firsts = set(q_first.tolist())

        def lexical_of(start: int, end: int) -> np.ndarray:
            lex = np.zeros((end - start, bank.num_rows))
            for i in range(start, end):
                if i not in firsts:
                    continue
                for j in range(ends[i - 1] if i else 0, ends[i]):
                    cols = inside[lows[j]:highs[j]]
                    held = cols >= 0
                    lex[i - start, cols[held]] += w[lows[j]:highs[j]][held] * ql[j]  # a document holds a term once
            return np.rint(lex * 1e6) / 1e6 + 0.0

        return _fused_table(_fused_block(left, bank, lexical_of, k, weight, decimals), left.column("id"), bank.column("id"))

    found = q.groupBy("range", "qb").cogroup(right.groupBy("range", "qb")).applyInArrow(
        best_of_range, f"query_id {q_type}, doc_id {b_type}, dense double, lexical double, score double")
    return top_k_per(found, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def _first_places(ids: pa.Array) -> np.ndarray:
    """Place of the first row of every id."""
    return np.unique(pa.compute.index_in(ids, ids).to_numpy(zero_copy_only=False))
