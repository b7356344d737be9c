"""Nearest neighbours by vantage-point trees, one per shard, searched with relaxed triangle-inequality pruning.

Vectors are scaled to unit length, where the largest cosine is the smallest distance. Rows are dealt over shards by
a hash of their id, so a shard's size is bounded and a vector that occurs very often is spread over all of them.
A shard's tree splits its rows at the median distance from a vantage point and keeps, for both halves, the least
and greatest distance, so ties split like anything else. A query gives every leaf a lower bound for its distance,
visits leaves from the smallest bound on, and stops when ``factor`` times the bound exceeds its k-th distance so far;
with factor 1 no leaf that could matter is left out, so the search is exact.

Queries are packed into blocks; every block meets every shard's tree. Per block and shard the k nearest of each query
are handed on, and merged per query. Scores are recomputed from the original vectors in double precision; ties, to
twelve places, go to the smaller id.

Cases: vectors that are null, empty, zero, of another length than most, or with null or non-finite components take
no part; equal vectors tie; rows with one id are candidates each for itself, but a query is no candidate of its own
id; a query id that occurs twice is searched once, with its smallest vector; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phrasebench.session import cut_lineage

#: Rows of a shard and of a query block, on average; blocks that share a copy of a tree; leaf size; pruning factor.
SHARD_ROWS, BLOCK_ROWS, CHUNK_BLOCKS, LEAF_ROWS, FACTOR = 4096, 1024, 16, 128, 2.5


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a finite, non-zero vector."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


def build_tree(unit, leaf: int = LEAF_ROWS) -> dict:
    """Flat tree over unit rows: order of the rows, leaf ranges, and every leaf's bounds to the vantage points above it.

    ``near`` and ``far`` have a row per leaf and a column per depth: the interval of distances of the leaf's rows from
    the vantage point at that depth, whose row number is in ``vantage`` (-1 below the leaf's depth).
    """
    import numpy as np
    order, leaves = np.arange(len(unit)), []

    def split(lo: int, hi: int, above: list):
        if hi - lo <= leaf:
            leaves.append((lo, hi, above))
            return
        rows = order[lo:hi]
        vp = rows[0]
        # of a few rows, the one whose distances vary most
        tries = rows[:: max(1, len(rows) // 5)][:5]
        spread = [np.var(unit[rows] @ unit[t]) for t in tries]
        vp = tries[int(np.argmax(spread))]
        d = np.sqrt(np.maximum(0, 2 - 2 * (unit[rows] @ unit[vp])))
        half = len(rows) // 2
        at = np.argpartition(d, half)
        order[lo:hi], d = rows[at], d[at]
        split(lo, lo + half, [*above, (vp, d[:half].min(), d[:half].max())])
        split(lo + half, hi, [*above, (vp, d[half:].min(), d[half:].max())])

    split(0, len(unit), [])
    depth = max((len(a) for _, _, a in leaves), default=0)
    vantage = np.full((len(leaves), depth), -1)
    near, far = np.zeros((len(leaves), depth)), np.full((len(leaves), depth), 2.0)
    for i, (_, _, above) in enumerate(leaves):
        for j, (vp, a, b) in enumerate(above):
            vantage[i, j], near[i, j], far[i, j] = vp, a, b
    return {"order": order, "starts": np.array([a for a, _, _ in leaves]), "ends": np.array([b for _, b, _ in leaves]),
            "vantage": vantage, "near": near, "far": far}


def leaf_bounds(tree: dict, unit, queries):
    """Lower bound of the distance of every query from the rows of every leaf."""
    import numpy as np
    points, place = np.unique(tree["vantage"], return_inverse=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * (queries @ unit[points].T)))  # the column of -1 is not used
    bound = np.zeros((len(queries), len(tree["starts"])))
    place = place.reshape(tree["vantage"].shape)
    for j in range(tree["vantage"].shape[1]):
        own = tree["vantage"][:, j] >= 0
        dj = d[:, place[own, j]]
        bound[:, own] = np.maximum(bound[:, own], np.maximum(tree["near"][own, j] - dj, dj - tree["far"][own, j]))
    return bound


def search(tree: dict, unit, ids, queries, query_ids, k: int, factor: float):
    """Per query the rows of its k nearest (all ties with the k-th included) among ids other than its own."""
    import numpy as np
    bound = leaf_bounds(tree, unit, queries) * factor
    worst = np.full(len(queries), np.inf)
    kept = [[] for _ in range(len(queries))]  # (distances, rows) found so far, at most about k and ties
    rank = np.argsort(bound, axis=1, kind="stable")
    slack = 1e-6
    for step in range(rank.shape[1]):
        leaf = rank[:, step]
        live = np.flatnonzero(bound[np.arange(len(queries)), leaf] <= worst + slack)
        if not len(live):
            break
        for one in np.unique(leaf[live]):
            own = live[leaf[live] == one]
            rows = tree["order"][tree["starts"][one]:tree["ends"][one]]
            d = np.sqrt(np.maximum(0, 2 - 2 * (queries[own] @ unit[rows].T)))
            d[ids[rows][None, :] == query_ids[own][:, None]] = np.inf
            for q, dq in zip(own, d):
                hit = np.flatnonzero(dq <= worst[q] + slack)
                hit = hit[np.isfinite(dq[hit])]
                if len(hit):
                    kept[q].append((dq[hit], rows[hit]))
                    dist = np.concatenate([x for x, _ in kept[q]])
                    if len(dist) >= k:
                        worst[q] = np.partition(dist, k - 1)[k - 1]
                        near = dist <= worst[q] + slack
                        kept[q] = [(dist[near], np.concatenate([r for _, r in kept[q]])[near])]
    return [np.concatenate([r for _, r in found]) if found else np.zeros(0, dtype=int) for found in kept]


def _pack(df: DataFrame, group: str, what) -> DataFrame:
    """One row (group, blob) per group of bounded size."""
    def run(key, table):
        return pa.table({group: [key[0].as_py()], "blob": [what(table)]}, schema=pa.schema([(group, pa.int64()), ("blob", pa.binary())]))
    return df.groupBy(group).applyInArrow(run, f"{group} bigint, blob binary")


def _matrix(table: pa.Table):
    """Ids in rising order and their vectors in double precision; rows of another length than most are left out."""
    import numpy as np
    ids = table.column("id").to_numpy()
    rows = [np.asarray(v, dtype=np.float64) for v in table.column("v").to_pylist()]
    sizes = np.array([len(r) for r in rows])
    common = np.bincount(sizes).argmax()
    at = [i for i in np.argsort(ids, kind="stable") if sizes[i] == common]
    return ids[at], np.stack([rows[i] for i in at])


def index(rows: DataFrame, key: str, vector: str, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(shard, blob) with one tree per shard, written once, and the number of shards."""
    fine = usable(rows, vector).select(F.col(key).alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL")
    shards = max(1, -(-rows.count() // shard_rows))

    def what(table: pa.Table) -> bytes:
        import numpy as np
        ids, v = _matrix(table)
        return pickle.dumps((ids, v, build_tree(v / np.linalg.norm(v, axis=1, keepdims=True))), protocol=5)

    return cut_lineage(_pack(fine.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))), "shard", what)), shards


def nearest(trees: tuple[DataFrame, int], queries: DataFrame, key: str, vector: str, k: int, factor: float = FACTOR,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, nearest first.

    A tree is copied once per chunk of query blocks, a block once per shard; a pair of chunk and shard is one group of
    bounded size, and hands on k rows per query.
    """
    index_rows, shards = trees
    fine = usable(queries, vector).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(vector).alias("v"))
    blocks = max(1, -(-queries.count() // block_rows))
    packed = cut_lineage(_pack(fine.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks))), "block",
                               lambda table: pickle.dumps(_matrix(table), protocol=5)))
    chunks = -(-blocks // CHUNK_BLOCKS)
    left = index_rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = packed.withColumn("chunk", F.floor(F.col("block") / F.lit(CHUNK_BLOCKS)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(tree_rows, block_rows):
        import numpy as np
        out = {"query_id": [], "vec_id": [], "score": []}
        for tree_blob in tree_rows.column("blob").to_pylist():
            ids, v, tree = pickle.loads(tree_blob)
            norm = np.linalg.norm(v, axis=1)
            unit = v / norm[:, None]
            for block in block_rows.column("blob").to_pylist():
                query_ids, q = pickle.loads(block)
                if q.shape[1] != v.shape[1]:
                    continue
                size = np.linalg.norm(q, axis=1)
                found = search(tree, unit, ids, q / size[:, None], query_ids, k, factor)
                for i, rows in enumerate(found):
                    score = np.einsum("ij,j->i", v[rows], q[i]) / (norm[rows] * size[i])
                    best = np.lexsort((ids[rows], -np.round(score, 12)))[:k]
                    out["query_id"] += [query_ids[i]] * len(best)
                    out["vec_id"] += ids[rows][best].tolist()
                    out["score"] += score[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    found = left.select("shard", "chunk", "blob").groupBy("shard", "chunk").cogroup(
        right.select("shard", "chunk", "blob").groupBy("shard", "chunk")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
