"""Centroid clustering (k-means) of integer vectors with Shallot search, exact in integers.

Vectors are packed into blocks inside the scan's tasks and written once, bucketed by block. Between rounds only a narrow
state travels: per vector the number of its centroid, that of the second-nearest, an upper bound of the distance to
the first and a lower bound of that to all others. A round widens the bounds by how far the centroids moved; a vector
whose upper bound is below its lower bound, or below half the distance from its centroid to the nearest other one, keeps
its centroid unread. The others get the exact distances to the two remembered centroids and start from the closer one,
p: centroids are scanned in order of their distance from p, until that exceeds d(x, p) plus the second-least distance
found so far, which shrinks as the scan goes on. Bounds are floating point with a slack and only ever skip a centroid
that cannot be nearest; all survivors are compared as integers (squared distance, then number).

Each task adds up its vectors per centroid before anything is shuffled, so what travels, and what the driver gets, has
the size of the centroids. New centroids are the exact floors of sum over count; one without vectors stays.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part, nor do those with a
component beyond ``LARGEST``, whose squared distances would not fit a long; equal vectors and rows with one id are kept
each for itself, a null id hashes like an empty one; with fewer vectors than centroids there are as many centroids as
vectors; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phrasebench.session import bucket_count, cut_lineage, scratch_path, store_bucketed

#: Relative and absolute widening of every bound; far above what rounding can cost, far below what pruning could lose.
SLACK = 1e-9
#: Largest absolute component: 64 squared differences of twice its size stay below 2 ** 63.
LARGEST = 1 << 27
#: Centroids that a scan takes at once, between two looks at the search ball.
STRIDE = 4

_BLOCK = "block bigint, ids array<bigint>, data binary"
_STATE = "block bigint, near binary, second binary, upper binary, lower binary, sums binary"


# ---- inside a task -------------------------------------------------------------------------------

def squared(vectors, centroids):
    """Exact squared distances (int64) of every vector from every centroid."""
    import numpy as np
    size = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if float(size) ** 2 * vectors.shape[1] * 8 < 2 ** 53:  # every partial sum is an integer below 2 ** 53
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        d = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]
        return np.rint(d).astype(np.int64)
    out = np.empty((len(vectors), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        diff = vectors - c
        out[:, j] = (diff * diff).sum(1)
    return out


class Centres:
    """Centroids with what a search needs: neighbours of each by distance, half gaps, and how far each has moved."""

    def __init__(self, now, before=None):
        import numpy as np
        self.at = now
        apart = np.sqrt(squared(now, now).astype(np.float64))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.reach = np.take_along_axis(apart, self.order, axis=1) * (1 - SLACK)
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 if len(now) > 1 else np.full(len(now), np.inf)
        moved = np.zeros(len(now)) if before is None else np.sqrt(((now - before) ** 2).sum(1).astype(np.float64))
        self.moved = moved * (1 + SLACK)
        rank = np.argsort(-moved, kind="stable")
        self.most, self.most_other = rank[0], self.moved[rank[1]] if len(now) > 1 else 0.0


def search(vectors, start, other, centres: Centres):
    """(near, second, squared distance, squared distance of the second) of every vector, from two remembered centroids."""
    import numpy as np
    k = len(centres.at)
    if k == 1:
        zero = np.zeros(len(vectors), dtype=np.int64)
        return zero, zero, squared(vectors, centres.at)[:, 0], np.full(len(vectors), -1, dtype=np.int64)
    near, second = start.copy(), other.copy()
    d1, d2 = np.empty(len(vectors), dtype=np.int64), np.empty(len(vectors), dtype=np.int64)
    for c in range(k):
        for which, out in ((near, d1), (second, d2)):
            own = np.flatnonzero(which == c)
            if len(own):
                out[own] = squared(vectors[own], centres.at[c:c + 1])[:, 0]
    swap = (d2 < d1) | ((d2 == d1) & (second < near))
    near[swap], second[swap] = second[swap], near[swap]
    d1[swap], d2[swap] = d2[swap], d1[swap]
    origin, seen = near.copy(), second.copy()
    for p in range(k):
        live = np.flatnonzero(origin == p)
        out_to = np.sqrt(d1[live].astype(np.float64))  # distance from where the scan starts; it stays the ball's centre
        others, reach = centres.order[p][centres.order[p] != p], centres.reach[p][centres.order[p] != p]
        for step in range(0, k - 1, STRIDE):
            inside = reach[step] <= (out_to + np.sqrt(d2[live].astype(np.float64))) * (1 + SLACK) + SLACK
            live, out_to = live[inside], out_to[inside]
            if not len(live):
                break
            some = others[step:step + STRIDE]
            d = squared(vectors[live], centres.at[some])
            for j, c in enumerate(some):
                dj = np.where(seen[live] == c, np.iinfo(np.int64).max, d[:, j])
                first = (dj < d1[live]) | ((dj == d1[live]) & (c < near[live]))
                then = ~first & ((dj < d2[live]) | ((dj == d2[live]) & (c < second[live])))
                a, b = live[first], live[then]
                second[a], d2[a] = near[a], d1[a]
                near[a], d1[a] = c, dj[first]
                second[b], d2[b] = c, dj[then]
    return near, second, d1, d2


def assign(vectors, state, centres: Centres):
    """New state (near, second, upper, lower) of a block's vectors."""
    import numpy as np
    n = len(vectors)
    if state is None:
        near, second = np.zeros(n, dtype=np.int64), np.full(n, min(1, len(centres.at) - 1), dtype=np.int64)
        upper, lower = np.full(n, np.inf), np.zeros(n)
    else:
        near, second, upper, lower = (x.copy() for x in state)
        upper = upper + centres.moved[near]
        lower = lower - np.where(near == centres.most, centres.most_other, centres.moved[centres.most])
    clear = upper * (1 + SLACK) + SLACK < np.maximum(lower, centres.half[near])
    live = np.flatnonzero(~clear)
    if len(live):
        a, b, d1, d2 = search(vectors[live], near[live], second[live], centres)
        near[live], second[live] = a, b
        upper[live], lower[live] = np.sqrt(d1.astype(np.float64)), np.where(d2 < 0, np.inf, np.sqrt(np.maximum(d2, 0).astype(np.float64)))
    return near, second, upper, lower


def add_up(vectors, near, k: int):
    """Per centroid the sum of its vectors and their number, as (k, width + 1) integers."""
    import numpy as np
    out = np.zeros((k, vectors.shape[1] + 1), dtype=np.int64)
    np.add.at(out[:, -1], near, 1)
    order = np.argsort(near, kind="stable")
    starts = np.flatnonzero(np.diff(near[order], prepend=-1))
    if len(order):
        out[near[order][starts], :-1] = np.add.reduceat(vectors[order], starts, axis=0)
    return out


# ---- Spark ---------------------------------------------------------------------------------------

def kept(rows: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """(id, v): integers floor(scale * x) of the vectors that take part."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) <= F.lit(float(LARGEST))))
    return rows.where(x.isNotNull() & (F.size(x) == width) & fine).select(
        F.col(key).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(points: DataFrame, k: int, salt: str):
    """The vectors with the k smallest hashes of salt and id, in that order; equal hashes by vector."""
    import numpy as np
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    got = points.select(order.alias("o"), "v").orderBy("o", "v").limit(k).collect()  # k vectors
    return np.array([r["v"] for r in got], dtype=np.int64) if got else None


def pack(points: DataFrame, width: int) -> DataFrame:
    """(block, ids, data): the vectors of an Arrow batch in one row, numbered by task and batch, bucketed by block."""
    def run(batches):
        import numpy as np
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column("v").flatten().to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())],
                names=["block", "ids", "data"])
            at += 1

    spark = points.sparkSession
    buckets = bucket_count(spark, points.count() * width * 4)
    blocks = points.mapInArrow(run, _BLOCK).repartition(buckets, "block")
    return store_bucketed(blocks, scratch_path(spark, "vectors"), "block", buckets)


def _vectors(data: bytes, width: int):
    import numpy as np
    return np.frombuffer(data, dtype=np.int32).reshape(-1, width).astype(np.int64)


def _state(row) -> tuple:
    import numpy as np
    return tuple(np.frombuffer(b, dtype=t) for b, t in zip(row, (np.int64, np.int64, np.float64, np.float64)))


def _round(blocks: DataFrame, state: DataFrame | None, now, before, width: int) -> DataFrame:
    """State of every block under the centroids ``now``, and the block's sums, written once."""
    shared = blocks.sparkSession.sparkContext.broadcast((now, before))  # two tables of k vectors
    both = blocks.select("block", "data")
    if state is not None:
        both = both.join(state.drop("sums").hint("shuffle_hash"), "block")

    def run(batches):
        import numpy as np
        centres = Centres(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                vectors = _vectors(one.column("data")[0].as_py(), width)
                old = _state([one.column(c)[0].as_py() for c in ("near", "second", "upper", "lower")]) if "near" in one.schema.names else None
                made = assign(vectors, old, centres)
                sums = add_up(vectors, made[0], len(centres.at))
                yield pa.RecordBatch.from_arrays(
                    [one.column("block"), *[pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in (*made, sums)]],
                    names=["block", "near", "second", "upper", "lower", "sums"])

    return cut_lineage(both.mapInArrow(run, _STATE))


def _total(state: DataFrame, k: int, width: int):
    """Sums and numbers per centroid over all blocks: added up inside tasks, then per component by Spark."""
    import numpy as np

    def run(batches):
        total = None
        for batch in batches:
            for blob in batch.column("sums").to_pylist():
                one = np.frombuffer(blob, dtype=np.int64)
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["sums"])

    parts = state.select("sums").mapInArrow(run, "sums array<bigint>")
    rows = parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # k * (width + 1) numbers
    out = np.zeros(k * (width + 1), dtype=np.int64)
    for r in rows:
        out[r["i"]] = r["x"]
    return out.reshape(k, width + 1)


def cluster(rows: DataFrame, key: str, vector: str, k: int, rounds: int, width: int = 64, scale: int = 256, salt: str = "2:"):
    """(assignments, centroids): (key, cluster, distance, centroid digest, inertias) of every vector that takes part, and the final centroids.

    ``rounds`` times the vectors are assigned and the centroids moved; then the vectors are assigned once more.
    """
    import numpy as np
    spark = rows.sparkSession
    schema = f"`{key}` bigint, cluster int, distance bigint"
    points = kept(rows, key, vector, width, scale)
    now, before, state = first_centroids(points, k, salt), None, None
    if now is None:
        return _labelled(spark.createDataFrame([], schema), key, []), now
    blocks = pack(points, width)
    for _ in range(rounds):
        state = _round(blocks, state, now, before, width)
        total = _total(state, len(now), width)
        before, now = now, now.copy()
        full = total[:, -1] > 0
        now[full] = total[full, :-1] // total[full, -1:]  # floor, also below zero
    state = _round(blocks, state, now, before, width)
    shared = spark.sparkContext.broadcast(now)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                near = np.frombuffer(batch.column("near")[i].as_py(), dtype=np.int64)
                diff = _vectors(batch.column("data")[i].as_py(), width) - shared.value[near]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(near.astype(np.int32)), pa.array((diff * diff).sum(1))],
                    names=[key, "cluster", "distance"])

    made = blocks.join(state.select("block", "near").hint("shuffle_hash"), "block").select("ids", "data", "near").mapInArrow(run, schema)
    return _labelled(cut_lineage(made), key, now), now


def _labelled(made: DataFrame, key: str, centroids) -> DataFrame:
    """``made`` with its clusters' inertia, the whole inertia (null if beyond a long) and the centroids' digests."""
    spark = made.sparkSession
    digests = [(i, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids)]
    digests = spark.createDataFrame(digests, "_c int, centroid_sha256 string")
    per = made.groupBy(F.col("cluster").alias("_c")).agg(F.try_sum("distance").alias("cluster_inertia")).join(digests, "_c")
    whole = W.partitionBy(F.lit(0))  # of at most k rows
    per = per.withColumn("inertia", F.try_sum("cluster_inertia").over(whole))
    return made.join(F.broadcast(per), made["cluster"] == per["_c"]).select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
