"""Phrases in texts: one pass over the texts with an Aho-Corasick automaton of the phrases.

Phrases are dealt into shards of bounded size by a hash of their id. A shard's phrases are broadcast, every worker builds
the shard's automaton once, and the texts are read where they lie, a pass for each shard: no text, and no run of its
tokens, is shuffled, and a phrase that a third of all texts hold costs no hot key. Hits leave the pass with their ids.
"""

from __future__ import annotations

import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phrasebench.functions import worker_cache
from phrasebench.functions.text import padded_run
from phrasebench.session import cut_lineage, measured_bytes

# what runs in workers travels with the job, so they need no copy of this package
for _module in (sys.modules[__name__], worker_cache):
    cloudpickle.register_pickle_by_value(_module)

#: Bytes of phrases and ids in a shard; an automaton takes some fifty times as much.
SHARD_BYTES = 2 * 1024 * 1024
#: Texts scanned between two batches of hits.
TEXT_ROWS = 1000


def _automaton(runs: list[str]):
    """Automaton whose values are lists of places in ``runs``."""
    import ahocorasick
    places: dict[str, list[int]] = {}
    for i, run in enumerate(runs):
        places.setdefault(run, []).append(i)
    made = ahocorasick.Automaton()
    for run, at in places.items():
        made.add_word(run, at)
    made.make_automaton()
    return made


def _hits(texts: list[str | None], automaton) -> tuple[list[int], list[int]]:
    """(place of the text, place of the phrase) of every pair, each once."""
    rows, cols = [], []
    for i, text in enumerate(texts):
        if text:
            found = {j for _, at in automaton.iter(text) for j in at}
            rows += [i] * len(found)
            cols += sorted(found)
    return rows, cols


def token_run_matches(queries: DataFrame, query_id: str, query_tokens: str,
                      phrases: DataFrame, phrase_id: str, phrase_tokens: str,
                      shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, phrase_id) for every phrase that occurs as a contiguous token run of a query text.

    A null or empty token list neither holds a phrase nor is one; pairs of repeated ids are given once per row.
    """
    spark = queries.sparkSession
    texts = queries.select(F.col(query_id).alias("query_id"), padded_run(query_tokens).alias("_t"))
    p = phrases.where(F.size(phrase_tokens) > 0).select(F.col(phrase_id).alias("phrase_id"), padded_run(phrase_tokens).alias("_p"))
    p = cut_lineage(p)
    shards = max(1, -(-measured_bytes(p) // shard_bytes))
    if shards > 1:
        p = cut_lineage(p.withColumn("_shard", F.pmod(F.xxhash64("phrase_id"), F.lit(shards))).repartition(shards, "_shard"))
    schema = T.StructType([T.StructField("query_id", texts.schema["query_id"].dataType), T.StructField("phrase_id", p.schema["phrase_id"].dataType)])

    def scan(shard: DataFrame) -> DataFrame:
        held = shard.select("phrase_id", "_p").toArrow()  # about ``shard_bytes``
        shared, name = spark.sparkContext.broadcast((held.column("phrase_id").combine_chunks(), held.column("_p").to_pylist())), uuid.uuid4().hex

        def run(batches):
            ids, runs = shared.value
            automaton = worker_cache.once_per_worker(name, lambda: _automaton(runs))
            for whole in batches:
                for start in range(0, whole.num_rows, TEXT_ROWS):
                    batch = whole.slice(start, TEXT_ROWS)
                    rows, cols = _hits(batch.column("_t").to_pylist(), automaton)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("query_id").take(pa.array(rows, pa.int64())), ids.take(pa.array(cols, pa.int64()))], names=["query_id", "phrase_id"])

        return texts.mapInArrow(run, schema)

    if shards == 1:
        return scan(p)
    found = None
    for s in range(shards):  # one shard at a time goes through the driver
        one = scan(p.where(F.col("_shard") == s))
        found = one if found is None else found.unionByName(one)
    return found
