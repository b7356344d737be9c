"""Embedders: a table with a text column in, the same table plus a vector column out.

Models are fed by length: the rows of one Arrow batch are dealt into model batches of rows of about equal length, each of
at most ``padded`` tokens once its rows are padded to the longest, and the results go back to their rows. A worker holds
one Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows) and its results, whatever the partition's size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the functions below travel with the job, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Tokens of a model batch with its padding; a longer row is a batch of its own.
PADDED = 16_384


def letter_vector(text: str) -> Column:
    """Letter counts of a text as a vector: a plain expression, useful where no encoder is at hand."""
    low = F.lower(F.col(text))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("float") for c in ALPHABET])


def letter_embedder(text: str, out: str = "vec") -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(out, letter_vector(text))


def words_in(text: str) -> int:
    """Length of a text where the model's own tokenizer is not given."""
    return len(text.split())


def length_batches(lengths: np.ndarray, padded: int = PADDED) -> list[np.ndarray]:
    """Places of the rows per model batch, shortest rows first."""
    order = np.argsort(lengths, kind="stable")
    sizes = np.maximum(np.asarray(lengths)[order], 1)
    batches, start = [], 0
    while start < len(order):
        cost = np.arange(1, len(order) - start + 1) * sizes[start:]  # rows so far × the longest of them
        end = start + max(1, int(np.searchsorted(cost, padded, side="right")))
        batches.append(order[start:end])
        start = end
    return batches


def padded_share(lengths: np.ndarray, batches: list[np.ndarray]) -> float:
    """Share of padding in the tokens that the batches hand to the model."""
    whole = sum(len(b) * int(lengths[b].max()) for b in batches)
    return 1 - float(lengths.sum()) / whole if whole else 0.0


def _by_length(model: Callable[[list], list], items: list, lengths: list[int], padded: int) -> list:
    out: list = [None] * len(items)
    for batch in length_batches(np.array(lengths, dtype=np.int64), padded):
        for place, value in zip(batch, model([items[i] for i in batch]), strict=True):
            out[place] = value
    return out


def model_embedder(load: Callable[[], Callable[[list[str]], list]], text: str, out: str = "vec", prefix: str = "",
                   padded: int = PADDED, length: Callable[[str], int] = words_in) -> Callable[[DataFrame], DataFrame]:
    """User's encoder: ``load`` runs once per Python worker and returns batch-of-texts → vectors."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            items = [prefix + (x or "") for x in texts]
            yield pd.Series(_by_length(encoder, items, [length(x) for x in items], padded), dtype=object)
    return lambda df: df.withColumn(out, encode(text))


def model_pair_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list]], padded: int = PADDED,
                      length: Callable[[str], int] = words_in) -> Callable[[DataFrame], DataFrame]:
    """User's pair model: ``load`` runs once per worker and returns batch-of-pairs → scores."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = load()
        for queries, candidates in batches:
            items = list(zip(queries, candidates))
            lengths = [length(q or "") + length(c or "") for q, c in items]
            yield pd.Series(_by_length(scorer, items, lengths, padded), dtype="float64")
    return lambda pairs: pairs.withColumn("rerank_score", score("query", "candidate"))
