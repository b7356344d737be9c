"""Packing of tokenised documents into windows by lexical retrieval: a window holds a seed and its BM25 neighbours.

1. Tokens: texts are split at ASCII white space, and between a letter and a mark, which no token of the vocabulary
   spans; a worker encodes a distinct word once and gathers a text's ids from its words. The vocabulary must lower-case.
   The token table is written once.
2. Document frequencies of all tokens are counted in the same pass, over all documents: a row of counts a task, added up
   per token by Spark; the result has a row per vocabulary entry.
3. Shards: every token has one place in a weighted random order, in which late entries of the vocabulary, which its
   makers found rare, come first; a document's sketch is its first ``SKETCH`` tokens in that order. Documents are
   sorted by sketch, by range, so those that share rare tokens, and copies, lie together, while a group of any size is
   spread over as many tasks as it needs. A task cuts its range into shards of about ``SHARD_TOKENS`` tokens.
4. A shard has an inverted index with BM25 weights (global frequencies and mean length). The first unused document is a
   seed; its unused neighbours follow by falling score and fill the window; the one that does not fit is cut, and its
   rest seeds the next window. Only a shard's last window stays open, and is handed on to the task's next shard. What
   is left at the end of a range is cut into sequences of falling powers of two, so no sequence needs padding.

A document longer than a window fills whole windows by itself first; its rest takes part in 4 with the frequencies of
the whole document.

Cases: a null or empty text is the end token alone; repeated rows are packed each for itself; a text without common
tokens scores 0 against all and is taken in order; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasebench.llm.workers import cached
from phrasebench.session import cut_lineage

WINDOW, END = 2048, 1
SHARD_TOKENS, RANGE_TOKENS = 1 << 19, 1 << 22
K1, B = 1.2, 0.75
SKETCH = 4
#: Words kept in a worker's cache, about 330 bytes each, and bytes of text handled at once.
MAX_WORDS, TEXT_BYTES = 300_000, 1 << 22
#: How much rarer tokens are preferred by the sketch: weights grow with this power of their number.
STEEP = 4
#: Stands between words that are encoded together; its one token ends no word without this character.
_MARK = "\x01"
#: A letter and a mark behind it are never in one match of the vocabulary's pattern, so a word may end between them.
_LETTER_MARK = r"([a-z])([.,;:!?%&#*$|)])"
#: Words that normalising leaves alone and the pattern matches as a whole: they go straight to the merges.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else the next from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}

_TOKENS = 1 << 20, 1 << 22
K1, B = 1.2, 0.75
SKETCH = 4
#: Characters of words kept in a worker's cache, and rows handled at once.
MAX_CHARS, ROWS = 1 << 26, 512

_TOKENS = "key bigint, n bigint, ids binary, sketch binary, tokens array<int>, counts array<bigint>"
_PIECES = "key bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


# ---- tokens --------------------------------------------------------------------------------------

class Words:
    """Ids of texts by way of their words; the ids of the words seen are kept until there are ``MAX_WORDS``."""

    def __init__(self, vocabulary: str, end: int):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer, self.end = Tokenizer.from_str(vocabulary), end
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.mark, self.letters = self._encode(_MARK), byte_letters()
        self.clear()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        """Forget all words; number 0 is the end of a text."""
        import numpy as np
        self.code: dict[str, int] = {}
        self.flat, self.used = np.full(1 << 16, self.end, dtype=np.int32), 1
        self.starts, self.sizes = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.sizes[0] = 1

    def _merge(self, word: str) -> list[int]:
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(seen)]

    def _learn(self, words: list[str]) -> None:
        import numpy as np
        easy, hard = [], []
        for w in words:
            (easy if _LETTERS.fullmatch(w) else hard).append(w)
        plain = [w for w in hard if _MARK not in w] if len(self.mark) == 1 else []
        alone = [w for w in hard if _MARK in w] if len(self.mark) == 1 else hard
        # one call for all that need the whole chain, each followed by the mark: a call a word costs several times as much
        joined = np.array(self._encode("".join(f"{w} {_MARK} " for w in plain)), dtype=np.int32)
        ends = np.flatnonzero(joined == (self.mark[0] if plain else -1))
        rest = [*map(self._merge, easy), *map(self._encode, alone)]
        ids = np.concatenate([np.delete(joined, ends), np.array([i for own in rest for i in own], dtype=np.int32)])
        sizes = np.concatenate([np.diff(ends, prepend=-1) - 1, np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))])
        words = [*plain, *easy, *alone]
        first = len(self.code) + 1
        self.code.update(zip(words, range(first, first + len(words))))
        self.flat, self.starts, self.sizes = (
            _room(a, n) for a, n in ((self.flat, self.used + len(ids)), (self.starts, first + len(words)), (self.sizes, first + len(words))))
        self.flat[self.used:self.used + len(ids)] = ids
        self.sizes[first:first + len(words)] = sizes
        self.starts[first:first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def ids(self, texts: pa.Array):
        """(ids, ends): the ids of all texts, each with its end id, and where each text's ids end."""
        import numpy as np
        import pyarrow.compute as pc
        if len(self.code) > MAX_WORDS:
            self.clear()
        texts = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), _LETTER_MARK, r"\1 \2")
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        own = words.dictionary.to_pylist()
        if new := [w for w in own if w not in self.code]:
            self._learn(new)
        codes = np.fromiter(map(self.code.__getitem__, own), dtype=np.int64, count=len(own))[words.indices.to_numpy()]
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        codes = np.insert(codes, np.cumsum(counts), 0)
        sizes = self.sizes[codes]
        return self.flat[spans(self.starts[codes], sizes)], np.cumsum(sizes)[np.cumsum(counts + 1) - 1]


def _room(array, n: int):
    """``array`` with room for ``n`` entries, twice as much as before when it grows."""
    import numpy as np
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), dtype=array.dtype)])


def spans(starts, sizes):
    """Concatenated ranges start .. start + size."""
    import numpy as np
    n = int(sizes.sum())
    kind = np.int32 if n < 1 << 30 and (not len(starts) or int(starts.max()) < 1 << 30) else np.int64
    return np.repeat((starts - np.cumsum(sizes) + sizes).astype(kind), sizes) + np.arange(n, dtype=kind)


def places(size: int):
    """Place of every token of a vocabulary in a random order that favours late entries."""
    import numpy as np
    with np.errstate(over="ignore"):
        x = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
    u = ((x >> np.uint64(11)).astype(np.float64) + 1) / (2 ** 53 + 1)
    clock = -np.log(u) / ((np.arange(size) + 1) / size) ** STEEP
    out = np.empty(size, dtype=np.uint32)
    out[np.argsort(clock, kind="stable")] = np.arange(size, dtype=np.uint32)
    return out


def tokens(docs: DataFrame, key: str, text: str, vocabulary: str, end: int = END) -> DataFrame:
    """(key, n, ids, sketch): ids of the text and the end id, as little-endian 32-bit integers; and rows with n = -1.

    Those have the numbers of documents, of a task, that hold each token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    name = f"retpack{end}" + hashlib.sha256(vocabulary.encode()).hexdigest()

    def run(batches):
        import numpy as np
        words = cached(name, lambda: Words(shared.value, end))
        order = cached(name + "places", lambda: places(words.tokenizer.get_vocab_size()))
        held = np.zeros(len(order), dtype=np.int64)

        def rows(keys, n, ids, sketches, *counts):
            made = [keys, pa.array(n, pa.int64()), ids, pa.array(sketches, pa.binary()), *[pa.array(c, t) for c, t in zip(counts, (pa.list_(pa.int32()), pa.list_(pa.int64())))]]
            return pa.RecordBatch.from_arrays(made, names=["key", "n", "ids", "sketch", "tokens", "counts"])

        for whole in batches:
            bytes_ = np.cumsum(np.nan_to_num(whole.column("size").to_numpy(zero_copy_only=False).astype(np.float64)))
            cuts = np.flatnonzero(np.diff(bytes_ // TEXT_BYTES, prepend=0)).tolist()
            for start, stop in zip([0, *cuts], [*cuts, whole.num_rows]):
                if start == stop:
                    continue
                batch = whole.slice(start, stop - start)
                ids, ends = words.ids(batch.column("t"))
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                sketches = []
                for a, b in zip([0, *ends.tolist()], ends.tolist()):
                    own = np.unique(ids[a:b])
                    held[own] += 1
                    first = order[own]
                    first = np.sort(np.partition(first, SKETCH)[:SKETCH] if len(first) > SKETCH else first)
                    sketches.append(first.astype(">u4").tobytes())
                none = [None] * len(ends)
                yield rows(batch.column("key"), np.diff(ends, prepend=0), made, sketches, none, none)
        at = np.flatnonzero(held)
        yield rows(pa.array([None], pa.int64()), [-1], pa.array([b""], pa.binary()), [b""], [at.astype(np.int32)], [held[at]])

    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("t"), F.octet_length(text).alias("size")).mapInArrow(run, _TOKENS)


def frequencies(table: DataFrame):
    """(documents, tokens, documents that hold each token) from the rows of ``tokens``."""
    import numpy as np
    counts = table.where("n < 0").select(F.explode(F.arrays_zip("tokens", "counts")).alias("c"))
    rows = counts.groupBy(F.col("c.tokens").alias("token")).agg(F.sum("c.counts").alias("n")).toPandas()  # at most a row per vocabulary entry
    docs, size = table.where("n >= 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(int(rows["token"].max()) + 1 if len(rows) else 1, dtype=np.int64)
    df[rows["token"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return docs, size, df


def weights_of(docs: int, df):
    """Inverse document frequency, not below 0: a token in half of all documents tells nothing."""
    import numpy as np
    return np.where(df > 0, np.maximum(0, np.log((docs - df + 0.5) / (df + 0.5))), 0.0)


# ---- windows -------------------------------------------------------------------------------------

class Item:
    """What is left to pack of a document: its tokens from ``start`` on, and the weighted terms of all of it."""

    __slots__ = ("key", "whole", "start", "ids", "terms", "weights")

    def __init__(self, key, whole, start, ids, terms, weights):
        self.key, self.whole, self.start, self.ids, self.terms, self.weights = key, whole, start, ids, terms, weights

    def cut(self, n: int):
        """The first ``n`` tokens and the rest."""
        return (Item(self.key, self.whole, self.start, self.ids[:n], self.terms, self.weights),
                Item(self.key, self.whole, self.start + n, self.ids[n:], self.terms, self.weights))


def item(key, ids, idf, mean: float) -> Item:
    """A document with its BM25 term weights; terms that weigh nothing are left out."""
    import numpy as np
    terms, tf = np.unique(ids, return_counts=True)
    told = idf[terms] > 0
    terms, tf = terms[told], tf[told]
    weights = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
    return Item(key, len(ids), 0, ids, terms, weights)


class Shard:
    """Inverted index over items: postings by term, thinned out when half of the items are used."""

    def __init__(self, items: list):
        import numpy as np
        self.items, self.unused = items, np.ones(len(items), dtype=bool)
        self.lengths = np.array([len(i.ids) for i in items], dtype=np.int64)
        sizes = np.array([len(i.terms) for i in items], dtype=np.int64)
        terms = np.concatenate([i.terms for i in items]) if items else np.zeros(0, dtype=np.int64)
        known, terms = np.unique(terms, return_inverse=True)
        self.ends = np.cumsum(sizes)
        self.terms = terms  # of item i: between ends[i - 1] and ends[i]
        order = np.argsort(terms, kind="stable")
        self.term, self.doc = terms[order], np.repeat(np.arange(len(items)), sizes)[order]
        self.weight = np.concatenate([i.weights for i in items])[order] if items else np.zeros(0)
        self.known, self.live = len(known), len(items)
        self._point()

    def _point(self) -> None:
        import numpy as np
        self.first = np.searchsorted(self.term, np.arange(self.known + 1))
        self.indexed = self.live

    def use(self, i: int) -> None:
        self.unused[i] = False
        self.live -= 1
        if self.live < self.indexed // 2:
            stay = self.unused[self.doc]
            self.term, self.doc, self.weight = self.term[stay], self.doc[stay], self.weight[stay]
            self._point()

    def scores(self, i: int):
        """BM25 of every item for the terms of item ``i``."""
        import numpy as np
        q = self.terms[self.ends[i] - len(self.items[i].terms):self.ends[i]]
        at = spans(self.first[q], self.first[q + 1] - self.first[q])
        return np.bincount(self.doc[at], self.weight[at], minlength=len(self.items))

    def neighbours(self, i: int, space: int) -> list[int]:
        """Unused items by falling score (ties: first come first) until their lengths reach ``space``."""
        import numpy as np
        at = np.flatnonzero(self.unused)
        score = self.scores(i)[at]
        top = 32
        while True:
            if top < len(at):
                least = np.partition(score, len(at) - top)[len(at) - top]
                some = np.flatnonzero(score >= least)
            else:
                some = np.arange(len(at))
            some = some[np.argsort(-score[some], kind="stable")]
            full = np.cumsum(self.lengths[at[some]])
            if top >= len(at) or (len(some) and full[-1] >= space):
                return at[some[:int(np.searchsorted(full, space)) + 1]].tolist()
            top *= 4


def fill(items: list, window: int):
    """(windows, rest): lists of items that fill a window each, and the items of the one left open."""
    shard, out, seed = Shard(items), [], 0
    left, own = None, -1  # the rest of the document cut last, and its number
    while True:
        if left is None:
            while seed < len(items) and not shard.unused[seed]:
                seed += 1
            if seed == len(items):
                return out, []
            own, left = seed, items[seed]
            shard.use(seed)
        made, space, left = [left], window - len(left.ids), None
        if space:
            for i in shard.neighbours(own, space):
                shard.use(i)
                if len(items[i].ids) > space:
                    part, left = items[i].cut(space)
                    made.append(part)
                    own, space = i, 0
                    break
                made.append(items[i])
                space -= len(items[i].ids)
                if not space:
                    break
        if space:
            return out, made
        out.append(made)


def powers(items: list) -> list[list]:
    """``items`` in order as sequences of falling powers of two."""
    total, out = sum(len(i.ids) for i in items), []
    items = items[::-1]
    for k in reversed(range(total.bit_length())):
        if total >> k & 1:
            space, made = 1 << k, []
            while space:
                one = items.pop()
                if len(one.ids) > space:
                    one, rest = one.cut(space)
                    items.append(rest)
                made.append(one)
                space -= len(one.ids)
            out.append(made)
    return out


def pack(docs: DataFrame, key: str, text: str, vocabulary: str, window: int = WINDOW, end: int = END,
         shard_tokens: int = SHARD_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row per piece: key, its start in the document, its length and ids, and its place in a sequence.

    ``ids`` are little-endian 32-bit integers; ``sequence_id`` is unique over the table, and ``offset`` counts from 0.
    ``window`` is a power of two.
    """
    table = cut_lineage(tokens(docs, key, text, vocabulary, end))
    n_docs, n_tokens, df = frequencies(table)
    ranges = max(1, math.ceil(n_tokens / range_tokens))
    rows = table.where("n >= 0").select("key", "ids", "sketch", F.xxhash64("ids").alias("digest"))
    ordered = rows.repartitionByRange(ranges, "sketch", "key", "digest")
    ordered = ordered.sortWithinPartitions("sketch", "key", "digest").select("key", "ids")
    mean = max(n_tokens / max(n_docs, 1), 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights_of(n_docs, df))  # a number per vocabulary entry

    def run(batches):
        import numpy as np
        from pyspark import TaskContext
        idf, number = shared.value, TaskContext.get().partitionId() << 32

        def rows(sequences):
            nonlocal number
            out = {"key": [], "start": [], "length": [], "ids": [], "doc_tokens": [], "sequence_id": [], "offset": []}
            for made in sequences:
                offset = 0
                for one in made:
                    for name, value in zip(out, (one.key, one.start, len(one.ids), one.ids.tobytes(), one.whole, number, offset)):
                        out[name].append(value)
                    offset += len(one.ids)
                number += 1
            types = [pa.binary() if name == "ids" else pa.int64() for name in out]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

        items, held = [], 0
        for batch in batches:
            for k, blob in zip(batch.column("key").to_pylist(), batch.column("ids")):
                one = item(k, np.frombuffer(blob.as_buffer(), dtype=np.int32).copy(), idf, mean)
                whole = []
                while len(one.ids) >= window:
                    part, one = one.cut(window)
                    whole.append([part])
                if whole:
                    yield rows(whole)
                if len(one.ids):
                    items.append(one)
                    held += len(one.ids)
                if held >= shard_tokens:
                    made, items = fill(items, window)
                    held = sum(len(i.ids) for i in items)
                    yield rows(made)
        made, items = fill(items, window)
        yield rows([*made, *powers(items)])

    return ordered.mapInArrow(run, _PIECES)
