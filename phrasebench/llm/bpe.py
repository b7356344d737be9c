"""Byte-level BPE encoding and decoding of whole texts with a local rank file.

Cases: a null text encodes like an empty one (no ids) and no ids decode to no bytes; repeated rows are
encoded each for itself; an empty table gives an empty table. Other columns are carried through; a column
of the output's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phrasebench.llm.workers import cached

#: A text longer than this is cut at safe boundaries before it is encoded.
PIECE_CHARS = 1 << 16
#: Rows handled and handed on at once; an Arrow batch holds up to 10,000.
ROWS = 256
#: A letter or digit followed by a space or line feed: no match of the pre-split pattern spans this point,
#: because white space only ever starts a match or stands in a match of white space alone.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


def read_ranks(path: str) -> bytes:
    """The rank file's bytes (under 1 MB for a vocabulary of 50,000), to be sent to the workers once."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str):
    """The encoder, built once per worker process."""
    name = hashlib.sha256(ranks + pattern.encode()).hexdigest()

    def make():
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})

    return cached(name, make)


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """``text`` cut at the first safe boundary after every ``size`` characters; encoding is the same."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        out.append(text[start:cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def _parts(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _list_column(parts: list, kind: pa.DataType) -> pa.Array:
    import numpy as np
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def _replace(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], column], names=[*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, text: str, ranks: bytes, pattern: str, out: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text``; each match of ``pattern`` is merged separately.

    Works batch by batch inside the scan's tasks: no shuffle, memory of one Arrow batch.
    """
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches):
        import numpy as np
        enc = encoder(*shared.value)
        for batch in _parts(batches):
            made = []
            for value in batch.column(text).to_pylist():
                value = value or ""
                if len(value) > PIECE_CHARS:
                    ids = [i for p in pieces(value) for i in enc.encode_ordinary(p)]
                else:
                    ids = enc.encode_ordinary(value)
                made.append(np.array(ids, dtype=np.int32))
            yield _replace(batch, out, _list_column(made, pa.int32()))

    return df.mapInArrow(run, _schema(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str, ranks: bytes, pattern: str, out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of ``ids``; bytes, because a list of ids need not end on a whole character."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches):
        enc = encoder(*shared.value)
        for batch in _parts(batches):
            column = batch.column(ids)
            flat, ends = column.values.to_numpy(), column.offsets.to_pylist()
            made = [enc.decode_bytes(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield _replace(batch, out, pa.array(made, type=pa.binary()))

    return df.mapInArrow(run, _schema(df, out, T.BinaryType()))


def digest(df: DataFrame, key: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Count of the ids, and digests of the ids (decimal, joined by spaces) and of the decoded bytes."""
    return df.select(
        key, F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"))
