"""Readers: config/split layout, delimited text, banks, vectors, lexical indexes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phrasebench.operators.blockmax import open_blocks
from phrasebench.operators.lexical import LexicalIndex
from phrasebench.session import open_bucketed, read_table

__all__ = ["read_table", "load_split", "first_split", "catalogue", "read_csv", "inline_table",
           "read_vectors", "read_lexical_index", "read_config"]


def load_split(spark: SparkSession, root: str, config: str, split: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A dataset's split: the parquet folder ``root/config/split``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{config}/{split}")


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``: path and length, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length").where(~F.col("path").rlike(r"/[_.][^/]*$"))


def _folders(fs, path) -> list:
    """Visible folders below ``path``, by name."""
    found = [f.getPath() for f in fs.listStatus(path) if f.isDirectory() and f.getPath().getName()[0] not in "_."]
    return sorted(found, key=lambda f: f.getName())


def _visible_files(fs, path) -> list[int]:
    """Lengths of the files below ``path``, empty ones included."""
    files, sizes = fs.listFiles(path, True), []
    while files.hasNext():
        one = files.next()
        if one.getPath().getName()[0] not in "_.":
            sizes.append(one.getLen())
    return sizes


def _fault(spark: SparkSession, root: str, config: str, split: str) -> str | None:
    """Why a split cannot be opened; None when its schema can be read."""
    try:
        spark.read.parquet(f"{root}/{config}/{split}").schema  # noqa: B018  (footers only)
    except Exception as e:  # whatever the files are, the catalogue goes on with the next split
        return f"cannot be opened: {str(e).splitlines()[0][:200]}"
    return None


def catalogue(spark: SparkSession, root: str, check: bool = True) -> DataFrame:
    """(config, split, files, bytes, error) for every ``root/config/split``.

    An empty split, and with ``check`` one whose files are no parquet, is a row with an error; the others go on.
    """
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)  # a listing, on whatever store the root is
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []  # one per split
    for config in _folders(fs, top):
        for split in _folders(fs, config):
            sizes = _visible_files(fs, split)
            names = (config.getName(), split.getName())
            fault = "empty split" if not sum(sizes) else _fault(spark, root, *names) if check else None
            rows.append((*names, len(sizes), sum(sizes), fault))
    return spark.createDataFrame(rows, "config string, split string, files bigint, bytes bigint, error string")


def first_split(spark: SparkSession, root: str, config: str) -> str:
    """Name of the first available split of a config."""
    row = catalogue(spark, root, check=False).where((F.col("config") == config) & F.col("error").isNull()).orderBy("split").first()
    if row is None:
        raise FileNotFoundError(f"no split under {root}/{config}")
    return row["split"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text with a header, quoted line breaks and an optional byte-order mark."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.csv(path) if schema is None else reader.schema(schema).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_lexical_index(spark: SparkSession, path: str) -> LexicalIndex:
    """An index as ``write_lexical_index`` left it; nothing is read but its description."""
    meta = read_config(spark, f"{path}/meta")
    by_doc = {n: open_bucketed(spark, f"{path}/{n}", "doc_id", meta["facts"]["buckets"], meta["columns"][n]) for n in ("postings", "norms", "places")}
    terms = spark.read.schema(meta["columns"]["terms"]).parquet(f"{path}/terms")
    blocks, tops = open_blocks(spark, f"{path}/blocks", dict(c.split(" ", 1) for c in meta["columns"]["blocks"].split(", ")))
    return LexicalIndex(documents=spark.read.parquet(f"{path}/documents"), facts=meta["facts"], terms=terms, blocks=blocks, tops=tops, **by_doc)


def read_config(spark: SparkSession, path: str) -> dict:
    """A one-row JSON config as a dict."""
    return json.loads(spark.read.text(path).first()["value"])
