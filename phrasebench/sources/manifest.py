"""Artifact manifests and the check that what they list is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasebench.sources.tables import _listing


def manifest(spark: SparkSession, artifacts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(artifact, format, n_rows, path) for name → (path, table)."""
    out = None
    for name, (path, df) in artifacts.items():
        row = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("artifact"), F.lit(path.rsplit(".", 1)[-1]).alias("format"),
            "n_rows", F.lit(path).alias("path"))
        out = row if out is None else out.unionByName(row)
    return out


def check_artifacts(spark: SparkSession, expected: DataFrame, root: str) -> DataFrame:
    """``expected`` (artifact, path relative to root) with status ok / empty / missing."""
    prefix = root.rstrip("/")
    relative = F.substr(F.col("path"), F.instr(F.col("path"), prefix + "/") + F.lit(len(prefix) + 1))  # no pattern is made of the root
    files = _listing(spark, root).select(relative.alias("file"), "length")
    # a listed path is a file, or the folder of a table's part files
    steps = F.split("file", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    found = files.select(F.explode(levels).alias("path"), "length").groupBy("path").agg(
        F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
    status = F.when(F.col("n_files").isNull(), "missing").when(F.col("bytes") == 0, "empty").otherwise("ok")
    return expected.join(found, "path", "left").select(
        "artifact", "path", F.coalesce("n_files", F.lit(0)).alias("n_files"), status.alias("status"))


def require_artifacts(spark: SparkSession, expected: DataFrame, root: str) -> None:
    """Raise, naming what is missing."""
    missing = check_artifacts(spark, expected, root).where(F.col("status") != "ok").select("artifact")
    names = [r["artifact"] for r in missing.collect()]
    if names:
        raise FileNotFoundError("missing artifacts: " + ", ".join(sorted(names)))
