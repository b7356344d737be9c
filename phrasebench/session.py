"""Session set-up, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "phrasebench", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and skew-join handling on; other settings stay the cluster's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a throw-away one only for a local master that names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="phrasebench-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/phrasebench-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """What a job within shuffles goes from disk when the job ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Later uses see the same rows, a lost executor costs a re-read, and Spark knows the table's size.
    """
    path = scratch_path(df.sparkSession, "cut")
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer pieces than there are cores, as one small file does.

    A large table has more pieces than that and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bucket_count(spark: SparkSession, size: int, per_bucket: int = 64 * 1024 * 1024) -> int:
    """Buckets for ``size`` bytes: one per 64 MB, at least one per core; Spark's own bound is raised where it is lower."""
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // per_bucket))
    if buckets > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(buckets))
    return buckets


def store_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` hashed by ``key`` into bucket files under ``path`` and open it as a table.

    Joins and aggregates that include ``key`` then need no shuffle, in this job or a later one.
    """
    spark = df.sparkSession
    name = f"phrasebench_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.format("parquet").mode("overwrite").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return _forget_at_exit(spark, name)


def open_bucketed(spark: SparkSession, path: str, key: str, buckets: int, ddl: str) -> DataFrame:
    """Open bucket files written by an earlier job, keeping their partitioning."""
    name = f"phrasebench_{uuid.uuid4().hex}"
    quoted = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    return _forget_at_exit(spark, name)


def _forget_at_exit(spark: SparkSession, name: str) -> DataFrame:
    """The table, whose catalog entry (not its files) goes when the driver ends."""
    def drop() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session may have ended before, and with it an in-memory catalog
            pass
    atexit.register(drop)
    return spark.table(name)


def _column_bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(c) + F.lit(16)
    elif isinstance(field.dataType, T.ArrayType):
        size = F.size(c) * F.lit(16) + F.lit(16)
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(8)).cast("long")


def measured_bytes(df: DataFrame) -> int:
    """Estimated in-memory size of ``df``: one aggregate over the data, one row back."""
    total = sum((_column_bytes(f) for f in df.schema.fields), F.lit(0).cast("long"))
    return df.agg(F.sum(total).alias("b")).first()["b"] or 0


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")
