"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Reading cuts the files at ``CRLF CRLF WARC/1.``, which Spark's text source does in parallel, inside large files too.
Every cut is a candidate; its task reads the header and emits (offset, offset of the successor), which the content
length fixes. Pointer jumping from each file's start then keeps the candidates that a chain of lengths reaches: a
round marks the successors of all marked candidates and replaces every pointer by its pointer's pointer, so a file
of n records takes log2(n) rounds over narrow rows. Record magic inside a payload is never reached, and the pieces
it cut the payload into are put together again.

Writing: of records with equal payloads of at least ``min_bytes`` bytes, that with the largest key is a response, the
others are revisits without payload that refer to it.

Cases: a null payload is an empty one; a null URI is left out; line ends in a URI are escaped; rows without key
are responses; equal rows with one key are all responses; a candidate without content length ends its chain, and so
does a length that leads to no candidate; a record that its file's end cuts off has the bytes that are there; an
empty table writes and reads no record.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from phrasebench.session import cut_lineage

# Line ends and magic of the format, and the two base-32 alphabets.
END, MAGIC = "\r\n\r\n", "WARC/1."
HEX32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of one archive at most; a compressed archive is read by one task.
FILE_RECORDS = 20_000
#: Splits up to which the table of their starts, about 150 bytes a row, is broadcast.
FEW_SPLITS = 20_000
KEY_HEADER = "X-Record-Key"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: every five hex digits are four of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, RFC32)


def record_id(key: Column) -> Column:
    h = F.md5(F.concat(F.lit("record|"), key.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def write(rows: DataFrame, path: str, key: str, uri: str, payload: str, min_bytes: int = 0,
          date: str = "2024-01-01T00:00:00Z", compression: str = "none") -> None:
    """Write one record per row. ``compression``: none or gzip (then a file is one stream and one read task)."""
    made = rows.select(F.col(key).alias("k"), F.col(uri).cast("string").alias("u"), F.coalesce(F.col(payload), F.lit("")).alias("p"))
    made = made.withColumn("d", payload_digest(F.col("p").cast("binary"))).withColumn("n", F.octet_length("p"))
    narrow = made.where(f"k IS NOT NULL AND n >= {int(min_bytes)}").select("k", "d")
    holders = narrow.groupBy("d").agg(F.max("k").alias("h"), F.count("*").alias("c")).where("c > 1").select("d", "h")
    again = narrow.join(holders, "d").where("k <> h").select("k", "h").distinct()
    made = made.join(again, "k", "left")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    none = F.lit("")
    escaped = F.replace(F.replace(F.col("u"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC + "1\r\n"), line("WARC-Type", F.when(F.col("h").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", F.coalesce(record_id(F.col("k")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", F.lit(date)), F.coalesce(line("WARC-Target-URI", escaped), none),
        F.coalesce(line(KEY_HEADER, F.col("k").cast("string")), none), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "d")),
        F.coalesce(line("WARC-Refers-To", record_id(F.col("h"))), none), line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("h").isNull(), F.col("n")).otherwise(0).cast("string")))
    record = F.concat(head, F.lit("\r\n"), F.when(F.col("h").isNull(), F.col("p")).otherwise(""))
    made.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).option(
        "maxRecordsPerFile", FILE_RECORDS).text(path)


# ---- reading -------------------------------------------------------------------------------------

_CUT = END + MAGIC
_LENGTH = re.compile(rb"\r\n[Cc]ontent-[Ll]ength:[ \t]*(\d+)[ \t]*(?=\r\n|\Z)")
CANDIDATES = ("file string, block bigint, at bigint, size bigint, head bigint, length bigint, "
              "headers map<string,string>, raw binary")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per cut: where it lies in its split, header length, content length (null for no header), raw bytes."""
    cut = spark.read.option("lineSep", _CUT).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))

    def run(batches):
        split, at, rows = None, 0, []
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("head", pa.int64()),
                            ("length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("raw", pa.binary())])
        for batch in batches:
            for file, block, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "raw"))):
                fine = True
                if split != (file, block):
                    split, at = (file, block), 0
                    fine = block > 0 or raw.startswith(MAGIC.encode())
                    if block == 0:  # the first record has no end of another before it
                        raw, at = (raw[len(MAGIC):], -len(END)) if fine else (raw, -len(_CUT))
                size = len(_CUT) + len(raw)
                # a header whose payload starts with magic ends where the cut begins
                end = raw.find(b"\r\n\r\n") if END.encode() in raw else len(raw)
                found = _LENGTH.search(raw, 0, end + 2) if fine else None
                headers = None
                if found:
                    lines = [x.split(b":", 1) for x in raw[:end].split(b"\r\n")[1:] if b":" in x]
                    headers = list({a.strip().decode(errors="replace"): b.strip().decode(errors="replace") for a, b in lines}.items())
                rows.append({"file": file, "block": block, "at": at, "size": size, "head": end + 4 if found else None,
                             "length": int(found[1]) if found else None, "headers": headers, "raw": raw})
                at += size
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return cut.mapInArrow(run, CANDIDATES)


def split_starts(cuts: DataFrame) -> DataFrame:
    """(file, block, base): where each split's first cut lies in its file; a row a split, broadcast while there are few."""
    ends = cuts.groupBy("file", "block").agg(F.max(F.col("at") + F.col("size")).alias("s"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = cut_lineage(ends.select("file", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base")))
    return F.broadcast(base) if base.count() <= FEW_SPLITS else base


def placed(cuts: DataFrame, base: DataFrame) -> DataFrame:
    """Adds ``offset`` (of the cut's magic in its file) and ``next`` (of its successor), from the sizes of earlier splits."""
    after = F.col("offset") + F.lit(len(MAGIC)) + F.col("head") + F.col("length") + F.lit(len(END))
    return (cuts.join(base, ["file", "block"]).withColumn("offset", F.col("base") + F.col("at") + F.lit(len(END)))
            .withColumn("next", after).drop("base", "at", "size", "block"))


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) that a chain of (file, offset, next) reaches from offset 0, by pointer jumping."""
    real = links.select("file", F.col("offset").alias("next"), F.lit(True).alias("real"))
    state = links.join(real, ["file", "next"], "left").select("file", "offset", F.when(F.col("real"), F.col("next")).alias("next"), (F.col("offset") == 0).alias("on"))
    state, marked = cut_lineage(state), -1
    while True:
        count = state.where("on").count()
        if count == marked:
            return state.where("on").select("file", "offset")
        marked = count
        jump = state.select("file", F.col("offset").alias("next"), F.col("next").alias("far"))
        hit = state.where("on AND next IS NOT NULL").select("file", F.col("next").alias("offset"), F.lit(True).alias("hit"))
        state = cut_lineage(state.join(jump, ["file", "next"], "left").join(hit, ["file", "offset"], "left").select(
            "file", "offset", F.col("far").alias("next"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: file, offset, headers, payload. Magic inside payloads is not taken for a record.

    The cuts are written once; chains are found on their narrow columns. Payloads are only regrouped for records
    whose payload holds a cut.
    """
    cuts = cut_lineage(candidates(spark, path))
    number = F.xxhash64("file").alias("f")  # paths are long; rounds carry eight bytes for them
    base = split_starts(cuts.select("file", "block", "at", "size"))
    narrow = cut_lineage(placed(cuts.drop("raw", "headers"), base).select(number, "offset", "next", "length"))
    good = reachable(narrow.where("length IS NOT NULL").select(F.col("f").alias("file"), "offset", "next"))
    false = narrow.join(good.withColumnRenamed("file", "f"), ["f", "offset"], "left_anti").select("f", "offset")
    false = cut_lineage(false)
    rows = placed(cuts, base).withColumn("f", number)
    whole = F.coalesce(F.octet_length("raw") >= F.col("head") + F.col("length"), F.lit(False))
    own = F.substring(F.col("raw"), F.col("head").cast("int") + 1, F.col("length").cast("int"))
    if false.isEmpty():
        return rows.select("file", "offset", "headers", own.alias("payload"))
    simple = rows.where(whole).join(false, ["f", "offset"], "left_anti").select("file", "offset", "headers", own.alias("payload"))
    marked = rows.join(false.withColumn("false", F.lit(True)), ["f", "offset"], "left").where(F.col("false") | ~whole)
    owner = F.max(F.when(F.col("false").isNull(), F.col("offset"))).over(W.partitionBy("file").orderBy("offset"))
    piece = F.struct("offset", F.when(F.col("false"), F.concat(F.lit(_CUT).cast("binary"), "raw")).otherwise(F.col("raw")).alias("raw"))
    parts = marked.withColumn("owner", owner).where("owner IS NOT NULL").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(piece)).alias("p"), F.max_by("headers", F.col("false").isNull()).alias("headers"),
        F.max(F.when(F.col("false").isNull(), F.col("head"))).alias("head"), F.max(F.when(F.col("false").isNull(), F.col("length"))).alias("length"))
    joined = F.aggregate(F.col("p")["raw"], F.lit(b""), lambda a, x: F.concat(a, x))
    broken = parts.select("file", F.col("owner").alias("offset"), "headers", F.substring(
        joined, F.col("head").cast("int") + 1, F.col("length").cast("int")).alias("payload"))
    return simple.union(broken)
