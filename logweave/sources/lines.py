"""Line source: files of any extension as ordered, numbered, classified lines.

Rows are ``input_index int, file string, line_no bigint (from 1), value string``; ``classify``
adds ``entry map<string,string>``, NULL for a raw line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from logweave.sources.files import file_size, last_byte, uri

LINE = T.StructType([
    T.StructField("input_index", T.IntegerType()), T.StructField("file", T.StringType()),
    T.StructField("line_no", T.LongType()), T.StructField("value", T.StringType()),
])
#: Names that Spark's listing skips or decompresses; such files are read by byte ranges instead.
_SPECIAL_NAME = re.compile(r"(^|/)[_.][^/]*$|\.(gz|bz2|zst|lz4|snappy|deflate)$")
RANGE_BYTES, _READ, _BATCH = 64 << 20, 1 << 20, 4 << 20


def escape_glob(path: str) -> str:
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def strip_cr(value: Column) -> Column:
    """Drops the one carriage return of a CRLF pair; the line feed is already gone. Works on bytes, so invalid UTF-8 stays as it is."""
    shorter = F.substring(value.cast("binary"), F.lit(1), F.octet_length(value) - 1).cast("string")
    return F.when(F.endswith(value, F.lit("\r")), shorter).otherwise(value)


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of the files in the order given; the same path twice counts twice.

    A carriage return goes only together with the line feed after it: an unterminated last line keeps its own.
    """
    if not paths:
        return spark.createDataFrame([], LINE)
    plain = [p for p in dict.fromkeys(paths) if not _SPECIAL_NAME.search(p)]
    parts = [_by_ranges(spark, p) for p in dict.fromkeys(paths) if _SPECIAL_NAME.search(p)]
    if plain:  # one scan, however many files
        lines = spark.read.option("lineSep", "\n").text([escape_glob(p) for p in plain])
        parts.append(lines.select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"))
    lines = reduce(DataFrame.unionByName, parts)
    # Two passes and no shuffle of text: ids run on within a block, so a block needs only its first id and the lines before it.
    blocks = lines.groupBy("at", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("at").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("at", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy("at")).alias("total"))
    inputs = [(i, p, uri(spark, p), last_byte(spark, p) == 13) for i, p in enumerate(paths)]
    blocks = blocks.join(F.broadcast(spark.createDataFrame(inputs, "input_index int, file string, at string, bare boolean")), "at")
    line_no = F.col("base") + F.col("id") - F.col("first") + 1
    rows = lines.join(F.broadcast(blocks), ["at", "block"])  # a row for each split of each file
    keeps = F.col("bare") & (line_no == F.col("total"))
    return rows.select("input_index", "file", line_no.alias("line_no"), F.when(keeps, F.col("value")).otherwise(strip_cr(F.col("value"))).alias("value"))


def lines_in(f, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end) of an open file, without their line feeds; the last may reach beyond."""
    at = max(start - 1, 0)
    f.seek(at)
    begun: list[bytes] | None = [] if start == 0 else None  # of the line under way; None up to the line feed that ends the one before
    while data := f.read(_READ):
        first, *others = data.split(b"\n")
        if begun is not None:
            begun.append(first)
        if others:
            if begun is not None:
                line = b"".join(begun)
                yield line
                at += len(line) + 1
            else:
                at += len(first) + 1
            for line in others[:-1]:
                if at >= end:
                    return
                yield line
                at += len(line) + 1
            begun = [others[-1]]
            if at >= end:
                return
        elif begun is None:
            at += len(first)
    if begun and at < end and (line := b"".join(begun)):
        yield line


def _by_ranges(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """``(at, block, id, value)`` of a file whatever its name: tasks read byte ranges and own the lines that begin inside."""
    size, step, name = file_size(spark, path), range_bytes or RANGE_BYTES, uri(spark, path)
    n = -(-size // step)
    starts = spark.range(n).select((F.col("id") * step).alias("block")).repartition(max(1, n), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
        for batch in batches:
            for start in batch.column("block").to_pylist():
                with fs.open_input_file(where) as f:
                    held, held_bytes, done = [], 0, 0

                    def rows() -> pa.RecordBatch:
                        return pa.RecordBatch.from_arrays([pa.array([start] * len(held), pa.int64()), pa.array(range(done, done + len(held)), pa.int64()), pa.array(held, pa.binary())], ["block", "id", "value"])  # noqa: B023

                    for line in lines_in(f, start, start + step):
                        held.append(line)
                        held_bytes += len(line)
                        if held_bytes >= _BATCH or len(held) >= 10_000:
                            yield rows()
                            done, held, held_bytes = done + len(held), [], 0
                    yield rows()

    rows = starts.mapInArrow(run, "block bigint, id bigint, value binary")
    return rows.select(F.lit(name).alias("at"), "block", "id", F.col("value").cast("string").alias("value"))


def split_text(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines of a multi-line column: ``keep`` columns, position ``pos`` (from 0) and ``value``. NULL text has no lines; the last one has no terminator."""
    lines = F.split(F.col(text), "\n")
    rows = df.select(*keep, F.size(lines).alias("n_lines"), F.posexplode(lines).alias("pos", "raw"))
    return rows.select(*keep, "pos", F.when(F.col("pos") + 1 == F.col("n_lines"), F.col("raw")).otherwise(strip_cr(F.col("raw"))).alias("value"))


def classify(df: DataFrame) -> DataFrame:
    """Adds ``entry``: the exact text of each field of a line that is one JSON object, else NULL."""
    from logweave.functions.jsontext import exact_entry

    candidate = F.contains("value", F.lit("{")) & F.is_valid_utf8("value")
    return df.withColumn("entry", exact_entry(F.when(candidate, F.col("value"))))
