"""Ordered merge and stable sort of logs as key construction plus one range sort.

Raw lines travel with an entry of their own input, so a line's key is the timestamp of the next
entry. Neighbouring timestamps are filled in two levels (inside chunks of lines, then over one
row per chunk), so a single huge input still spreads over many tasks.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logweave.functions.jsontext import TIMESTAMP, canonical_json
from logweave.plans.materialize import materialize
from logweave.sources.files import file_size
from logweave.sources.lines import read_log
from logweave.sources.sink import output_collides, write_lines

CHUNK_LINES = 1 << 19
#: Rows of the table of chunks that may be broadcast; that many stand for 5e11 lines.
BROADCAST_CHUNKS = 1_000_000


@dataclass
class LogOrderError(Exception):
    """A broken input contract: ``file:line: reason``, or ``file: reason`` for line 0."""

    file: str
    line: int
    reason: str

    def __str__(self) -> str:
        return f"{self.file}:{self.line}: {self.reason}" if self.line else f"{self.file}: {self.reason}"


def origin(path: str) -> str:
    return os.path.basename(path.rstrip("/")) or path


def prepare(df: DataFrame, stamp: bool = False, system: Column | None = None) -> DataFrame:
    """Adds ``is_entry``, ``ts`` and the output ``text``; invalid UTF-8 becomes a raw line here and a violation later."""
    valid = F.is_valid_utf8("value")
    system = (F.element_at(F.split(F.col("file"), "/"), -1) if system is None else system) if stamp else None
    return df.withColumn("json", canonical_json(F.when(valid, F.col("value")), system)).select(
        *df.columns, (F.col("json.is_entry") & valid).alias("is_entry"), F.col("json.ts").alias("ts"), F.col("json.text").alias("text"), valid.alias("valid_utf8")
    )


def with_neighbours(df: DataFrame, chunk_lines: int = CHUNK_LINES, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Adds ``prev_ts`` (last timestamp strictly before), ``next_ts`` (this or next) and ``last_ts`` of the input."""
    df = df.withColumn("chunk", F.floor(F.col(order[0]) / chunk_lines))
    # A frame that only grows is updated row by row; one open to the end is recomputed for every row, so "next" looks back in falling order.
    inside = W.partitionBy("input_index", "chunk").orderBy(*order)
    falling = W.partitionBy("input_index", "chunk").orderBy(*(F.desc(c) for c in order))
    df = df.select(
        "*",
        F.last("ts", True).over(inside.rowsBetween(W.unboundedPreceding, -1)).alias("p"),
        F.last("ts", True).over(falling.rowsBetween(W.unboundedPreceding, 0)).alias("n"),
    )
    df = materialize(df)  # after its one shuffle; read three times below
    key = F.struct(*order)
    ends = df.where(F.col("ts").isNotNull()).groupBy("input_index", "chunk").agg(F.min_by("ts", key).alias("head"), F.max_by("ts", key).alias("tail"))
    every = df.select("input_index", "chunk").distinct().join(ends, ["input_index", "chunk"], "left")
    across = W.partitionBy("input_index").orderBy("chunk")
    every = every.select(
        "input_index", "chunk",
        F.last("tail", True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("cp"),
        F.last("head", True).over(W.partitionBy("input_index").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)).alias("cn"),
        F.last("tail", True).over(across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("last_ts"),
    )
    every = materialize(every)
    if every.count() <= BROADCAST_CHUNKS:
        every = F.broadcast(every)
    return df.join(every, ["input_index", "chunk"]).select(
        *[c for c in df.columns if c not in ("p", "n", "chunk")], F.coalesce("p", "cp").alias("prev_ts"), F.coalesce("n", "cn").alias("next_ts"), "last_ts"
    )


def merge_key(order: tuple[str, ...] = ("line_no",)) -> list[Column]:
    """Raws precede the next entry of their input; trailing raws follow its last entry; inputs without entries come last."""
    k = F.coalesce("next_ts", "last_ts")
    return [k.isNull(), k, F.col("input_index"), *map(F.col, order)]


def sort_key(order: tuple[str, ...] = ("line_no",)) -> list[Column]:
    """As for the merge, but trailing raws of every input follow all entries."""
    return [F.col("next_ts").isNull(), F.col("next_ts"), F.col("input_index"), *map(F.col, order)]


def number_rows(df: DataFrame, keys: list, name: str, first: int = 1) -> DataFrame:
    """Global positions in key order: one range shuffle, sorted partitions stored, and a place in each plus the rows before it."""
    ranged = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    place = ranged.withColumn("place", F.monotonically_increasing_id())  # the partition's number and the row's place in it
    part = F.shiftright("place", 33)
    counts = place.groupBy(part.alias("part")).count()
    base = counts.select("part", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = place.join(F.broadcast(base), part == base["part"])  # a row for each partition
    return rows.select(*df.columns, (F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + first).alias(name))


def violations(df: DataFrame, ordered: bool) -> DataFrame:
    """Lines that break the contract: ``input_index, file, line_no, reason, prev_ts``. Needs prepare and with_neighbours."""
    missing = F.col("is_entry") & F.col("ts").isNull()
    reason = F.when(~F.col("valid_utf8"), "invalid UTF-8").when(missing, f"entry without a string {TIMESTAMP}")
    if ordered:
        reason = reason.when(F.col("ts") < F.col("prev_ts"), f"{TIMESTAMP} is earlier than the previous entry's")
    return df.select("input_index", "file", "line_no", reason.alias("reason"), "prev_ts").where(F.col("reason").isNotNull())


def first_violation(df: DataFrame, ordered: bool) -> LogOrderError | None:
    """The violation a sequential reader meets first.

    A merge meets each input's first one when the entry before it is the smallest head; a sort reads inputs in turn.
    """
    bad = violations(df, ordered)
    if ordered:
        by_input = bad.groupBy("input_index").agg(F.min_by(F.struct("file", "line_no", "reason", "prev_ts"), "line_no").alias("v"))
        bad = by_input.select("input_index", "v.*").orderBy(F.col("prev_ts").isNotNull(), "prev_ts", "input_index")
    else:
        bad = bad.orderBy("input_index", "line_no")
    row = bad.limit(1).collect()
    return LogOrderError(row[0]["file"], row[0]["line_no"], row[0]["reason"]) if row else None


def _require_files(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        try:
            file_size(spark, p)
        except OSError as e:
            raise LogOrderError(p, 0, str(e).removeprefix(f"{p}: ")) from e


def _run(spark: SparkSession, inputs: list[str], output: str, merge: bool) -> int:
    if (clash := output_collides(spark, inputs, output)) is not None:
        raise LogOrderError(output, 0, f"output is also input {clash}")
    _require_files(spark, inputs)
    lines = with_neighbours(prepare(read_log(spark, *inputs), stamp=merge))
    if (bad := first_violation(lines, ordered=merge)) is not None:
        raise bad
    return write_lines(lines.orderBy(*(merge_key() if merge else sort_key())).select("text"), output)


def merge_files(spark: SparkSession, inputs: list[str], output: str) -> int:
    """Merges time-ordered logs, stamping entries with their origin; returns the number of lines written."""
    return _run(spark, inputs, output, True)


def sort_files(spark: SparkSession, inputs: list[str], output: str) -> int:
    """Sorts logs of any entry order by timestamp, unstamped; returns the number of lines written."""
    return _run(spark, inputs, output, False)
