"""Schema discovery, projection and cell rendering over classified lines."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.query import field_text

DEFAULT_COLUMNS = ("@timestamp", "level", "message")
CELL_CHARS, DETAIL_CHARS = 5000, 20000


def discover_fields(df: DataFrame) -> DataFrame:
    """Union of the top-level keys of all entries: one column ``field``, sorted."""
    return df.select(F.explode(F.map_keys("entry")).alias("field")).distinct().orderBy("field")


def default_columns(fields: list[str]) -> list[str]:
    present = [c for c in DEFAULT_COLUMNS if c in set(fields)]
    return present or sorted(fields)[:3]


def choose_columns(fields: list[str], saved: list[str] | None) -> list[str]:
    """A saved selection, even an empty one, wins over the defaults."""
    return list(saved) if saved is not None else default_columns(fields)


def truncate(text: Column, limit: int = CELL_CHARS) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def cell(name: str, entry: Column | None = None) -> Column:
    return F.coalesce(field_text(F.col("entry") if entry is None else entry, name), F.lit(""))


def project(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Cells as ``c0, c1, ...`` (field names may differ only in case, column names may not).

    A raw line shows its text in the first cell; with no columns every row is its text, as ``raw``.
    """
    text = F.make_valid_utf8("value")
    if not columns:
        return df.select(*keep, truncate(text).alias("raw"))
    raw = F.col("entry").isNull()
    cells = [F.when(raw, text if i == 0 else F.lit("")).otherwise(cell(c)) for i, c in enumerate(columns)]
    return df.select(*keep, *(truncate(c).alias(f"c{i}") for i, c in enumerate(cells)))


def severity(df: DataFrame) -> Column:
    """``error``, ``warn`` or NULL from a string field ``level``; compared in ASCII lower case."""
    level = F.lower(F.element_at("entry", F.lit("level")))
    return F.when(level == "error", "error").when(level.isin("warn", "warning"), "warn")


def matches_field_filter(name: Column, text: str) -> Column:
    return F.contains(F.lower(name), F.lit(text.strip().lower()))


def row_mapping(df: DataFrame) -> DataFrame:
    """Adds ``row`` (from 0), the position of a line among the rows shown.

    Partition offsets come from per-partition counts, so no task sees more than its own range.
    """
    from logweave.operators.ordering import number_rows

    return number_rows(df, ["line_no"], "row", 0)


#: Rows that a task may hold to find a page among the first ones, and ranges of line numbers that are counted for a later one.
NEAR_ROWS, RANGES = 1 << 16, 4096


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """``limit`` rows in line order after the first ``offset``.

    Far from the start the rows are counted by ranges of line numbers, finer each time, until the page's own range is small;
    so no task gathers what stands before the page.
    """
    low, high = None, None
    while offset + limit > NEAR_ROWS:
        own = df if low is None else df.where(F.col("line_no").between(low, high))
        if low is None:
            low, high = own.agg(F.min("line_no"), F.max("line_no")).first()
            if low is None:
                return df.limit(0)
        step = -(-(high - low + 1) // RANGES)
        counts = own.groupBy(F.floor((F.col("line_no") - low) / step).cast("bigint").alias("range")).count().orderBy("range").collect()  # RANGES rows at most
        ends = list(accumulate(r["count"] for r in counts))
        first = bisect_right(ends, offset)
        if first == len(counts):
            return df.limit(0)
        before = ends[first] - counts[first]["count"]
        last = min(bisect_left(ends, offset + limit), len(counts) - 1)
        narrower = low + counts[first]["range"] * step, min(high, low + (counts[last]["range"] + 1) * step - 1)
        if narrower == (low, high):
            break
        offset, (low, high) = offset - before, narrower
    if low is not None:
        df = df.where(F.col("line_no").between(low, high))
    return df.orderBy("line_no").offset(offset).limit(limit)


def shown_total(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.count_if(predicate).alias("shown"), F.count("*").alias("total"))
