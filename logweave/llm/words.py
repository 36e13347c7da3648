"""Words of whole texts as integer arrays, without a Python object per word.

An Arrow text column is cut into slices of bounded bytes; each slice becomes an array of word
numbers and the list of its distinct words, so per-word Python work is done once per distinct
word and slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.plans.materialize import store

SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to or from a Python worker, unless the session sets its own; a longer row is a batch by itself.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
ASCII_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Alphabet:
    byte: np.ndarray  # what each byte of a word becomes
    inside: np.ndarray  # whether a byte belongs to words


def alphabet(separators: bytes, lower: bool = False) -> Alphabet:
    """Every byte but the separators makes words; A-Z lower-cased if asked."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return Alphabet(np.array([_LOWER.get(i, i) if lower else i for i in range(256)], np.uint8), inside)


#: Words of [^\x20\x09-\x0D]+ with A-Z lower-cased, and the same without.
SPACE_LOWER, SPACE = alphabet(ASCII_SPACE, True), alphabet(ASCII_SPACE)
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ with A-Z lower-cased first.
ALNUM_LOWER = alphabet(bytes(i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122)), True)


@dataclass
class Words:
    first: np.ndarray  # of each text, its first word; one more at the end
    index: np.ndarray  # word numbers, all texts one after the other
    dictionary: pa.Array  # the distinct words

    @cached_property
    def distinct(self) -> list[bytes]:
        offsets, data = binary_bytes(self.dictionary)
        data, at = data.tobytes(), offsets.tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def of(self, i: int) -> np.ndarray:
        return self.index[self.first[i] : self.first[i + 1]]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    return binary_bytes(column.fill_null("") if column.null_count else column)


def binary_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a column of strings or bytes without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def split_words(column: pa.Array, letters: Alphabet) -> Words:
    offsets, data = text_bytes(column)
    if not len(data):
        return Words(np.zeros(len(column) + 1, np.int64), np.zeros(0, np.int32), pa.array([], pa.binary()))
    inside = letters.inside[data]
    after = np.empty(len(data), bool)  # nothing of the same word stands before
    after[0] = True
    np.logical_not(inside[:-1], out=after[1:])
    after[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & after)
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_or(~inside[1:], after[1:], out=last[:-1])
    lengths = np.flatnonzero(inside & last) + 1 - starts
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    packed = letters.byte[data[inside]]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(packed)]).dictionary_encode()
    return Words(np.searchsorted(starts, offsets), words.indices.to_numpy(zero_copy_only=False), words.dictionary)


class Cache:
    """Values by key in two generations of bounded bytes: when the young one is full it becomes the old one, and what is met again moves up."""

    ENTRY = 200  # of two small objects and their slot, beside their contents

    def __init__(self, most: int):
        self.young, self.old, self.size, self.most = {}, {}, 0, most // 2

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.pop(key, None)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, value, size: int = 0) -> None:
        if self.size >= self.most:
            self.young, self.old, self.size = {}, self.young, 0
        self.young[key] = value
        self.size += self.ENTRY + len(key) + size


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``most`` bytes of text; a longer text is a slice by itself."""
    if not batch.num_rows:
        return
    offsets, _ = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, so that executors hold a few MB of a task's rows outside the heap.

    Workers are reused by later stages; at the end of a task a worker returns the Arrow memory that it no longer uses.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def in_wide_batches(step: Callable[..., DataFrame], *tables: DataFrame) -> DataFrame:
    """``step`` over stored tables of short rows, its result stored.

    It runs in a session of its own, with the settings of the caller's but for the bytes of a batch: there a batch is bounded by
    its rows alone, since asking for its bytes at every row costs several times what a short row does.
    """
    spark = tables[0].sparkSession
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(BATCH_CONF, str(2**31 - 1))
    out = store(step(*(own.read.schema(t.schema).parquet(t._folder) for t in tables)))
    found = spark.read.schema(out.schema).parquet(out._folder)
    found._folder = out._folder
    return found


def pack_texts(docs: DataFrame) -> DataFrame:
    """``docs (id, text)`` with the text compressed (``packed``), for shuffles; null texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((press.compress(x.as_buffer()) for x in batch.column("text")), pa.binary())], ["id", "packed"])

    return map_batches(docs.select("id", "text").where(F.col("text").isNotNull()), run, "id bigint, packed binary")


def unpack_texts(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with ``packed`` as batches of about ``most`` bytes with ``text`` instead; a longer text is a batch by itself."""
    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        others = batch.drop_columns("packed")
        texts, size, at = [], 0, 0
        for i, x in enumerate(batch.column("packed"), 1):
            texts.append(plain.decompress(x.as_buffer()))
            size += len(texts[-1])
            if size >= most or i == batch.num_rows:
                yield others.slice(at, i - at).append_column("text", pa.array(texts, pa.binary()).cast(pa.string()))
                texts, size, at = [], 0, i


def unused(df: DataFrame, name: str) -> str:
    """A column name that starts like this and that ``df`` does not have, nor one that it starts."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name
