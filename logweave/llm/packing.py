"""Mixture-controlled packing: deficit round-robin over source queues, in closed form, so that no task waits for another."""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logweave.llm.words import ASCII_SPACE, Cache, map_batches, slices, text_bytes
from logweave.plans.materialize import materialize

SEQUENCE, WINDOW_SEQUENCES, END_ID = 4096, 16, 2
#: Beyond this many sources they share queues by hash; a queue is a counter on the driver and in every task.
QUEUES = 4096
#: Rows of the (task, queue) offset table that may be broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Bytes of the cache of a worker's encoder.
CACHE_BYTES = 64 << 20

_state: dict[str, tuple] = {}  # by vocabulary file, of this worker


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


SPACE, LETTER, DIGIT, OTHER, ODD = range(5)


def _kinds() -> np.ndarray:
    """What each byte is. Letters are a-z, A-Z and the two bytes of a Latin-1 letter; odd bytes need the whole tokenizer."""
    kind = np.full(256, ODD, np.uint8)
    kind[33:127] = OTHER
    kind[list(ASCII_SPACE)] = SPACE
    for a, b, k in ((48, 58, DIGIT), (65, 91, LETTER), (97, 123, LETTER), (0x80, 0xC0, LETTER), (0xC3, 0xC4, LETTER)):
        kind[a:b] = k
    kind[list(b"<'")] = ODD  # may open a special token, or be part of a contraction
    return kind


class Encoder:
    """Token ids of texts by parts; a part is encoded once while it stays in the worker's cache.

    The vocabulary splits at white space before anything else, then into runs of letters, single digits and runs of others,
    and never merges across: the ids of a text are those of its parts one after the other. Where a piece between white space
    has Latin-1 letters, digits and ASCII marks alone (already composed, lower-cased one to one) the parts are cut here and
    go to the model directly; any other piece is a part by itself and goes through the whole tokenizer.
    """

    KIND = _kinds()
    LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
    ODD_BYTES = bytes(np.flatnonzero(KIND == ODD).astype(np.uint8))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.dtype = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        text_of = {b: level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(33, 127), *range(0xC0, 0x100)]) for b in [c.encode()]}
        self.byte_text = {b[k]: t[k] for b, t in text_of.items() for k in range(len(b))}
        self.parts = Cache(CACHE_BYTES)

    def _split(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(of each text, its first part; one more at the end; part numbers; distinct parts)."""
        offsets, data = text_bytes(column)
        if not len(data):
            return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.int32), []
        kind, low = self.KIND[data], self.LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        kind[lead[(after == 0x97) | (after == 0xB7)]] = ODD  # the signs among the letters
        upper = lead[(after < 0x9F) & (after != 0x97)] + 1
        low[upper] += 0x20
        first = np.zeros(len(data), bool)  # of a text
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        inside = kind != SPACE
        piece = inside.copy()
        piece[1:] &= ~inside[:-1] | first[1:]
        start = kind == DIGIT
        start[1:] |= kind[1:] != kind[:-1]
        start |= first
        start &= inside
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            begins = np.flatnonzero(piece)
            own = np.unique(np.searchsorted(begins, odd, "right") - 1)
            for a, b in zip(begins[own].tolist(), np.append(begins, len(data))[own + 1].tolist(), strict=True):
                low[a:b] = data[a:b]
                start[a + 1 : b] = False
        starts = np.flatnonzero(start)
        ends = np.zeros(len(starts) + 1, np.int32)
        ends[1:] = np.cumsum(inside)[np.append(starts[1:], len(data)) - 1]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])]).dictionary_encode()
        return np.searchsorted(starts, offsets), words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()

    def _part(self, part: bytes) -> bytes:
        if len(part.translate(None, self.ODD_BYTES)) < len(part):
            ids = self.whole.encode(part.decode(), add_special_tokens=False).ids
        else:
            text = part.decode("latin-1")
            ids = [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.byte_text))]
        return array(self.dtype().dtype.char, ids).tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin; one more at the end)."""
        first, index, distinct = self._split(column)
        own, get, put = [], self.parts.get, self.parts.put
        for w in distinct:
            ids = get(w)
            if ids is None:
                ids = self._part(w)
                put(w, ids, len(ids))
            own.append(ids)
        if not own:
            return np.zeros(0, self.dtype), np.zeros(len(column) + 1, np.int64)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // self.dtype().itemsize
        flat, starts = np.frombuffer(b"".join(own), self.dtype), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        n = sizes[index]
        before = np.concatenate(([0], np.cumsum(n)))
        take = np.repeat(starts[index] - before[:-1], n) + np.arange(before[-1])
        return flat[take], before[first]


def encoder(path: str) -> Encoder:
    if path not in _state:
        _state[path] = (Encoder(path),)
    return _state[path][0]


def _tokenize(docs: DataFrame, path: str, queues: dict[str, int] | None) -> DataFrame:
    """doc_id, queue, part, begin (in its task's share of the queue), n and the ids in the encoder's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, filled = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], enc.dtype).tobytes()
        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                ids, at = enc.encode(rows.column("text"))
                out, begin, queue, n = [], [], [], (np.diff(at) + 1).tolist()
                for i, source in enumerate(rows.column("source").to_pylist()):
                    q = queues[source] if queues is not None else zlib.crc32(source.encode()) % QUEUES
                    out.append(ids[at[i] : at[i + 1]].tobytes() + end)
                    begin.append(filled.get(q, 0))
                    queue.append(q)
                    filled[q] = begin[-1] + n[i]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(queue, pa.int32()), pa.array([part] * len(n), pa.int32()), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())],
                    ["doc_id", "queue", "part", "begin", "n", "ids"],
                )

    return map_batches(docs, run, "doc_id bigint, queue int, part int, begin bigint, n bigint, ids binary")


class Phase:
    """Windows of ``size`` tokens, every queue taking part in each by its share of the phase's tokens.

    Queue s gives amounts[s] tokens in all. After w windows it has given floor(w * size * amounts[s] / all) of them: what a window
    falls short of the share, always under one token, is the deficit carried into the next, across sequences, documents and
    tasks alike. What all queues together have given before a window is kept for the windows in use.
    """

    KEPT = 64

    def __init__(self, amounts: list[int], size: int):
        self.amounts, self.size, self.all = amounts, size, sum(amounts)
        self.known: dict[int, np.ndarray] = {}

    def given(self, q: int, w: int) -> int:
        return min(self.amounts[q], w * self.size * self.amounts[q] // self.all)

    def places(self, w: int) -> np.ndarray:
        """For each queue the place, in the phase, of its first token of window w."""
        if w not in self.known:
            if len(self.known) >= self.KEPT:
                self.known.pop(next(iter(self.known)))
            before = np.array([self.given(q, w) for q in range(len(self.amounts))], np.int64)
            after = np.array([self.given(q, w + 1) for q in range(len(self.amounts))], np.int64)
            self.known[w] = before.sum() + np.concatenate(([0], np.cumsum(after - before)[:-1]))
        return self.known[w]

    def run(self, q: int, at: int) -> tuple[int, int]:
        """(place in the phase, tokens that follow without a break) of the queue's token ``at``."""
        w = max(0, at * self.all // (self.amounts[q] * self.size) - 1)
        while self.given(q, w + 1) <= at:
            w += 1
        return int(self.places(w)[q]) + at - self.given(q, w), self.given(q, w + 1) - at


class Mixture:
    """Where a queue's tokens stand in the packed stream: phases one after the other, each with its queues' target proportions.

    Without ``targets`` a queue's target is its share of all tokens, which empties all queues together: one phase. With them, a
    phase ends when a queue runs dry, and the others share its part in the proportions of their own targets. Queues with target
    0 are packed after all others, by their shares.
    """

    def __init__(self, totals: list[int], size: int, targets: list[float] | None = None):
        self.totals, self.phases = [int(t) for t in totals], []
        weights = [Fraction(x) for x in targets] if targets is not None else [Fraction(t) for t in self.totals]
        left, at = list(self.totals), 0
        self.starts: list[list[tuple[int, int]]] = [[] for _ in left]  # by queue: (its first token of a phase, the phase)
        while any(left):
            live = [q for q, n in enumerate(left) if n and weights[q] > 0]
            if not live:
                weights = [Fraction(n) for n in left]
                continue
            rounds = min(left[q] / weights[q] for q in live)
            amounts = [0] * len(left)
            for q in live:
                amounts[q] = min(left[q], int(rounds * weights[q]))
                if amounts[q]:
                    self.starts[q].append((self.totals[q] - left[q], len(self.phases)))
                left[q] -= amounts[q]
            self.phases.append((at, Phase(amounts, size)))
            at += sum(amounts)

    def run(self, q: int, at: int) -> tuple[int, int]:
        """(place in the stream, tokens that follow without a break) of the queue's token ``at``."""
        first, k = self.starts[q][bisect(self.starts[q], at, key=lambda x: x[0]) - 1]
        begin, phase = self.phases[k]
        place, most = phase.run(q, at - first)
        return begin + place, most


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, window_sequences: int | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece of ``docs (doc_id, text, source)``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and the end id; a null or wordless text is the end id alone. Every id is in one piece, every
    sequence but the last is full. A null source is a queue like any other, the empty one. Repeated rows are packed as
    separate documents. An empty table gives no rows; other columns are ignored. Documents are tokenized once and stored;
    only a count for each task and queue is shuffled.

    ``targets`` gives proportions of tokens by source, 0 for sources it does not name; without it every source's target is its
    share of all tokens. It needs at most ``QUEUES`` sources. A window has ``window_sequences`` sequences, and unless told
    otherwise as many as there are queues (16 at least), so that a queue's part of a window is not a sliver.
    """
    path = path or tokenizer_path()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    names = [r[0] for r in docs.select("source").distinct().limit(QUEUES + 1).collect()]
    queues = {s: i for i, s in enumerate(sorted(names))} if len(names) <= QUEUES else None
    if targets is not None and queues is None:
        raise ValueError(f"targets need at most {QUEUES} sources")
    tokens = materialize(_tokenize(docs, path, queues))
    shares = materialize(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    before = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = shares.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = [0] * max(1, len(queues) if queues is not None else QUEUES)
    for r in shares.groupBy("queue").agg(F.sum("n")).collect():  # a row for each queue
        totals[r[0]] = r[1]
    wanted = None if targets is None else [targets.get(s, 0) for s in sorted(names)] or [0]
    mixture = Mixture(totals, sequence * (window_sequences or max(WINDOW_SEQUENCES, len(totals))), wanted)
    offsets = F.broadcast(offsets) if shares.count() <= BROADCAST_ROWS else offsets
    placed = tokens.join(offsets, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("begin")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, dtype = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], encoder(path).dtype
        for batch in batches:
            rows = []
            own = (batch.column(c).to_pylist() for c in ("doc_id", "queue", "at", "n"))
            for key, q, at, n, data in zip(*own, batch.column("ids"), strict=True):
                ids, start = np.frombuffer(data.as_buffer(), dtype).astype("<u4"), 0
                while start < n:
                    place, most = mixture.run(q, at + start)
                    size = min(most, n - start, sequence - place % sequence)
                    rows.append((key, start, size, zlib.crc32(ids[start : start + size]), n, place // sequence, place % sequence))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names)

    return map_batches(placed, run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
