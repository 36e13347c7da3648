"""Benchmark decontamination by a generalised suffix automaton over item words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.words import ALNUM_LOWER, map_batches, slices, split_words, text_bytes

WINDOW = 10
#: Words of items in one automaton; a larger benchmark becomes several, of which a task holds one at a time.
AUTOMATON_WORDS = 200_000
#: Slices of text that meet one automaton after the other.
CHUNK_SLICES = 16


class SuffixAutomaton:
    """All substrings of several word sequences; says which windows end at the longest match of a streamed text.

    ``windows[s]`` are the items that have the window-long suffix of state s; ``ends[s]`` the (length, item) of items shorter
    than a window that end in s itself, and ``up[s]`` the nearest state along suffix links that has any.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.words = window, {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(k, [self.words.setdefault(w, len(self.words)) for w in words]) for k, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        n = len(self.step)
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        self.base = list(range(n))  # the suffix state that holds the window-long suffix
        for s in by_length:
            if self.length[self.link[s]] >= window:
                self.base[s] = self.base[self.link[s]]
        self.windows: dict[int, set] = {}
        self.ends: dict[int, list] = {}
        for k, codes in coded:
            s, matched = 0, 0
            for c in codes:
                s, matched = self.step[s][c], matched + 1
                while self.length[self.link[s]] >= matched:
                    s = self.link[s]
                if matched >= window:
                    self.windows.setdefault(self.base[s], set()).add(k)
            if len(codes) < window:
                while self.length[self.link[s]] >= len(codes):
                    s = self.link[s]
                self.ends.setdefault(s, []).append((len(codes), k))
        self.up = [-1] * n
        for s in by_length:
            above = self.link[s]
            self.up[s] = above if above in self.ends else self.up[above]
        self.shortest = min((min(len(c), window) for _, c in coded), default=window)

    def _extend(self, last: int, c: int) -> int:
        if (q := self.step[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, step: dict, length: int, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(dict(self.step[q]), self.length[p] + 1, self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        return twin

    def scan(self, codes: list[int]) -> tuple[list[tuple[int, int]], set, int]:
        """(spans of words covered by windows, items with a window here, longest match) of one run of known words."""
        spans, items, s, matched, longest = [], set(), 0, 0, 0
        step, link, length = self.step, self.link, self.length
        for at, c in enumerate(codes):
            while s and c not in step[s]:
                s = link[s]
                matched = length[s]
            s = step[s].get(c, 0)
            matched = matched + 1 if s else 0
            longest = max(longest, matched)
            if matched >= self.window:
                spans.append((at + 1 - matched, at + 1))
                items |= self.windows[self.base[s]]
            short = s if s in self.ends else self.up[s]
            while short > 0:
                for size, item in self.ends[short]:
                    if size <= matched:
                        spans.append((at + 1 - size, at + 1))
                        items.add(item)
                short = self.up[short]
        return spans, items, longest


def _automata(benchmark: DataFrame, window: int) -> Iterator[SuffixAutomaton]:
    """Reads the items one partition at a time and packs them into automata of bounded size."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        words = split_words(pa.array([row[1]], pa.string()), ALNUM_LOWER)
        block.append((row[0], [words.distinct[i] for i in words.index]))
        size += len(words.index)
        if size >= AUTOMATON_WORDS:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
    if block:
        yield SuffixAutomaton(block, window)


def _broadcast(benchmark: DataFrame, window: int) -> list[Broadcast]:
    """The automata, one after the other built here, written out and given to Spark; a session holds one in Python at a time."""
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(a) for a in _automata(benchmark, window)]


class Found:
    """What a part's rows have met so far."""

    def __init__(self, part: pa.RecordBatch):
        self.part, self.words = part, split_words(part.column("text"), ALNUM_LOWER)
        self.spans: list[list[tuple[int, int]]] = [[] for _ in range(part.num_rows)]
        self.items: list[set] = [set() for _ in range(part.num_rows)]
        self.longest = [0] * part.num_rows

    def meet(self, automaton: SuffixAutomaton) -> None:
        words, known = self.words, automaton.words
        code = np.fromiter((known.get(w, -1) for w in words.distinct), np.int64, len(words.distinct))
        codes = code[words.index] if len(code) else np.zeros(0, np.int64)
        for i in range(self.part.num_rows):
            own = codes[words.first[i] : words.first[i + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], own >= 0, [False])).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= automaton.shortest:
                    found, of, most = automaton.scan(own[a:b].tolist())
                    self.longest[i] = max(self.longest[i], most)
                    self.spans[i] += [(a + x, a + y) for x, y in found]
                    self.items[i] |= of

    def hits(self) -> list[list[tuple[int, int]]]:
        return [_hits(s) for s in self.spans]


def _meet(batches: Iterator[pa.RecordBatch], automata: list[Broadcast]) -> Iterator[Found]:
    """Every slice of text past every automaton. With several automata some slices go together, and one automaton is in memory at a time."""
    chunk: list[Found] = []

    def past() -> Iterator[Found]:
        for a in automata:
            for found in chunk:
                found.meet(a.value)
            if len(automata) > 1:
                vars(a).pop("_value", None)  # read again from the worker's disk for the next chunk
        yield from chunk
        chunk.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            chunk.append(Found(part))
            if len(automata) < 2 or len(chunk) == CHUNK_SLICES:
                yield from past()
    yield from past()


def _hits(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(text: str, hits: list[tuple[int, int]]) -> str:
    """The text less the words of the spans and what stands between them."""
    data = text.encode()
    _, raw = text_bytes(pa.array([text]))
    inside = np.concatenate(([False], ALNUM_LOWER.inside[raw], [False])).astype(np.int8)
    edge = np.flatnonzero(np.diff(inside))
    starts, ends = edge[::2], edge[1::2]
    kept, at = [], 0
    for a, b in hits:
        kept.append(data[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*kept, data[at:]]).decode()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, spans, clean_text.

    A window is ``window`` consecutive words of an item, or all of a shorter one; every document word inside an occurrence of a
    window is hit. items_sha256 is of the ids of the items with occurring windows, sorted as strings and comma-joined; longest
    is the longest run of words, known in that order from an item, that was met; spans are the disjoint hit spans in words;
    clean_text is the text without them (null if nothing was hit). Null or wordless texts and items have no words. Items
    that share an id are one, those without an id too, which has no part in items_sha256. Repeated rows give repeated rows,
    texts of any length are taken whole, other columns are ignored. Documents stream past the automaton within their partition: nothing is shuffled.
    """
    automata = _broadcast(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _meet(batches, automata):
            hits, items, part = found.hits(), found.items, found.part
            n_hit = [sum(b - a for a, b in h) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(np.diff(found.words.first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(i for i in x if i is not None)).encode()).hexdigest() for x in items]), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(found.longest, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([_without(t.as_py(), h) if h else None for t, h in zip(part.column("text"), hits, strict=True)], pa.string()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "spans", "clean_text"],
            )

    return map_batches(
        docs.select("doc_id", "text"), run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint, spans array<struct<start:bigint,end:bigint>>, clean_text string"
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, most_covered: float, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs (text, ...)`` less those of whose words over ``most_covered`` (a share) are hit; of the others only the hit spans go.

    All columns pass through untouched but for text, and for n_chars where there is such a column: both change in rows with a
    hit. Rows are looked at one by one, so null or repeated ids and repeated rows do not matter; a null text has no words and
    stays. An empty table stays empty, and an empty benchmark takes nothing.
    """
    automata = _broadcast(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _meet(batches, automata):
            part, hits = found.part, found.hits()
            at = [i for i, h in enumerate(hits) if h]
            if at:
                texts = {i: _without(part.column("text")[i].as_py(), hits[i]) for i in at}
                new = {"text": texts, "n_chars": {i: len(t) for i, t in texts.items()}}
                columns = [pa.array([n.get(i, v) for i, v in enumerate(c.to_pylist())], c.type) if (n := new.get(name)) else c for name, c in zip(part.schema.names, part.columns, strict=True)]
                covered = np.array([sum(b - a for a, b in h) for h in hits]) > most_covered * np.diff(found.words.first)
                part = pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(~covered))
            yield part

    return map_batches(docs, run, docs.schema)
