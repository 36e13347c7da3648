"""Substring dedup: near-equal paragraphs by min-max hash banding, and every exact repetition of 20 words or more wherever it stands.

Paragraphs are the lines of a text. Their shingle sets are banded for high recall, colliding ones are joined, links are
verified by exact Jaccard similarity on full sets, and of each component the first paragraph stays. Beside that, passages that
repeat inside lines or over line ends are found exactly: a word run of each is chosen by content (a seed), and around seeds
that occur twice every run of 20 words is tied to its first place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.near_dup import link
from logweave.llm.shingles import band_keys, range_sets, runs_of, signatures, word_stream
from logweave.llm.words import SPACE_LOWER, binary_bytes, in_wide_batches, map_batches, pack_texts, slices, split_words, unpack_texts
from logweave.plans.materialize import drop, materialize, release, store

SHINGLE, PERCENT = 5, 80
#: Of pairs at similarity 0.8 the banding finds 0.9997 (1 - (1 - 0.8^2)^8), of more similar ones more, equal ones always.
BANDS, ROWS = 8, 2
#: Words of the shortest passage that counts inside a longer text. Of every 11 seeds of 10 words in a row one is taken: 10 + 11 - 1 = 20.
LEAST, SEED, SEED_STARTS = 20, 10, 11
#: A seed at more places than this has its runs tied in two steps, which split over tasks; of the others a task holds one run's places.
HOT_PLACES = 1 << 16
#: Text that is hashed at a time; the arrays beside it take some sixty times as much.
SLICE_BYTES = 1 << 20


def _rolling(pick: np.ufunc, v: np.ndarray, size: int) -> np.ndarray:
    """The least or greatest of every ``size`` values in a row, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        v = pick(v[: len(v) - step], v[step:])
        have += step
    return v


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places whether it lies in one of the ranges, ends included."""
    some = last >= first
    return np.cumsum(np.bincount(first[some], minlength=n + 1) - np.bincount(last[some] + 1, minlength=n + 1))[:n] > 0


def chosen(shingles: np.ndarray, first: np.ndarray, words: int, starts: int) -> np.ndarray:
    """Of every ``starts`` runs of ``words`` words in a row inside one text those with the least hash of their first shingle.

    ``shingles`` has a hash for every word of all texts, and text i begins with word first[i] (one more at the end). The choice
    within a passage depends on the passage alone.
    """
    if len(shingles) < starts:
        return np.zeros(0, np.int64)
    least = _rolling(np.minimum, shingles, starts)  # of the runs that begin at a word and at the next ones
    least[~_covered(first[:-1], first[1:] - words - starts + 1, len(least))] = 0  # beyond the text
    around = np.concatenate((np.zeros(starts - 1, least.dtype), least, np.zeros(starts - 1, least.dtype)))
    most = _rolling(np.maximum, around, starts)
    return np.flatnonzero((shingles == most) & (most > 0))  # least of some window that holds it


class Lines:
    """The words of some texts and where their paragraphs stand: lines of ``LEAST`` words or more, and whole texts of fewer."""

    def __init__(self, column: pa.Array):
        lists = pc.split_pattern(column.fill_null(""), "\n")
        self.lists, self.words = lists, split_words(lists.values, SPACE_LOWER)
        offsets = lists.offsets.to_numpy()
        self.text_first = self.words.first[offsets]  # of each text, its first word; one more at the end
        counts = np.diff(self.text_first)
        line_row = np.repeat(np.arange(len(counts)), np.diff(offsets))
        long = np.flatnonzero(np.diff(self.words.first) >= LEAST)
        short = np.flatnonzero((counts > 0) & (counts < LEAST))
        start = np.concatenate((self.words.first[long], self.text_first[short]))
        order = np.argsort(start, kind="stable")
        self.start = start[order]
        self.end = np.concatenate((self.words.first[long + 1], self.text_first[short + 1]))[order]
        self.row = np.concatenate((line_row[long], short))[order]
        self.line = np.concatenate((long, offsets[short]))[order], np.concatenate((long + 1, offsets[short + 1]))[order]  # from and to

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        """(first byte in its text, bytes) of each paragraph; line feeds inside a whole text count."""
        at = binary_bytes(self.lists.values)[0] + np.arange(len(self.lists.values) + 1)  # of each line, in the texts with their line feeds
        base = at[self.line[0]] if len(self.line[0]) else at[:0]
        offsets = self.lists.offsets.to_numpy()
        return base - at[offsets[self.row]], at[self.line[1]] - 1 - base


def _set_keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


_BAND = [f"b{i}" for i in range(BANDS)]


def paragraphs(docs: DataFrame) -> DataFrame:
    """One row per paragraph of ``docs (doc_id, text)``: doc_id, first_word (its number from 0), n_words, n (shingles in its set), k
    and t (hashes of the set and of the words in order), at, size and raw (its first byte, its bytes and a hash of them), and its
    band keys b0, b1, ..."""
    names = ["doc_id", "first_word", "n_words", "n", "at", "size", "k", "t", "raw", *_BAND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                lines = Lines(part.column("text"))
                if not len(lines.start):
                    continue
                hashed = word_stream(lines.words)
                sets = range_sets(hashed, lines.start, lines.end, SHINGLE)
                order = [xxhash.xxh3_64_intdigest(hashed[a:b].tobytes()) for a, b in zip(lines.start.tolist(), lines.end.tolist(), strict=True)]
                bands = band_keys(signatures(sets, -(-BANDS * ROWS // 2)), BANDS, ROWS)
                at, size = lines.bytes_of()
                texts = [t.as_buffer() for t in part.column("text")]
                raw = [xxhash.xxh3_64_intdigest(texts[i][a : a + n]) for i, a, n in zip(lines.row.tolist(), at.tolist(), size.tolist(), strict=True)]
                numbers = [lines.start - lines.text_first[lines.row], lines.end - lines.start, [len(s) for s in sets], at, size]
                arrays = [part.column("doc_id").take(pa.array(lines.row)), *(pa.array(x, pa.int32()) for x in numbers), pa.array(_set_keys(sets)), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (order, raw))]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(np.ascontiguousarray(b)) for b in bands.T)], names)

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    return map_batches(rows, run, "doc_id bigint, first_word int, n_words int, n int, at int, size int, k bigint, t bigint, raw bigint, " + ", ".join(f"{b} bigint" for b in _BAND))


def _with_places(docs: DataFrame, places: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, all_docs: bool = False) -> DataFrame:
    """``run`` over batches ``(id, text, ...)``: documents with the lists that ``places (id, ...)`` has for them. Texts are shuffled compressed."""
    packed = pack_texts(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null"))
    rows = packed.join(places, "id", "left" if all_docs else "inner")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpack_texts(batches, SLICE_BYTES):
            yield run(part)

    return map_batches(rows, over, schema)


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, packed)`` of the classes with these ids, from the place that stands for each."""
    places = classes.join(ids, "id").groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("id", "at", "size", "raw")).alias("places")).withColumnRenamed("of", "id")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, packed, press = [], [], zstandard.ZstdCompressor(level=1)
        for text, places in zip(part.column("text"), part.column("places").to_pylist(), strict=True):
            text = text.as_buffer()
            for x in places:
                own = text[x["at"] : x["at"] + x["size"]]
                if xxhash.xxh3_64_intdigest(own) == x["raw"] % 2**64:  # a doc_id may come with several texts
                    ids.append(x["id"])
                    packed.append(press.compress(own))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["id", "packed"])

    return _with_places(docs, places, run, "id bigint, packed binary")


def _near(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """The near-equal paragraphs of ``signed``, as ``repeated_paragraphs`` has them."""
    spark, key = docs.sparkSession, ["k", *_BAND]
    one = [F.first(c).alias(c) for c in ("n", "doc_id", "at", "size", "raw")]
    classes = store(signed.groupBy(*key).agg(*one, (F.count("*") > 1).alias("many")).withColumn("id", F.monotonically_increasing_id()))
    release(spark)
    first = classes.select("id", "n", F.array(*_BAND).alias("bands"))
    _, labels = link(first, lambda ids: _texts(docs, classes, ids), SHINGLE, PERCENT, BANDS, ROWS)
    labels = materialize(labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct()))
    marked = classes.join(labels, classes["id"] == labels["node"], "left").where("many or node is not null")
    marked = store(marked.select(*key[:3], F.coalesce("component", "id").alias("c")))  # 192 bits tell sets apart
    members = store(signed.select("doc_id", "first_word", "n_words", *key[:3]).join(marked, key[:3]).select("c", "doc_id", "first_word", "n_words").distinct())
    place = F.struct("doc_id", "first_word")
    keep = store(members.groupBy("c").agg(F.min(place).alias("keep"), F.max(place).alias("last")).where("keep != last").drop("last"))
    drop(classes, marked)
    release(spark)
    found = members.join(keep, "c").select("doc_id", "first_word", "n_words", "keep", (place == F.col("keep")).alias("kept"))
    return found.select("doc_id", "first_word", "n_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.first_word").alias("keep_first_word"), "kept")


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """One row per paragraph that has a near-equal one: doc_id, first_word (its number from 0), n_words, keep_doc_id, keep_first_word, kept.

    A paragraph is a line of 20 words or more, or a whole text of fewer. Two are linked when their sets of five-word shingles
    (all words, of fewer than five) are at least 0.8 similar; of each connected component the first (by doc_id, then place)
    stays. Paragraphs with equal sets form a class, and one of each class goes into the banding. Rows that repeat a document
    count as one. Null ids and texts and wordless texts have no paragraphs; an empty table gives no rows.
    """
    signed = store(paragraphs(docs))
    near = _near(docs, signed)
    drop(signed)
    return near


def _equal_lines(signed: DataFrame) -> DataFrame:
    """Paragraphs of ``LEAST`` words or more whose words stand as a paragraph elsewhere too: doc_id, w, n_words, t, hub (the first place)."""
    rows = signed.where(F.col("n_words") >= LEAST).select("doc_id", F.col("first_word").alias("w"), "n_words", "t", "k")
    place = F.struct("doc_id", "w")
    hubs = rows.groupBy("t", "k", "n_words").agg(F.min(place).alias("hub"), F.max(place).alias("last")).where("hub != last").drop("last")
    hubs = store(hubs)
    equal = store(rows.join(hubs, ["t", "k", "n_words"]).select("doc_id", "w", "n_words", "t", "hub"))
    drop(hubs)
    return equal


def _copied(lines: pa.Array, first: np.ndarray, hashed: np.ndarray, inner: int) -> np.ndarray:
    """For each word of all texts whether the ``inner`` words from there stand inside one of their copied lines."""
    begin, end = [], []
    for at, stop, own in zip(first[:-1].tolist(), first[1:].tolist(), lines.to_pylist(), strict=True):
        for x in own or ():
            a, b = at + x["w"], at + x["w"] + x["n_words"]
            if b <= stop and xxhash.xxh3_64_intdigest(hashed[a:b].tobytes()) == x["t"] % 2**64:  # an id may come with several texts
                begin.append(a)
                end.append(b - inner)
    return _covered(np.array(begin, np.int64), np.array(end, np.int64), len(hashed))


def _places(part: pa.RecordBatch, at: np.ndarray, first: np.ndarray, others: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows (doc_id, w, ...) for words of all texts by number."""
    rows = np.searchsorted(first, at, "right") - 1
    rows = rows if len(at) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), pa.array(at - first[rows], pa.int32()), *map(pa.array, others.values())], ["doc_id", "w", *others])


def _padded(hashes: np.ndarray, n: int) -> np.ndarray:
    """With a greatest value for the last words, where no run begins."""
    return np.concatenate((hashes, np.full(n - len(hashes), 2**64 - 1, np.uint64)))


def _seeds(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """``(doc_id, w, h)``: of every ``SEED_STARTS`` runs of ``SEED`` words in a row the one with the least hash of its first shingle, h a hash of its words.

    ``copied (id, lines)`` are lines that stand earlier as a whole; a seed of which every surrounding run of ``LEAST`` words
    lies inside such a line is left out.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(part.column("text"), SPACE_LOWER)
        hashed = word_stream(words)
        at = chosen(_padded(runs_of(hashed, SHINGLE), len(hashed)), words.first, SEED, SEED_STARTS)
        around = at - (LEAST - SEED)
        at = at[(around < 0) | ~_copied(part.column("lines"), words.first, hashed, 2 * LEAST - SEED)[around]]
        return _places(part, at, words.first, {"h": runs_of(hashed, SEED)[at].view(np.int64)})

    return _with_places(docs, copied, run, "doc_id bigint, w int, h bigint", all_docs=True)


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, w, h, hot)`` of the runs of ``LEAST`` words that hold one of the seeds of ``wanted (id, at, lines)`` and stand in no copied line."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(part.column("text"), SPACE_LOWER)
        hashed, first = word_stream(words), words.first
        lists = part.column("at")
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        seed, hot = lists.flatten().field("w").to_numpy() + first[rows], lists.flatten().field("hot").to_numpy(zero_copy_only=False)
        known = seed + SEED <= first[rows + 1]  # an id may come with several texts
        low, high = np.maximum(seed - (LEAST - SEED), first[rows]), np.minimum(seed, first[rows + 1] - LEAST)
        seen = [_covered(low[which], high[which], len(hashed)) for which in (known, known & hot)]
        at = np.flatnonzero(seen[0] & ~_copied(part.column("lines"), first, hashed, LEAST))
        return _places(part, at, first, {"h": runs_of(hashed, LEAST)[at].view(np.int64), "hot": seen[1][at]})

    return _with_places(docs, wanted, run, "doc_id bigint, w int, h bigint, hot boolean")


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, cut so that equal values of one column stay together; the last group of a batch waits for the next."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        last = int(np.searchsorted(rows[column], rows[column][-1]))
        if last == 0 and held and held[0][column][0] == rows[column][0]:  # one group still
            held.append(rows)
            continue
        if held and (last or held[0][column][0] != rows[column][0]):
            yield {c: np.concatenate([*(h[c] for h in held), rows[c][:last]]) for c in rows}
        elif last:
            yield {c: x[:last] for c, x in rows.items()}
        held = [{c: x[last:] for c, x in rows.items()}]
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _meetings(windows: DataFrame) -> DataFrame:
    """``(doc_id, w, hub_doc, hub_w)`` of the ``windows (doc_id, w, h)`` that stand at two places or more, hub the first of them; a task holds the places of one hash."""
    names = ["doc_id", "w", "hub_doc", "hub_w"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, "h"):
            h, doc, w = rows["h"], rows["doc_id"], rows["w"]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.append(start, len(h)))
            hub_doc = np.repeat(np.minimum.reduceat(doc, start), sizes)
            hub_w = np.repeat(np.minimum.reduceat(np.where(doc == hub_doc, w, np.iinfo(np.int32).max), start), sizes)
            several = np.repeat(np.logical_or.reduceat((doc != hub_doc) | (w != hub_w), start), sizes)  # rows that repeat a document are one place
            yield pa.RecordBatch.from_arrays([pa.array(x[several], t) for x, t in zip((doc, w, hub_doc, hub_w), types, strict=True)], names)

    dealt = windows.select("h", "doc_id", "w").repartition("h").sortWithinPartitions("h")
    return map_batches(dealt, run, "doc_id bigint, w int, hub_doc bigint, hub_w int")


def _tied(windows: DataFrame) -> DataFrame:
    """``(doc_id, w, hub_doc, hub_w)`` of the ``windows (doc_id, w, h, hot)`` that stand at two places or more, hub the first of them.

    Windows around a frequent seed are grouped with partial sums and joined back, which Spark splits over tasks; of the
    others, in one shuffle, a bounded number meets in a task.
    """
    place, hot = F.struct("doc_id", "w"), windows.where("hot").select("doc_id", "w", "h")
    hubs = store(hot.groupBy("h").agg(F.min(place).alias("hub"), F.max(place).alias("last")).where("hub != last").drop("last"))
    hot = hot.join(hubs, "h").select("doc_id", "w", F.col("hub.doc_id").alias("hub_doc"), F.col("hub.w").alias("hub_w"))
    return hot.unionByName(_meetings(windows.where("not hot")))


def _side_by_side(ties: DataFrame) -> DataFrame:
    """``ties (doc_id, keep_doc_id, by, kept, w, n_words)`` of one stretch to another that touch or overlap, as one row; a task holds the ties of one document."""
    key = ["doc_id", "keep_doc_id", "by", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, "doc_id"):
            order = np.lexsort([rows[c] for c in ("w", *reversed(key))])
            own, first = [rows[c][order] for c in key], rows["w"][order].astype(np.int64)
            end = first + rows["n_words"][order]
            other = np.zeros(len(first), bool)
            for x in own:
                other[1:] |= x[1:] != x[:-1]
            group = np.cumsum(other) << 33
            reach = np.maximum.accumulate(group + end)
            start = np.ones(len(first), bool)
            start[1:] = group[1:] + first[1:] > reach[:-1]
            at = np.flatnonzero(start)
            doc, keep, by, kept = (x[at] for x in own)
            first, end = first[at], (reach - group)[np.append(at[1:], len(first)) - 1]
            arrays = [pa.array(doc), pa.array(first, pa.int32()), pa.array(end - first, pa.int32()), pa.array(keep), pa.array(first - by, pa.int32()), pa.array(kept.astype(bool))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "first_word", "n_words", "keep_doc_id", "keep_first_word", "kept"])

    dealt = ties.repartition("doc_id").sortWithinPartitions("doc_id")
    return map_batches(dealt, run, "doc_id bigint, first_word int, n_words int, keep_doc_id bigint, keep_first_word int, kept boolean")


def _runs(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """The exact repetitions, as ``repeated_runs`` has them; ``signed`` is dropped."""
    spark, place = docs.sparkSession, F.struct("doc_id", "w")
    equal = _equal_lines(signed)
    drop(signed)
    release(spark)
    copied = store(equal.where(F.col("hub") != place).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("w", "n_words", "t")).alias("lines")))
    seeds = store(_seeds(docs, copied))
    release(spark)
    twice = seeds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")  # repeated rows count too; their runs meet only themselves below
    twice = store(twice.select("h", (F.col("n") > HOT_PLACES).alias("hot")))
    release(spark)
    wanted = seeds.join(twice, "h").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("w", "hot")).alias("at"))
    wanted = store(wanted.join(copied, "id", "left"))
    drop(seeds, twice, copied)
    release(spark)
    windows = store(_windows(docs, wanted))
    drop(wanted)
    release(spark)

    def step(windows: DataFrame, equal: DataFrame) -> DataFrame:
        lines = equal.select("doc_id", "w", F.col("hub.doc_id").alias("hub_doc"), F.col("hub.w").alias("hub_w"), "n_words")
        ties = _tied(windows).withColumn("n_words", F.lit(LEAST)).unionByName(lines).withColumn("by", F.col("w") - F.col("hub_w"))
        kept = (F.col("doc_id") == F.col("hub_doc")) & (F.col("by") < LEAST)
        return _side_by_side(ties.select("doc_id", F.col("hub_doc").alias("keep_doc_id"), "by", kept.alias("kept"), "w", "n_words"))

    runs = in_wide_batches(step, windows, equal)
    drop(windows, equal)
    release(spark)
    return runs


def repeated_runs(docs: DataFrame) -> DataFrame:
    """The columns of ``repeated_paragraphs``, for exactly repeated passages of 20 words or more, each as long as it goes.

    Every run of 20 words, and every line as a whole, is tied to its first place in ``docs`` (by doc_id, then place); ties side
    by side make one row. So each word of a repetition is in a row whose kept is false, wherever the passages begin and end
    and whatever stands about them. Rows with kept are the first places, and repetitions that overlap them.
    """
    return _runs(docs, store(paragraphs(docs)))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """All that is repeated: ``repeated_runs`` in full length, and the near-equal ``repeated_paragraphs``, told apart by near."""
    signed = store(paragraphs(docs))
    near = _near(docs, signed).withColumn("near", F.lit(True))
    return near.unionByName(_runs(docs, signed).withColumn("near", F.lit(False)))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs`` less the near-equal paragraphs that do not stay; null texts stay null."""
    return _without(docs, repeated_paragraphs(docs).withColumn("near", F.lit(True)))


def without_passages(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs`` less every word of an exact repetition of 20 words or more, and less the near-equal
    paragraphs that do not stay; null texts stay null."""
    return _without(docs, repeated_passages(docs))


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    gone = found.where("not kept").groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("gone"))
    rows = docs.select("doc_id", "text").join(materialize(gone), docs["doc_id"].cast("bigint") == F.col("key"), "left").drop("key")

    def cut(text: str, places: list[dict]) -> str:
        data = text.encode()
        spans = [m.span() for m in _WORD.finditer(data)]
        gone = np.zeros(len(spans) + 1, bool)
        for x in places:
            gone[x["first_word"] : x["first_word"] + x["n_words"]] = True
        gone[-1] = False
        out, at = [], 0
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            out.append(data[at : spans[a][0]])
            at = spans[b - 1][1]
        return b"".join([*out, data[at:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(text, places) if text is not None and places else text for text, places in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(rows, run, rows.select("doc_id", "text").schema)
