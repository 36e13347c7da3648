"""Toxicity and quality scores of every whole text where it lies: toxicity learned from all labelled rows, quality from a bounded sample of them."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logweave.llm.nets import PAD, ByteNet, WordNet, balance, word_features
from logweave.llm.words import map_batches, slices
from logweave.plans.materialize import drop, release, store

#: The labelled sample of ``quality``: so many rows of each class at most, and so many bytes of text, least hashes of the id first. A text
#: that is longer by itself is passed over.
CLASS_ROWS, CLASS_BYTES = 2000, 24 << 20
#: Of toxicity, which learns from every row: bytes of text that make a shard, label rows that are dealt to one task at first, tasks
#: that learn at a time, label rows up to which they go to the texts and not the texts to them (the result is the same), passes over all rows, the unit in which changes are added up, so that no order of adding matters, and ranges of embeddings whose changes are added up apart.
SHARD_BYTES, DEAL_ROWS, LEARNERS, SENT_ROWS, PASSES, UNIT, RANGES = 8 << 20, 8192, 32, 1 << 22, 8, 2.0**-24, 8
#: Bits by hash of the labelled ids, which go to the texts where the label rows are too many to: most texts without a label stay where they are.
MARKS = 1 << 27


def fold(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def labelled(labels: DataFrame, target: str, folds: int, held_out: int) -> DataFrame:
    """doc_id and y of the labels outside the held-out fold; an id that stands with both labels teaches nothing, nor do null ids and labels."""
    y = F.col(target).cast("int")
    rows = labels.where(y.isin(0, 1) & (fold(folds) != held_out)).groupBy("doc_id").agg(F.min(y).alias("y"), F.max(y).alias("other"))
    return rows.where("y = other").select("doc_id", "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int) -> list:
    """Rows (text, lang, y) to learn from, none of them of the held-out fold. Null labels, ids and texts teach nothing, nor does
    an id that stands with both labels, or with several texts; of repeated rows one counts."""
    rows = labelled(labels, target, folds, held_out)
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    pick = rows.where("y = 0").orderBy(order, "doc_id").limit(CLASS_ROWS).unionByName(rows.where("y = 1").orderBy(order, "doc_id").limit(CLASS_ROWS))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    have = docs.where(F.octet_length("text") <= CLASS_BYTES).select("doc_id", "text", lang.alias("lang")).join(F.broadcast(pick), "doc_id")
    have = have.groupBy("doc_id", "y").agg(F.min("text").alias("text"), F.max("text").alias("other"), F.min("lang").alias("lang")).where("text = other")
    so_far = F.sum(F.octet_length("text")).over(W.partitionBy("y").orderBy(order, "doc_id"))
    return have.withColumn("so_far", so_far).where(F.col("so_far") <= CLASS_BYTES).orderBy(order, "doc_id").select("text", "lang", "y").collect()


class Constant:
    """The score where nothing can be learned: the share of label 1, or one half."""

    def __init__(self, y: np.ndarray):
        self.value = float(y.mean()) if len(y) else 0.5

    def score(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), self.value)


def fit(rows: list, net) -> WordNet | ByteNet | Constant:
    y = np.array([r["y"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return Constant(y)
    return net().fit(pa.array([r["text"] for r in rows], pa.string()), y)


def score(docs: DataFrame, model, folds: int, held_out: int, limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs (doc_id, text)``; null texts score as empty ones. Repeated rows get equal rows.

    With ``limits`` by language also flagged: whether the score reaches the limit of the row's own language, one half elsewhere.
    """
    flags = limits is not None
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if flags and "lang" in docs.columns else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                p = np.clip(model.score(part.column("text")), 0, 1)
                out = {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}
                if flags:
                    out["flagged"] = pa.array(p >= [limits.get(x, 0.5) for x in part.column("lang").to_pylist()])
                yield pa.RecordBatch.from_pydict(out)

    held = F.coalesce(fold(folds) == held_out, F.lit(False)).alias("held_out")
    rows = docs.select("doc_id", held, F.coalesce("text", F.lit("")).alias("text"), *[lang.alias("lang")] * flags)
    return map_batches(rows, run, "doc_id bigint, held_out boolean, score double, predicted int" + ", flagged boolean" * flags)


_SHARD = "words binary, counts binary, y binary, half binary, lang array<string>, rows array<bigint>"


def shards(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """All of ``docs`` that has a label in ``rows (doc_id, y)``, as stored shards of about ``SHARD_BYTES`` of text each.

    Null texts teach nothing, nor does an id that stands with several texts; of repeated rows one counts. A shard has the word
    features of its texts, their labels, a half of the ids that each is in, languages, and how many rows there are by half and
    label. Ids are dealt and ordered by hash, so shards do not depend on how the tables lie in files.
    """
    rows = store(rows)
    n = rows.count()
    parts = max(1, math.ceil(n / DEAL_ROWS))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    order, half = F.xxhash64(F.col("doc_id"), F.lit(17)), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(2)).cast("int")
    have = docs.where(F.col("text").isNotNull()).select("doc_id", "text", lang.alias("lang"))
    if n > SENT_ROWS:
        bit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(MARKS))
        word, mask = F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, int(bit % 64))").alias("mask")
        marks = rows.select("doc_id", bit.alias("bit")).select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("marks"))
        have = have.select("*", bit.alias("bit")).select("*", word, mask).join(F.broadcast(marks), "word").where("marks & mask != 0").select("doc_id", "text", "lang")
    have = have.join(F.broadcast(rows) if n <= SENT_ROWS else rows, "doc_id")
    have = have.select("doc_id", "text", "lang", "y", half.alias("half"), order.alias("place")).repartition(parts, "doc_id").sortWithinPartitions("place", "doc_id")

    def shard(found: list) -> pa.RecordBatch:
        _, texts, langs, y, half = zip(*found, strict=True)
        words, begins = word_features(pa.array(texts, pa.string()))
        y, half = np.array(y, np.int8), np.array(half, np.int8)
        out = [words.astype(np.uint16).tobytes(), np.diff(begins).tobytes(), y.tobytes(), half.tobytes(), list(langs), np.bincount(2 * half + y, minlength=4).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, [pa.binary()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int64())], strict=True)], ["words", "counts", "y", "half", "lang", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, last = [], 0, None  # of the last id its row, and whether all its texts are one
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "y", "half")), strict=True):
                if last and last[0][0] == row[0]:
                    langs = [x for x in (last[0][2], row[2]) if x is not None]
                    last = ((*last[0][:2], min(langs, default=None), *last[0][3:]), last[1] and last[0][1] == row[1])
                    continue
                if last and last[1]:
                    found.append(last[0])
                    size += len(last[0][1].encode())
                    if size >= SHARD_BYTES:
                        yield shard(found)
                        found, size = [], 0
                last = (row, True)
        if last and last[1]:
            found.append(last[0])
        if found:
            yield shard(found)

    out = store(map_batches(have, run, _SHARD))
    drop(rows)
    return out


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, where each text begins, labels, halves) of a shard."""
    words = np.frombuffer(row["words"], np.uint16).reshape(-1, 3)
    return words, np.concatenate(([0], np.cumsum(np.frombuffer(row["counts"], np.int64)))), np.frombuffer(row["y"], np.int8), np.frombuffer(row["half"], np.int8)


def _texts(words: np.ndarray, begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([words[begins[i] : begins[i + 1]] for i in which]), np.concatenate(([0], np.cumsum(np.diff(begins)[which])))


class Changes:
    """Changes of a net in several shards, each weighted by its rows; an embedding's mean is over the shards that changed it."""

    def __init__(self):
        self.total = {"e": np.zeros((PAD + 1, WordNet().p["e"].shape[1]), np.int64), "seen": np.zeros(PAD + 1, np.int64), "n": 0}

    def add(self, before: WordNet, after: WordNet, used: np.ndarray, n: int) -> None:
        for k, new in after.p.items():
            old = before.p[k][used] if k == "e" else before.p[k]
            change = np.rint((new.astype(np.float64) - old) * (n / UNIT)).astype(np.int64)
            if k == "e":
                self.total["e"][used] += change
                self.total["seen"][used] += n * change.any(axis=1)
            else:
                self.total[k] = self.total.get(k, 0) + change
        self.total["n"] += n

    def packed(self, part: int) -> bytes:
        """One of ``RANGES`` ranges of the embeddings, the first one with all else."""
        size = -(-len(self.total["seen"]) // RANGES)
        some = np.flatnonzero(self.total["seen"][part * size : (part + 1) * size]) + part * size
        rest = self.total if not part else {}
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((some, rest | {"e": self.total["e"][some], "seen": self.total["seen"][some]})))

    def merge(self, packed: bytes) -> None:
        some, total = pickle.loads(zstandard.ZstdDecompressor().decompress(packed))
        for k, v in total.items():
            if k in ("e", "seen"):
                self.total[k][some] += v
            else:
                self.total[k] = self.total.get(k, 0) + v

    def applied(self, net: WordNet) -> WordNet:
        out = {}
        for k, old in net.p.items():
            n = np.maximum(self.total["seen"], 1)[:, None] if k == "e" else self.total["n"]
            out[k] = (old + self.total[k] * UNIT / n).astype(np.float32)
        return WordNet(out)


_CHANGES = pa.schema([("net", pa.int32()), ("part", pa.int32()), ("changes", pa.binary())])


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    """The changes of all tasks to a range of a net, as one row."""
    total, (net, part) = Changes(), (x.as_py() for x in key)
    for packed in rows.column("changes"):
        total.merge(packed.as_py())
    return pa.table({"net": [net], "part": [part], "changes": [total.packed(part)]}, _CHANGES)


def learned(table: DataFrame) -> list[WordNet | Constant]:
    """The net of all rows of the shards, that of half 0 and that of half 1; a constant for one that lacks a class.

    Every pass takes each shard through one pass of its own from the nets as they stand, and the changes of all shards are averaged.
    Executors add the changes up, so the driver takes one net's worth of each net however many tasks learned. A single shard makes
    its passes in a row.
    """
    rows = table.agg(F.count("*"), *[F.sum(F.col("rows")[k]) for k in range(4)]).first()
    count = np.array([n or 0 for n in rows[1:]]).reshape(2, 2)
    of = [count.sum(axis=0), *count]  # by label, of each net
    nets = [WordNet() if n.all() else Constant(np.flatnonzero(n)) for n in of]
    live = [k for k in range(3) if isinstance(nets[k], WordNet)]
    turns, times = (1, PASSES) if rows[0] == 1 else (PASSES, 1)
    for turn in range(turns if live else 0):

        def run(batches: Iterator[pa.RecordBatch], nets=nets, turn=turn) -> Iterator[pa.RecordBatch]:
            changes = {k: Changes() for k in live}
            for batch in batches:
                for row in batch.to_pylist():
                    words, begins, y, half = _opened(row)
                    for k in live:
                        which = np.flatnonzero(half == k - 1) if k else np.arange(len(y))
                        if len(which):
                            own, at = _texts(words, begins, which) if k else (words, begins)
                            net, used, own = nets[k].narrowed(own)
                            net.learn(own, at, y[which], balance(y[which], of[k][1] / of[k].sum()), times, seed=5 + turn)
                            changes[k].add(nets[k], net, used, len(which))
            for k in live:
                for part in range(RANGES):
                    yield pa.RecordBatch.from_pydict({"net": [k], "part": [part], "changes": [changes[k].packed(part)]}, _CHANGES)

        total = {k: Changes() for k in live}
        found = map_batches(table.select("words", "counts", "y", "half").coalesce(LEARNERS), run, "net int, part int, changes binary")
        for r in found.groupBy("net", "part").applyInArrow(_added, found.schema).collect():
            total[r["net"]].merge(r["changes"])
        nets = [total[k].applied(net) if k in total else net for k, net in enumerate(nets)]
        release(table.sparkSession)
    return nets


def best_limits(table: DataFrame, nets: list) -> dict[str, float]:
    """As ``thresholds``, over every row of the shards, each scored by the net of the half that it is not in; equal scores are taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, begins, y, half = _opened(row)
                for h in (0, 1):
                    which = np.flatnonzero(half == h)
                    if len(which):
                        p = nets[2 - h].of_words(*_texts(words, begins, which))
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([row["lang"][i] or "" for i in which], pa.string()), "p": pa.array(p), "y": pa.array(y[which], pa.int64())})

    if not all(isinstance(net, WordNet) for net in nets):
        return {}
    found = map_batches(table.select("words", "counts", "y", "half", "lang").coalesce(LEARNERS), run, "lang string, p double, y bigint").groupBy("lang", "p").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    inner = F.least(F.greatest(F.col("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    found = store(found.withColumn("bin", F.floor(F.log(inner / (1 - inner)) * 32)))  # rows of a language are spread over tasks, in the order of p
    bins, above = found.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), W.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("lang")
    bins = bins.select("lang", "bin", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "hits")], F.sum("hits").over(every).alias("positives"), F.sum("n").over(every).alias("rows"))
    so_far = W.partitionBy("lang", "bin").orderBy(F.desc("p"))
    each = found.join(bins.where("0 < positives and positives < rows"), ["lang", "bin"])
    f1 = 2 * (F.col("hits_above") + F.sum("hits").over(so_far)) / (F.col("n_above") + F.sum("n").over(so_far) + F.col("positives"))
    best = each.select("lang", F.struct(f1.alias("f1"), "p").alias("best")).groupBy("lang").agg(F.max("best").alias("best"))
    limits = {r["lang"]: r["best"]["p"] for r in best.collect()}
    drop(found)
    return limits


def thresholds(rows: list, model) -> dict[str, float]:
    """For each language the score that parts its labelled rows best (by F1); a language needs rows of both classes."""
    scores = model.score(pa.array([r["text"] for r in rows], pa.string())) if rows else []
    by: dict[str, list[tuple[float, int]]] = {}
    for r, p in zip(rows, scores, strict=True):
        by.setdefault(r["lang"] or "", []).append((float(p), r["y"]))
    out = {}
    for lang, pairs in by.items():
        positives = sum(y for _, y in pairs)
        if 0 < positives < len(pairs):
            best, hits = (0.0, 0.5), 0
            for k, (p, y) in enumerate(sorted(pairs, reverse=True), 1):
                hits += y
                best = max(best, (2 * hits / (k + positives), p))
            out[lang] = best[1]
    return out


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), flagged (score >= the threshold of the row's language).

    Learned from all of ``labels (doc_id, toxic)`` outside the held-out fold of crc32(doc_id as text). The thresholds by language
    come from all of these rows too, scored by nets that learned from the half that a row is not in; language is no input of a
    score. With one class or none the score is constant.
    """
    table = shards(docs, labelled(labels, "toxic", folds, held_out))
    nets = learned(table)
    limits = best_limits(table, nets)
    drop(table)
    return score(docs, nets[0], folds, held_out, limits)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, learned from ``labels (doc_id, quality)`` outside the held-out fold.

    The score is the probability of label 1 from bytes alone. With one class or none it is constant.
    """
    return score(docs, fit(labelled_sample(docs, labels, "quality", folds, held_out), ByteNet), folds, held_out)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose quality score is at least one half, with all their columns.

    The text is scored beside the row, so nothing is joined or shuffled; columns pass through untouched.
    """
    model = fit(labelled_sample(docs, labels, "quality", 3, 1), ByteNet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield part.filter(pa.array(model.score(part.column("text")) >= 0.5))

    return map_batches(docs, run, docs.schema)
