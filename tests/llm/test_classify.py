import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from logweave.llm import classify, nets
from logweave.llm.classify import Changes, accepted, best_limits, labelled, labelled_sample, learned, quality, score, shards, thresholds, toxicity
from logweave.llm.nets import CHUNK, ByteNet, WordNet, byte_chunks, word_features


def tables(spark, n=240):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(rng.randint(5, 60))]
        toxic, good = int(rng.random() < 0.4), int(rng.random() < 0.6)
        if toxic:
            words.insert(rng.randrange(len(words)), "zorg" + rng.choice(["en", "ish", "a"]))
        docs.append((i, " ".join(words if good else [w + "###" for w in words]), "en" if i % 2 else None))
        labels.append((i, good, toxic))
    docs += [(10_000, None, "fr"), (10_001, "", "fr"), (10_002, "x " * 40_000 + "zorgen", "fr"), (None, "text", None), (1, docs[1][1], "en")]
    labels += [(20_000, 1, 1), (3, None, None), (None, 1, 1), (1, *labels[1][1:])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS score", "2 AS y")
    return d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {i: (q, t) for i, q, t in labels if q is not None}


@pytest.mark.parametrize(("run", "k", "folds", "held", "least"), [(toxicity, 1, 5, 0, 0.85), (quality, 0, 3, 1, 0.9)])
def test_held_out_accuracy(spark, run, k, folds, held, least):
    docs, labels, truth = tables(spark)
    rows = run(docs, labels).collect()
    assert len(rows) == 245 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows if r.doc_id is not None)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id][k] for r in out) >= least * len(out) > 20


def test_few_labels(spark):
    docs, labels, _ = tables(spark)
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert toxicity(docs.limit(0), labels).collect() == []
    assert accepted(docs, labels.where("quality = 1")).schema == docs.schema and accepted(docs, labels.where("quality = 1")).count() == 245


def test_whole_texts():
    data = pa.array(["a" * (3 * CHUNK + 5) + "z", "", None, "q"], pa.string())
    chunks, begins = ByteNet.chunks_of(data)
    assert (chunks[begins[1] - 1] == ord("z")).any() and len(ByteNet().score(data)) == 4
    assert len(byte_chunks(chunks[0][:0])) == 1 and len(WordNet().score(data)) == 4
    one = WordNet().score(pa.array(["q"]))
    assert abs(one[0] - WordNet().score(data)[3]) < 1e-6


def test_a_text_above_the_byte_bound_does_not_empty_its_class(spark, monkeypatch):
    monkeypatch.setattr("logweave.llm.classify.CLASS_BYTES", 2000)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    for long in range(20):  # wherever it stands in the order
        docs = spark.createDataFrame([(i, "x" * (2001 if i == long else 100)) for i in range(20)], "doc_id bigint, text string")
        rows = labelled_sample(docs, labels, "quality", 5, 5)
        assert sorted(r["y"] for r in rows) == sorted(i % 2 for i in range(20) if i != long)


TEXTS = ["alpha Beta, gamma", "", None, "one", "a b c d e f g " * 40, "é ü ñ " + "x" * 3000, "end."]


def logistic(x):
    return 1 / (1 + np.exp(-x))


def test_words_forward_pass_by_the_formula():
    net = WordNet(seed=3)
    p, zero = net.p, np.zeros(nets.WORD_DIM)

    def embedded(word):
        w, h = word.strip(b".,;:!?|\"'()[]"), xxhash.xxh32_intdigest
        return sum(p["e"][v * nets.BUCKETS + h(part) % nets.BUCKETS] for v, part in enumerate((w, w[:4], w[:6])))

    for text, got in zip(TEXTS, net.score(pa.array(TEXTS, pa.string())), strict=True):
        x = [zero, zero, *(embedded(w.lower()) for w in (text or "").encode().split()), zero]
        tops = []
        for k in nets.WIDTHS:
            starts = range(len(x))
            for f in range(nets.WORD_FILTERS):
                of = lambda a, f=f, k=k: sum(x[a + j] @ p[f"w{k}"][j * nets.WORD_DIM : (j + 1) * nets.WORD_DIM, f] for j in range(k) if a + j < len(x)) + p[f"b{k}"][f]
                tops.append(max(of(a) for a in starts))
        assert abs(logistic(np.maximum(tops, 0) @ p["o"] + p["c"][0]) - got) < 1e-5


def test_bytes_forward_pass_by_the_formula():
    net = ByteNet(seed=4)
    p, step = net.p, CHUNK - nets.OVERLAP
    for text, got in zip(TEXTS, net.score(pa.array(TEXTS, pa.string())), strict=True):
        data = (text or "").encode()
        n = max(1, -(-max(len(data) - nets.OVERLAP, 1) // step))
        tops = []
        for c in range(n):
            part = data[c * step : c * step + CHUNK].ljust(CHUNK, b"\0")
            x = p["e"][np.frombuffer(part, np.uint8)]
            every = [x[a : a + nets.BYTE_WIDTH].ravel() @ p["w"] + p["b"] for a in range(0, CHUNK - nets.BYTE_WIDTH + 1, nets.STRIDE)]
            tops.append(np.maximum(np.max(every, axis=0), 0))
        z = np.concatenate((np.mean(tops, axis=0), np.max(tops, axis=0)))
        assert abs(logistic(np.maximum(z @ p["h"] + p["g"], 0) @ p["o"] + p["c"][0]) - got) < 1e-5
        assert all(any(c * step <= i < c * step + CHUNK for c in range(n)) for i in range(0, len(data), 100))


def loss(p, labels, weight):
    return float(np.mean(weight * -(labels * np.log(p) + (1 - labels) * np.log(1 - p))))


@pytest.mark.parametrize("kind", [WordNet, ByteNet])
def test_gradients_by_small_steps(kind):
    rng = np.random.default_rng(9)
    net = kind(seed=5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p |= {k: v + 0.05 for k, v in net.p.items() if k in ("b", "b1", "b2", "b3", "g")} | {"o": net.p["o"] + 0.2}  # away from the kinks
    labels, weight, texts = np.array([1, 0, 0, 1.0]), np.array([0.5, 2, 1, 1.5]), pa.array(["alpha beta gamma", "one two", "b", "the end " * 300])
    parts = word_features(texts) if kind is WordNet else net.chunks_of(texts)
    grads = net.gradients(*parts, labels, weight) if kind is WordNet else net.gradients(parts[0], np.diff(parts[1]), labels, weight)
    assert set(grads) == set(net.p)
    for name, g in grads.items():
        used = np.flatnonzero(np.abs(g.ravel()) > np.abs(g).max() * 0.05)
        for i in rng.choice(used, min(6, len(used)), replace=False):
            flat, h = net.p[name].ravel(), 1e-3
            flat[i] += h
            up = loss(net.score(texts), labels, weight)
            flat[i] -= 2 * h
            down = loss(net.score(texts), labels, weight)
            flat[i] += h
            assert abs((up - down) / (2 * h) - g.ravel()[i]) < 0.02 * np.abs(g).max() + 1e-5, name


def test_conflicting_rows_teach_nothing(spark):
    docs = [(1, "a", "x"), (2, "b", "x"), (2, "b", "x"), (3, "c", "x"), (3, "other", "x"), (4, "d", None), (5, None, "x"), (None, "e", "x")]
    labels = [(1, 1), (1, 0), (2, 1), (2, 1), (3, 0), (4, 0), (4, None), (5, 1), (None, 1), (9, 1)]
    for turn in (1, -1):  # in whatever order rows come
        d = spark.createDataFrame(docs[::turn], "doc_id bigint, text string, lang string")
        rows = labelled_sample(d, spark.createDataFrame(labels[::turn], "doc_id bigint, quality int"), "quality", 5, 5)
        assert sorted((r["text"], r["y"]) for r in rows) == [("b", 1), ("d", 0)]


def test_thresholds_by_language(spark):
    class Model:
        def score(self, column):
            return np.array([float(x or 0) for x in column.to_pylist()])

    rows = [{"text": t, "lang": g, "y": y} for t, g, y in (("0.2", "en", 0), ("0.3", "en", 1), ("0.9", "en", 1), ("0.6", "de", 0), ("0.7", "de", 1), ("0.9", "fr", 1))]
    limits = thresholds(rows, Model())
    assert limits == {"en": 0.3, "de": 0.7}
    docs = spark.createDataFrame([(1, "0.35", "en"), (2, "0.35", "de"), (3, "0.65", "fr"), (4, "0.4", None), (1, "0.1", "en"), (1, "0.1", "de")], "doc_id bigint, text string, lang string")
    assert sorted((r.doc_id, r.score, r.flagged) for r in score(docs, Model(), 5, 0, limits).collect()) == [(1, 0.1, False), (1, 0.1, False), (1, 0.35, True), (2, 0.35, False), (3, 0.65, True), (4, 0.4, False)]


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Bounds of a sample do not matter, and neither does how rows lie in files, with one shard or many."""
    monkeypatch.setattr("logweave.llm.classify.CLASS_ROWS", 2)
    monkeypatch.setattr("logweave.llm.classify.CLASS_BYTES", 100)
    docs, labels, truth = tables(spark)
    out = [r for r in toxicity(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id][1] for r in out) >= 0.85 * len(out) > 20
    monkeypatch.setattr("logweave.llm.classify.SHARD_BYTES", 4000)
    results = [sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 4)) for r in toxicity(docs.repartition(n), labels.repartition(n)).collect()) for n in (1, 5)]
    assert all(a == c and abs(b - d) < 2e-4 for (a, b), (c, d) in zip(*results, strict=True))


def test_shards_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr("logweave.llm.classify.SHARD_BYTES", 4000)
    docs, labels, truth = tables(spark)
    more = [(30_000, "one", "b"), (30_000, "one", "a"), (30_001, "one", "a"), (30_001, "two", "a"), (30_002, None, "a")]
    docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id bigint, text string, lang string"))
    labels = labels.union(spark.createDataFrame([(30_000, 1, 1), (30_001, 1, 1), (30_002, 1, 1)], labels.schema))
    table = shards(docs, labelled(labels, "toxic", 5, 5))
    found = table.collect()
    assert len(found) > 3 and all(sum(r.rows) == len(r.lang) == len(r.y) for r in found)
    assert sum(len(r.y) for r in found) == 241 and sum(r.rows[1] + r.rows[3] for r in found) == sum(truth[i][1] for i in range(240)) + 1
    assert [x for r in found for x in r.lang if x == "a" or x == "b"] == ["a"]
    nets = learned(table)
    rows, scores = [], []  # each row scored by the net of the half that it is not in
    for r in found:
        words, at = np.frombuffer(r.words, np.uint16).reshape(-1, 3), 0
        for n, y, half, lang in zip(np.frombuffer(r.counts, np.int64), r.y, r.half, r.lang, strict=True):
            rows.append({"text": str(len(rows)), "lang": lang, "y": y})
            scores.append(nets[2 - half].of_words(words[at : at + n], np.array([0, n]))[0])
            at += n

    class Model:
        def score(self, column):
            return np.array([scores[int(x)] for x in column.to_pylist()])

    limits, brute = best_limits(table, nets), thresholds(rows, Model())
    assert set(limits) == set(brute) == {"", "en"} and all(abs(limits[k] - brute[k]) < 1e-6 for k in brute)


def test_words_in_pieces(monkeypatch):
    """Responses and their places do not depend on how many words are held at a time."""
    rows, begins = word_features(pa.array(TEXTS, pa.string()))
    whole = WordNet(seed=3).pooled(rows, begins, where=True)
    for piece in (1, 2, 7, 50):
        monkeypatch.setattr("logweave.llm.nets.PIECE", piece)
        top, at = WordNet(seed=3).pooled(rows, begins, where=True)
        assert np.abs(top - whole[0]).max() < 1e-6 and (at == whole[1]).mean() > 0.99


def test_word_numbers_are_hashed_all_at_once(monkeypatch):
    """Equal to xxh32 of each trimmed word and its beginnings, and only words of 16 bytes and more take a call of their own."""
    rng = random.Random(7)
    texts = ["", None, "...", "a", "..a..", "\"'(é)ü.", "x" * 15, "x" * 16, "Y" * 17 + ".", "!" * 40 + " ." + "q" * 40 + "[", *("".join(rng.choices("abC.,é ü!xyz\n", k=rng.randrange(60))) for _ in range(300))]
    texts += ["word" * n + "abc"[:k] for n in range(6) for k in range(4)]
    h, calls = xxhash.xxh32_intdigest, []
    want, places = [], []
    for text in texts:
        words = [w.lower().strip(b".,;:!?|\"'()[]") for w in (text or "").encode().split()]
        want += [[nets.PAD] * 3] * 2 + [[v * nets.BUCKETS + h(part) % nets.BUCKETS for v, part in enumerate((w, w[:4], w[:6]))] for w in words] + [[nets.PAD] * 3]
        places.append(len(want))
    monkeypatch.setattr(nets.xxhash, "xxh32_intdigest", lambda w: calls.append(bytes(w)) or h(w))
    rows, begins = word_features(pa.array(texts, pa.string()))
    assert rows.tolist() == want and begins.tolist() == [0, *places]
    assert calls and all(len(w) >= 16 for w in calls)
    some = word_features(pa.array(texts, pa.string()).slice(5, 9))
    assert some[0].tolist() == want[places[4] : places[13]] and word_features(pa.array([], pa.string()))[0].shape == (0, 3)


def test_the_driver_takes_one_sum_of_changes_however_many_tasks_learn(spark, monkeypatch):
    """Tasks' changes are added up by executors; by how many tasks does not matter."""
    monkeypatch.setattr("logweave.llm.classify.SHARD_BYTES", 2000)
    monkeypatch.setattr("logweave.llm.classify.DEAL_ROWS", 10)
    monkeypatch.setattr("logweave.llm.classify.PASSES", 2)
    docs, labels, _ = tables(spark)
    table = shards(docs, labelled(labels, "toxic", 5, 0))
    assert table.rdd.getNumPartitions() > 3 and table.count() > 20
    taken, merge = [], Changes.merge
    monkeypatch.setattr(Changes, "merge", lambda self, packed: taken.append(len(packed)) or merge(self, packed))
    nets = learned(table)
    few = len(taken)
    more = learned(table.repartition(16))  # in other tasks
    assert few == len(taken) - few == 2 * 3 * classify.RANGES
    monkeypatch.setattr("logweave.llm.classify.LEARNERS", 1)
    one = learned(table)
    for a, b, c in zip(nets, more, one, strict=True):
        assert all((a.p[k] == b.p[k]).all() and (a.p[k] == c.p[k]).all() for k in a.p)


def test_learning_by_the_formula_touches_the_embeddings_that_filters_met():
    """Equal to steps over whole gradients; those hold numbers for the words that reached a maximum alone."""
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(rng.choice([f"w{i}" for i in range(3000)], rng.integers(1, 400))) for _ in range(40)], pa.string())
    labels = np.arange(40) % 2
    rows, begins = word_features(texts)
    net, p = WordNet(seed=6), {k: v.astype(np.float64) for k, v in WordNet(seed=6).p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    net.learn(rows, begins, labels, np.ones(40, np.float32), 2, size=8)
    for t, batch in enumerate(nets.epochs(40, 2, 8, 5), 1):
        own = word_features(texts.take(pa.array(batch)))
        now = WordNet({k: x.astype(np.float32) for k, x in p.items()})
        grads, (some, used) = now.gradients(*own, labels[batch], np.ones(8)), now.slopes(*own, labels[batch], np.ones(8))
        assert (np.diff(used) > 0).all() and nets.PAD not in used and len(some["e"]) == len(used) <= 8 * 16 * 6 * 3 < len(p["e"])
        assert (grads["e"][used] == some["e"]).all() and not np.delete(grads["e"], used, axis=0).any()
        for k, g in grads.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g.astype(np.float64) ** 2
            p[k] -= 0.01 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m[k] / (np.sqrt(v[k]) + 1e-7)
    diff = {k: np.abs(net.p[k] - p[k]) for k in p}
    assert all(np.quantile(x, 0.99) < 1e-3 for x in diff.values()), {k: x.max() for k, x in diff.items()}


def test_shards_of_many_labels(spark, monkeypatch):
    """Label rows that are too many to go to the texts give the same shards, and texts without a label mostly stay where they are."""
    docs, labels, _ = tables(spark)
    docs, labels = docs.selectExpr("doc_id - 100 AS doc_id", "text", "lang"), labels.selectExpr("doc_id - 100 AS doc_id", "quality", "toxic").where("doc_id % 3 = 0")
    rows = labelled(labels, "toxic", 5, 0)
    want = shards(docs, rows).collect()
    met = []
    monkeypatch.setattr("logweave.llm.classify.SENT_ROWS", 10)
    join = type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda self, other, on: met.append((self.count(), other.columns)) or join(self, other, on))
    for bits in (64, 1 << 27):
        monkeypatch.setattr("logweave.llm.classify.MARKS", bits)
        met.clear()
        assert len(want) == 1 and shards(docs, rows).collect() == want
        assert met[-1][1] == ["doc_id", "y"] and met[-1][0] < (230 if bits == 64 else 90) < met[0][0]
