import hashlib
import random
import re

from logweave.llm import decontaminate
from logweave.llm.decontaminate import contamination

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def brute(text, items, window):
    w, hit, of = words(text), set(), set()
    for k, item in items:
        v = words(item)
        size = min(window, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if v and tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                of.add(str(k))
    return len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)


def check(spark, docs, items, window=10):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS items", "2 AS n_words")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "3 AS doc_id")
    got = {r.doc_id: tuple(r)[1:6] for r in contamination(d, b, window).collect()}
    assert got == {i: brute(t, items, window) for i, t in docs}


def test_random(spark):
    rng = random.Random(3)
    for window in (3, 10):
        vocabulary = [f"W{i}" for i in range(4)] + ["é", "7"]
        items = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=rng.randint(1, 14)))) for i in range(12)] + [(90, ""), (91, None), (92, "..."), (93, "w1 w1")]
        docs = [(i, " ".join(rng.choices([*vocabulary, "other"], k=rng.randint(0, 60))).lower()) for i in range(40)] + [(900, None), (901, ""), (902, items[3][1]), (903, "x\x00w1 W1\tw1")]
        check(spark, docs, items, window)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 5)
    items = [(i, f"a{i} b{i} c{i} d{i}") for i in range(5)] + [(9, "c1 d1")]
    check(spark, [(1, "x a1 b1 c1 d1 y A4-b4 c4, d4!"), (2, "a1 b1"), (3, "c1 d1 c1 d1")], items)


def test_empty_tables_and_text(spark):
    check(spark, [(1, "a b")], [])
    check(spark, [], [(1, "a")])
    d = spark.createDataFrame([(1, "Keep this. One two, THREE four! And é this."), (2, "clean")], "doc_id bigint, text string")
    b = spark.createDataFrame([(5, "one two three four")], "item_id bigint, text string")
    rows = {r.doc_id: r for r in contamination(d, b).collect()}
    assert rows[1].clean_text == "Keep this. ! And é this." and rows[1].longest == 4 and rows[2].clean_text is None
    assert [(s.start, s.end) for s in rows[1].spans] == [(2, 6)]


def test_very_long_texts_and_repeated_rows(spark):
    item = " ".join(f"i{k}" for k in range(12))
    long = "plain words " * 300_000
    docs = [(1, long + item + " " + long), (2, item * 1), (None, item), (None, None)]
    d = spark.createDataFrame([*docs, docs[1]], "doc_id bigint, text string")
    rows = contamination(d, spark.createDataFrame([(1, item), (None, item), (1, item)], "item_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in rows) == sorted([("1", 1_200_012, 12, 2), ("2", 12, 12, 2), ("2", 12, 12, 2), ("None", 12, 12, 2), ("None", 0, 0, 0)])
    assert {r.items_sha256 for r in rows if r.n_hit} == {hashlib.sha256(b"1").hexdigest()}
