import random
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest

from logweave.llm import paragraphs
from logweave.llm.paragraphs import chosen, repeated_paragraphs, repeated_passages, without_passages, without_repeats

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return (text or "").translate(LOW).split()


def shingles(words):
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def by_definition(docs):
    """{(doc_id, first word): (number of words, shingles)}: lines of 20 words or more, and whole texts of fewer."""
    found = {}
    for i, text in docs:
        words, at = words_of(text), 0
        if 0 < len(words) < 20:
            found[i, 0] = len(words), shingles(words)
        for line in (text or "").split("\n"):
            n = len(words_of(line))
            if n >= 20:
                found[i, at] = n, shingles(words_of(line))
            at += n
    return found


def brute(docs):
    """The rows by definition, over every pair of paragraphs."""
    found = by_definition(docs)
    root = {x: x for x in found}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, pairs = {}, set()
    for x, (_, s) in sorted(found.items()):
        for g in s:
            holders.setdefault(g, []).append(x)
    for h in holders.values():
        pairs.update(combinations(h, 2))
    for a, b in pairs:
        if 100 * len(found[a][1] & found[b][1]) >= 80 * len(found[a][1] | found[b][1]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    tops = [top(x) for x in found]
    return {(*x, found[x][0], *top(x), x == top(x)) for x in found if tops.count(top(x)) > 1}


def prose(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    shared, other, near = prose(1, 50), prose(2, 90), prose(3, 120)
    changed = [*near[:60], "other", *near[61:]]
    join = " ".join
    return [
        (7, join(prose(4, 33)) + " " + join(shared) + "\n" + join(prose(5, 8))), (2, join(prose(6, 70)) + " " + join(shared[:20]).upper() + "\n\t" + join(shared[20:]) + " " + join(prose(7, 40))),
        (3, join(other)), (8, join(other)), (8, join(other)), (4, None), (5, ""), (None, join(other)), (6, join(near)), (9, join(prose(8, 5) + changed + prose(9, 60))), (10, join(prose(10, 400))),
        (11, join(prose(11, 24))), (12, join(prose(11, 24))), (13, "heat " * 400), (14, join(prose(12, 3) + prose(13, 60) + prose(14, 30) + prose(13, 60))), (15, join(prose(15, 9000) + shared[:10])),
        (16, join(prose(16, 18))), (17, "\n".join(prose(16, 18)).upper()), (18, "one"), (-5, join(prose(17, 21)) + "\n" + join(prose(18, 30))), (2**40, join(prose(18, 31))),
    ]


def test_rows(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS id", "2 AS k", "'x' AS packed")
    rows = [tuple(r) for r in repeated_paragraphs(df).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute({(i, t) for i, t in docs if i is not None})
    assert {r[0] for r in rows} == {3, 8, 11, 12, 16, 17, -5, 2**40}
    assert repeated_paragraphs(df.limit(0)).collect() == [] and repeated_passages(df.limit(0)).collect() == []


def test_table(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = {tuple(r) for r in repeated_paragraphs(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert rows == brute([(r["doc_id"], r["text"]) for r in t]) and len(rows) > 20


@pytest.mark.parametrize("changed", [1, 2])
def test_recall_over_all_pairs_of_paragraphs(spark, changed):
    """Lines of 60 words with one of them changed and of 105 with two, most at 0.81 to 0.85, every one against every other."""
    docs, r = [], random.Random(changed)
    for i in range(200):
        line = prose(5000 + i, 15 + 45 * changed)
        other = list(line)
        for k in r.sample(range(len(line)), changed):
            other[k] = f"x{i}"
        docs += [(2 * i, " ".join(prose(7000 + i, 30)) + "\n" + " ".join(line)), (2 * i + 1, " ".join(other) + "\n" + " ".join(prose(9000 + i, 25)))]
    expected = {x[:2] for x in brute(docs)}
    found = {(r.doc_id, r.first_word) for r in repeated_paragraphs(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found <= expected and len(found) >= 0.99 * len(expected) > 200


def test_every_passage_of_50_words_is_found(spark):
    passage = prose(20, 50)
    docs = [(i, " ".join(prose(100 + i, 7 * i % 90) + passage + prose(300 + i, 11 * i % 70))) for i in range(60)] + [(i, " ".join(prose(500 + i, 150))) for i in range(60, 100)]
    found = repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in found} == set(range(60)) and all(any(r.doc_id == i and r.keep_doc_id == 0 for r in found) for i in range(60))


def test_without_repeats(spark, docs):
    df = spark.createDataFrame(list(dict.fromkeys(docs)), "doc_id bigint, text string")
    text = {r.doc_id: r.text for r in without_repeats(df).collect() if r.doc_id is not None}
    given = dict(docs)
    assert all(text[i] == given[i] for i in given if i not in (8, 12, 17, 2**40, None))
    assert text[8] == text[12] == text[17] == text[2**40] == ""


def test_places_are_chosen_by_content():
    r = np.random.default_rng(4)
    sizes = [0, 5, 19, 20, 21, 31, 700, 0, 12, 60]
    first = np.concatenate(([0], np.cumsum(sizes)))
    hashes = r.integers(1, 40, first[-1]).astype(np.uint64)
    expected = {p for a, b in zip(first[:-1], first[1:], strict=True) for j in range(a, b - 19) for p in range(j, j + 11) if hashes[p] == hashes[j : j + 11].min()}
    assert set(chosen(hashes, first, 10, 11).tolist()) == expected
    assert chosen(hashes[:3], np.array([0, 3]), 10, 11).tolist() == []


def short_docs():
    """Passages of 20 to 49 words in surroundings of their own, a line among others, a long one with two edits, a repetition within a document."""
    out, n = [], 0
    for size in (20, 21, 25, 30, 35, 40, 49):
        passage = prose(2000 + size, size)
        for k in range(4):
            out.append((n, " ".join(prose(2100 + n, 10 + 9 * k) + passage + prose(2200 + n, 37 - 9 * k))))
            n += 1
    line, long = " ".join(prose(2300, 22)), prose(2301, 100)
    out += [(100, "a b\n" + line + "\nc"), (101, line), (102, " ".join(prose(2302, 9)) + "\n" + line.upper() + "\nd e"), (103, " ".join(prose(2303, 19)))]
    out += [(110, " ".join(long)), (111, " ".join([*long[:30], "x", *long[31:65], "y", *long[66:]])), (112, " ".join(prose(2304, 40) + prose(2305, 5) + prose(2304, 40)))]
    out += [(113, "heat " * 70), (114, " ".join(prose(2306, 30)) + " heat" * 45), (115, "a b c " * 30)]
    return out + [(i, " ".join(prose(2400 + i, 90))) for i in range(120, 130)]


def repeated_words(docs):
    """By definition: the words in runs of 20 that stand at an earlier place too."""
    seen, gone = {}, set()
    for i, text in sorted(docs):
        words = words_of(text)
        for p in range(len(words) - 19):
            first = seen.setdefault(tuple(words[p : p + 20]), (i, p))
            if first != (i, p) and (first[0] != i or p - first[1] >= 20):
                gone |= {(i, w) for w in range(p, p + 20)}
    return gone


def test_every_repeated_word_of_passages_of_20_words_is_found(spark):
    docs = short_docs()
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).where("not near").collect()
    words = {i: words_of(t) for i, t in docs}
    assert {(r.doc_id, w) for r in rows if not r.kept for w in range(r.first_word, r.first_word + r.n_words)} == repeated_words(docs)
    for r in rows:
        assert words[r.doc_id][r.first_word : r.first_word + r.n_words] == words[r.keep_doc_id][r.keep_first_word : r.keep_first_word + r.n_words]
    assert {(r.doc_id, r.first_word, r.n_words) for r in rows if r.doc_id == 111} == {(111, 0, 30), (111, 31, 34), (111, 66, 34)}


def test_whole_repetitions_are_removed(spark):
    docs = short_docs()
    text = {r.doc_id: r.text for r in without_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    gone = repeated_words(docs)
    left = {i: [w for k, w in enumerate(words_of(t)) if (i, k) not in gone] for i, t in docs}
    assert left[111] == ["x", "y"] and left[101] == [] and left[102] == prose(2302, 9) + ["d", "e"]
    for i, t in text.items():  # nothing of a repetition stays; beyond it near-equal paragraphs take up to two words at each end
        rest = iter(left[i])
        assert all(w in rest for w in words_of(t)) and len(left[i]) - len(words_of(t)) <= 4


@pytest.mark.parametrize("hot", [0, 1 << 30])
def test_repeated_words_of_the_table_and_of_frequent_passages(spark, monkeypatch, hot):
    """Against every run of 20 words; with every seed frequent, and with none."""
    monkeypatch.setattr(paragraphs, "HOT_PLACES", hot)
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    common = prose(3000, 27)
    docs = [(r["doc_id"], r["text"]) for r in t] + [(10**6 + i, " ".join(prose(3100 + i, 5 + i % 9) + common[i % 3 :] + prose(3300 + i, 6)) + "\n" + " ".join(common)) for i in range(60)]
    docs += [(10**7, "heat " * 300 + " ".join(common)), (10**7 + 1, "a\n" + "heat " * 90 + "\nb c " * 25), (-3, " ".join(common))]
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).where("not near").collect()
    assert {(r.doc_id, w) for r in rows if not r.kept for w in range(r.first_word, r.first_word + r.n_words)} == repeated_words(docs)
    words = {i: words_of(t) for i, t in docs}
    for r in rows:
        assert words[r.doc_id][r.first_word : r.first_word + r.n_words] == words[r.keep_doc_id][r.keep_first_word : r.keep_first_word + r.n_words]


def test_one_id_with_several_texts(spark):
    line = " ".join(prose(4000, 30))
    docs = [(1, line), (5, line), (5, " ".join(prose(4001, 12)) + " " + line), (7, " ".join(prose(4002, 40)))]
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).where("not near").collect()
    assert {(r.doc_id, r.first_word, r.n_words, r.kept) for r in rows} == {(1, 0, 30, True), (5, 0, 30, False), (5, 12, 30, False)}


@pytest.mark.parametrize("size", ["1", "7", "1000"])
def test_streams_over_batches(spark, size):
    r = random.Random(5)
    rows = [(r.randrange(-3, 9), r.randrange(40), r.randrange(60)) for _ in range(700)]
    ties = [(r.randrange(6), r.randrange(2), r.randrange(3), r.random() < 0.5, r.randrange(90), r.randrange(1, 9)) for _ in range(300)]
    by_hash, covered = {}, set()
    for doc, w, h in rows:
        by_hash.setdefault(h, set()).add((doc, w))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = paragraphs._meetings(spark.createDataFrame(rows, "doc_id bigint, w int, h bigint")).collect()
        runs = paragraphs._side_by_side(spark.createDataFrame(ties, "doc_id bigint, keep_doc_id bigint, by int, kept boolean, w int, n_words int")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = [(*p, *min(by_hash[h])) for *p, h in rows if len(by_hash[h]) > 1]
    assert sorted(map(tuple, got)) == sorted(expected)
    for doc, keep, by, kept, w, n in ties:
        covered |= {(doc, keep, by, kept, x) for x in range(w, w + n)}
    found = [(x.doc_id, x.keep_doc_id, x.first_word - x.keep_first_word, x.kept, w) for x in runs for w in range(x.first_word, x.first_word + x.n_words)]
    assert len(found) == len(set(found)) and set(found) == covered
    ends = {(x.doc_id, x.keep_doc_id, x.first_word - x.keep_first_word, x.kept, x.first_word + x.n_words) for x in runs}
    assert not ends & covered
