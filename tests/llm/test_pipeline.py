"""The pipeline and its stages against the same steps by brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from logweave.llm.packing import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hit_id int, node string, digest int"
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]


def by_near(rows):
    rows = list({(r[0], r[1]): r for r in rows}.values())
    several = {i for i in {r[0] for r in rows} if sum(r[0] == i for r in rows) > 1}
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None or r[0] in several, r[0] or 0)) for g in groups.values()]


def by_windows(rows, items):
    out = []
    for r in rows:
        spans = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").encode().translate(LOWER))]
        words = [(r[1] or "").encode().translate(LOWER)[a:b] for a, b in spans]
        hit = np.zeros(len(words) + 1, bool)
        for item in items:
            v = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").encode().translate(LOWER))
            size = min(10, len(v))
            for k in range(len(v) - size + 1 if v else 0):
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == v[k : k + size]:
                        hit[i : i + size] = True
        if hit.sum() > 0.5 * len(words):
            continue
        if hit.any():
            data, out_text, at, edges = r[1].encode(), b"", 0, np.flatnonzero(np.diff(hit.astype(int), prepend=0))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                out_text, at = out_text + data[at : spans[a][0]], spans[b - 1][1]
            text = (out_text + data[at:]).decode()
            r = (r[0], text, *r[2:4], len(text), *r[5:])
        out.append(r)
    return out


def words(seed, n):
    return [f"w{random.Random(seed * 1000 + i).randrange(3000)}" for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    join = " ".join
    item = words(1, 14)
    base = [words(10 + i, 60 + i) for i in range(30)]
    texts = [(i, join(t)) for i, t in enumerate(base)]
    texts += [(40 + i, join(t).replace(" ", "\n")) for i, t in enumerate(base[:6])]  # equal after spacing
    texts += [(50 + i, join([*t[:50], "changed", *t[51:]])) for i, t in enumerate(base[:8])]  # near
    texts += [(60, join(base[20][:30] + item + base[20][30:])), (61, join(item)), (62, join(words(90, 12) + item))]  # leaks
    texts += [(5, texts[5][1]), (5, texts[5][1]), (70, join(words(91, 50))), (70, join(words(92, 50))), (71, join([*words(92, 49), "x"]))]  # repeated rows, one id with two texts
    texts += [(None, texts[3][1]), (None, join(words(93, 40))), (None, join([*words(93, 39), "y"])), (None, None), (80, None), (81, ""), (81, ""), (82, " \n"), (83, "one"), (84, "one two")]
    texts += [(90, join(words(94, 30_000))), (91, join([*words(94, 29_999), "z"]))]  # very long
    rows = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t), k, "n", k) for k, (i, t) in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, join(item)), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, [join(item), None, ""]


def keys(rows, spacing=False):
    """Rows as they can be told apart; of rows that repeat each other, and of near copies without an id, any may stay."""
    return sorted((str(r[0]), re.sub(r"\s+", " ", r[1] or "") if spacing else str(r[1])[: 100 if r[0] is None else None]) for r in rows)


def test_stages(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert keys(stages["quality"](spark, docs, folder).collect()) == keys(rows)  # one class of labels: all are accepted
    exact = stages["exact_dedup"](spark, docs, folder)
    assert exact.columns == docs.columns and keys(exact.collect(), True) == keys(by_exact(rows), True)
    near = stages["near_dedup"](spark, docs, folder)
    assert near.columns == docs.columns and keys(near.collect()) == keys(by_near(rows))
    clean = stages["decontamination"](spark, docs, folder)
    assert clean.schema == docs.schema and sorted(map(str, map(tuple, clean.collect()))) == sorted(map(str, by_windows(rows, items)))


def test_run(spark, tables):
    folder, rows, items = tables
    expected = by_windows(by_near(by_exact(rows)), items)
    tok = Tokenizer.from_file(tokenizer_path())
    pieces = corpus_pipeline.run(spark, folder).collect()
    lengths = {}
    for p in pieces:
        lengths[p.doc_id, p.doc_tokens] = lengths.get((p.doc_id, p.doc_tokens), 0) + p.length
    assert all(total == n for (_, n), total in lengths.items())  # no id and number of tokens comes twice here
    sizes = [(r[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in expected]
    assert len(set(sizes)) == len(sizes) == len(lengths)
    assert {x for x in lengths if x[0] is not None} == {x for x in sizes if x[0] is not None}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty(spark, tables, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, tables[0]).collect() == []
