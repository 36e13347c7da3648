import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from logweave.llm.packing import Mixture, pack, tokenizer_path
from logweave.llm.words import Cache


def check(spark, rows, sequence=4096, windows=16):
    tok = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS queue", "2 AS n").repartition(3)
    pieces = pack(df, sequence=sequence, window_sequences=windows).collect()
    at, fill = defaultdict(list), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length > 0 and len(part) == p.length and p.doc_tokens == len(ids[p.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
        at[p.doc_id].append((p.start, p.length))
        fill[p.sequence_id].append((p.offset, p.length))
    whole = lambda runs: sum(n for _, n in runs) if all(a == sum(n for _, n in sorted(runs)[:k]) for k, (a, _) in enumerate(sorted(runs))) else None
    assert {i: whole(r) for i, r in at.items()} == {i: len(x) for i, x in ids.items()}
    sizes = [whole(fill[k]) for k in range(len(fill))]
    assert all(s == sequence for s in sizes[:-1]) and 0 < sizes[-1] <= sequence
    return pieces


def test_table(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in t]
    odd = "<|endoftext|> it's a b c ÀÉ é ΑΣ ß İ ŉ 12'34 <b>x</b> \x1c \x85 emoji😀 日本 don'T"
    rows += [(10**6, None, None), (10**6 + 1, "", "x"), (10**6 + 2, odd, "x"), (10**6 + 3, "word " * 30000, "long")]
    check(spark, rows)


def test_mixture(spark):
    rows = [(i, "alpha beta gamma " * (i % 7 + 1), f"s{i % 3 if i % 4 else 0}") for i in range(200)]
    pieces = check(spark, rows, sequence=64, windows=1)
    source, share, got = {i: s for i, _, s in rows}, defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        share[source[p.doc_id]] += p.length
        got[p.sequence_id][source[p.doc_id]] += p.length
    total = sum(share.values())
    for k in range(len(got) - 1):
        assert all(abs(got[k][s] - 64 * n / total) <= 2 + len(share) for s, n in share.items())


@pytest.mark.parametrize("targets", [None, [1, 1, 1, 1, 1], [0.5, 0.25, 1, 0, 0.25], [0, 0, 0, 0, 0]])
def test_mixture_places_every_token_once(targets):
    m = Mixture([1000, 3, 0, 77, 1], 50, targets)
    seen = []
    for q, n in enumerate(m.totals):
        at = 0
        while at < n:
            place, most = m.run(q, at)
            seen += range(place, place + most)
            at += most
    assert sorted(seen) == list(range(1081))


def test_targets_hold_while_sources_last(spark):
    rows = [(i, "alpha beta gamma " * 20, "ab"[i % 2]) for i in range(40)] + [(100 + i, "delta " * 30, "c") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    tokens = defaultdict(lambda: defaultdict(int))
    for p in pack(df, sequence=100, window_sequences=1, targets={"a": 3, "b": 1}).collect():
        tokens[p.sequence_id]["c" if p.doc_id >= 100 else "ab"[p.doc_id % 2]] += p.length
    total = {s: sum(t.get(s, 0) for t in tokens.values()) for s in "abc"}
    dry = total["a"] // 75  # a is the first to run dry, in this window
    assert dry > 5 and all(abs(tokens[k]["a"] - 75) <= 1 and tokens[k]["a"] + tokens[k]["b"] == 100 for k in range(dry))
    alone = -(-(total["a"] + total["b"]) // 100)  # c has no target and comes last
    assert all(set(tokens[k]) == {"b"} for k in range(dry + 1, alone - 1)) and all(set(tokens[k]) == {"c"} for k in range(alone, len(tokens)))


def test_cache_is_bounded():
    cache = Cache(100_000)
    for i in range(5000):
        cache.put(str(i).encode(), b"xx", 2)
        assert cache.get(b"0") == b"xx"
    assert len(cache.young) + len(cache.old) < 600 and cache.get(b"1") is None


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string, source string")).collect() == []
