import random

import pyarrow.parquet as pq
from tokenizers import Tokenizer, decoders, models

from logweave.llm.tokens import UnigramCounter, count_tokens, read_vocabulary, vocabulary_path


def exact(vocabulary):
    """The library's own unigram model over the same pieces, with byte fallback."""
    full = [("<unk>", 0.0), *((f"<0x{i:02X}>", min(s for _, s in vocabulary)) for i in range(256)), *vocabulary]
    t = Tokenizer(models.Unigram(full, unk_id=0, byte_fallback=True))
    t.decoder = decoders.ByteFallback()
    return lambda text: len(t.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def test_table(spark):
    vocabulary = read_vocabulary(vocabulary_path())
    whole, rows = exact(vocabulary), pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in rows]
    rows += [(10**6 + i, t) for i, t in enumerate(["", " ", "  a  b ", "日本語 emoji😀 ▁x", "tab\tnew\nline", "a" * 5000, "ñ\x00é", "word  and " * 20_000, "x" + "long text " * 30_000])] + [(10**7, None), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_tokens")
    got = [(str(r.doc_id), r.n_tokens, r.n_bytes) for r in count_tokens(df).collect()]
    assert sorted(got) == sorted((str(i), whole(t or ""), len((t or "").encode())) for i, t in rows)
    assert count_tokens(df.limit(0)).collect() == []


def test_ties():
    rng = random.Random(2)
    for _ in range(30):
        pieces = sorted({"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(6)} | {"▁"})
        vocabulary = [(p, float(-rng.randint(1, 3))) for p in pieces]
        counter, whole = UnigramCounter(vocabulary), exact(vocabulary)
        for _ in range(20):
            text = "".join(rng.choices("abc ", weights=[5, 5, 1, 1], k=rng.randint(1, 12)))
            assert counter.whole(text) == whole(text), (vocabulary, text)
