import hashlib
import re

from logweave.llm.exact import exact_dedup


def brute(rows):
    norm = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for i, t in rows}
    groups = {}
    for i, h in norm.items():
        groups.setdefault(h, []).append(i)
    return {(i, min(groups[h]), len(groups[h]), i == min(groups[h]), h) for i, h in norm.items()}


def test_exact(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i % 40}\n") for i in range(100, 500)]
    rows += [(1, None), (2, ""), (3, " "), (4, "\t\n"), (5, "same text"), (6, "same text "), (7, "same text"), (8, "é " * 50000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS digest", "1 AS h", "2 AS keep_id").repartition(5)
    for support in (1 / 256, 0.3, 0.01):
        assert {tuple(r) for r in exact_dedup(df, support).collect()} == brute(rows)


def test_edges(spark):
    schema = "doc_id bigint, text string"
    assert exact_dedup(spark.createDataFrame([], schema)).collect() == []
    rows = exact_dedup(spark.createDataFrame([(None, "a"), (4, "a"), (4, "a"), (None, "b")], schema)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows), key=str) == [(4, 4, 3, True), (4, 4, 3, True), (None, 4, 3, False), (None, None, 1, True)]
