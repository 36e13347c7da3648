import gzip
import hashlib
import random

from logweave.llm.archive import read_warc, write_warc


def brute(rows):
    out, first = set(), {}
    data = [(i, (h or "").encode()) for i, _, h in rows]
    for i, b in data:
        first[b] = min(i, first.get(b, i))
    for i, b in data:
        revisit = len(b) >= 100 and first[b] != i
        out.add((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return out


def test_round_trip(spark, tmp_path):
    rng = random.Random(5)
    page = lambda n: "".join(chr(rng.choice([*range(32, 127), 233, 0x4E2D])) for _ in range(n))
    hot = page(300)
    rows = [(i, f"http://h/{i}?q=é\n", page(rng.randint(0, 3000))) for i in range(60)]
    rows += [(100 + i, None, hot) for i in range(30)] + [(200 + i, "", "x" * 99) for i in range(3)] + [(210 + i, "u", "x" * 100) for i in range(3)]
    rows += [(300, "u", None), (301, "u", ""), (302, "u", page(2_000_00)), (303, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (304, "u", "\0" * (17 << 20))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS first").repartition(3)
    folder = f"file:{tmp_path}/a"
    write_warc(df, folder)
    for split in (1 << 25, 1000):
        back = read_warc(spark, folder, split_bytes=split).collect()
        assert len(back) == len(rows) and {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back} == brute(rows)
    assert {r.page_id: r.payload.decode() for r in back if r.payload is not None and r.page_id < 60} == {i: h for i, _, h in rows[:60]}
    for f in (tmp_path / "a").glob("*.warc.gz"):  # a plain gzip stream of records
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_edges(spark, tmp_path):
    write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), f"{tmp_path}/e")
    assert read_warc(spark, f"{tmp_path}/e").collect() == []
    rows = [(None, None, "y" * 200), (4, "u", "y" * 200), (4, "u", "y" * 200), (None, "u", "z" * 200)]
    write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"{tmp_path}/n")
    back = [(r.page_id, r.record_type, r.refers_to) for r in read_warc(spark, f"{tmp_path}/n").collect()]
    assert sorted(back, key=str) == [(4, "response", None), (4, "response", None), (None, "response", None), (None, "revisit", 4)]
