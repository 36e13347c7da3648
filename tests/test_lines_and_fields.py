import io
import json
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.jsontext import compact, float_text, parse_object, pretty, value_text
from logweave.operators import fields as fl
from logweave.sources import lines as ln
from logweave.sources.lines import classify, lines_in, read_log, split_text


@pytest.mark.parametrize(
    ("data", "lines"),
    [(b"a\nbb\nccc\n", ["a", "bb", "ccc"]), (b"a\nbb\nccc", ["a", "bb", "ccc"]), (b"", []), (b"\r\nline2\r\n", ["", "line2"]), (b"a\rb\n\n", ["a\rb", ""]), (b"a\r\nb\r", ["a", "b\r"]), (b"\r", ["\r"]), (b"x\n\r\n", ["x", ""])],
)
@pytest.mark.parametrize("name", ["x.log", "odd[1] name.txt", "_hidden.log", ".dot", "z.gz"])
def test_line_index(spark, tmp_path, data, lines, name):
    (tmp_path / name).write_bytes(data)
    rows = read_log(spark, str(tmp_path / name)).orderBy("line_no").collect()
    assert [r.value for r in rows] == lines and [r.line_no for r in rows] == list(range(1, len(lines) + 1))


def test_numbering_over_many_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = read_log(spark, str(tmp_path / "big.log"), str(tmp_path / "big.log"))
        assert df.where(F.col("value") != F.concat(F.lit("line "), F.col("line_no") - 1)).count() == 0
        assert df.count() == 40000 and df.select("input_index", "line_no").distinct().count() == 40000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


CLASSES = {
    '  {"a":1} ': True, "123": False, "[1,2]": False, '"s"': False, "": False, "at x.y(z)": False, '{"a":1} x': False, "{'a':1}": False, '{"a":NaN}': False, "{}": True,
    '{"a":1}{"b":2}': False, '{"a":1},{"b":2}': False, '{"a":1': False, "null": False, '{"a":{"b":[{}]}}': True,
}


def test_classification(spark):
    df = spark.createDataFrame([(k,) for k in CLASSES], "value string")
    assert {r.value: r.ok for r in classify(df).select("value", F.col("entry").isNotNull().alias("ok")).collect()} == CLASSES
    assert {k: parse_object(k) is not None for k in CLASSES} == CLASSES


@pytest.mark.parametrize(
    ("x", "text"),
    [(1.0, "1.0"), (100.0, "100.0"), (1e15, "1000000000000000.0"), (1e16, "1e16"), (1.5e17, "1.5e17"), (1e-5, "0.00001"), (1e-6, "1e-6"), (-2.5e-7, "-2.5e-7"), (123.456, "123.456"), (-0.0, "-0.0")],
)
def test_float_text(x, text):
    assert float_text(x) == text and float(text) == x


def test_json_text():
    entry = parse_object('{"b":1e2,"a":{"z":null,"y":[true,"é"]},"b":-0,"c":99999999999999999999}')
    assert compact(entry) == '{"a":{"y":[true,"é"],"z":null},"b":-0.0,"c":1e20}'
    assert value_text("x") == "x" and value_text(None) == "null" and json.loads(pretty(entry)) == json.loads(compact(entry))
    assert parse_object('{"a":1e999}') is None and parse_object('{"a":"\\ud800"}') is None and parse_object("{" * 3) is None
    assert parse_object('{"a":' * 200 + "1" + "}" * 200) is None


def test_discovery_and_projection(spark):
    lines = ['{"@timestamp":"t","level":"Warning","x":null}', "raw", '{"X":1}', "[1]"]
    df = classify(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))
    names = [r.field for r in fl.discover_fields(df).collect()]
    assert names == ["@timestamp", "X", "level", "x"] and fl.default_columns(names) == ["@timestamp", "level"]
    assert fl.default_columns(["d", "b", "a", "c"]) == ["a", "b", "c"] and fl.choose_columns(names, []) == []
    rows = fl.project(df, ["level", "x", "X"]).orderBy("line_no").collect()
    assert [tuple(r)[1:] for r in rows] == [("Warning", "null", ""), ("raw", "", ""), ("", "", "1"), ("[1]", "", "")]
    assert [r.raw for r in fl.project(df, []).orderBy("line_no").collect()] == lines
    assert [r.s for r in df.select("line_no", fl.severity(df).alias("s")).orderBy("line_no").collect()] == ["warn", None, None, None]
    assert df.select(fl.truncate(F.lit("abcé"), 3).alias("t")).first().t == "abc..."
    assert [r.row for r in fl.row_mapping(df.where("line_no != 1")).orderBy("line_no").collect()] == [0, 1, 2]


def test_lines_by_byte_ranges():
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\n\r") for _ in range(rng.randrange(40)))
        whole = data.split(b"\n")
        if not whole[-1]:
            whole.pop()
        for step in (1, 2, 3, 7, 100):
            assert [x for a in range(0, len(data), step) for x in lines_in(io.BytesIO(data), a, a + step)] == whole


def test_a_special_name_over_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ln, "RANGE_BYTES", 1000)
    monkeypatch.setattr(ln, "_READ", 64)
    (tmp_path / ".odd.gz").write_text("".join(f"line {i} {'x' * (i % 300)}\r\n" for i in range(900)))
    rows = read_log(spark, str(tmp_path / ".odd.gz")).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in rows] == [(i + 1, f"line {i} {'x' * (i % 300)}") for i in range(900)]


def test_lines_of_a_column(spark):
    rows = split_text(spark.createDataFrame([(1, "a\r\nb\r"), (2, None), (3, "\r\n")], "i int, text string"), keep=("i",)).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, "a"), (1, 1, "b\r"), (3, 0, ""), (3, 1, "")]


@pytest.mark.parametrize("near", [1, 50, 1 << 16])
def test_pages(spark, monkeypatch, near):
    monkeypatch.setattr(fl, "NEAR_ROWS", near)
    monkeypatch.setattr(fl, "RANGES", 8)
    rng = random.Random(near)
    numbers = sorted(rng.sample(range(1, 10**6), 500)) + [10**9]
    df = spark.createDataFrame([(n,) for n in numbers], "line_no bigint").repartition(5)
    for offset, limit in ((0, 10), (3, 7), (100, 50), (490, 30), (500, 1), (501, 5), (9999, 1), (60, 441)):
        assert [r.line_no for r in fl.page(df, offset, limit).collect()] == numbers[offset : offset + limit]
    assert fl.page(df.limit(0), 100, 5).collect() == []


def test_many_files_in_one_scan(spark, tmp_path):
    names = ["a b.log", "ü%20.txt", "c.log", ".hidden", "x.gz", "empty.log"]
    for k, name in enumerate(names):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(0 if name == "empty.log" else 3 + k)))
    paths = [str(tmp_path / n) for n in [*names, "c.log", ".hidden"]]
    rows = read_log(spark, *paths).orderBy("input_index", "line_no").collect()
    assert [(r.input_index, r.file, r.line_no, r.value) for r in rows] == [
        (i, p, k + 1, line) for i, p in enumerate(paths) for k, line in enumerate(open(p).read().splitlines())
    ]
    assert read_log(spark).collect() == []
