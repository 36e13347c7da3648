import random

import pytest

from logweave import cli
from logweave.operators import ordering as od
from logweave.operators.ordering import LogOrderError, merge_files, sort_files


def entry(ts, message, **more):
    pairs = ",".join(f'"{k}":"{v}"' for k, v in sorted({"@timestamp": ts, "message": message, **more}.items()))
    return "{" + pairs + "}"


def write(path, *lines):
    path.write_text("".join(x + "\n" for x in lines))
    return str(path)


def read(path):
    return path.read_text().splitlines()


def test_merge(spark, tmp_path):
    web = write(tmp_path / "web.log", entry("10:00", "w0"), "# comment", entry("10:03", "w3"), "tail")
    auth = write(tmp_path / "auth.log", entry("10:01", "a1"), entry("10:02", "a2"), entry("10:03", "a3", system="old"))
    out = tmp_path / "out.log"
    assert merge_files(spark, [web, auth], str(out)) == 7
    assert read(out) == [
        entry("10:00", "w0", system="web.log"), entry("10:01", "a1", system="auth.log"), entry("10:02", "a2", system="auth.log"), "# comment",
        entry("10:03", "w3", system="web.log"), "tail", entry("10:03", "a3", system="auth.log"),
    ]


def test_sort(spark, tmp_path):
    a = write(tmp_path / "a.log", entry("10:03", "a3"), entry("10:00", "a0"), "raw", entry("10:01", "a1", system="kept"), entry("10:01", "tie"))
    b = write(tmp_path / "b.log", entry("10:01", "b1"), "tail")
    out = tmp_path / "out.log"
    assert sort_files(spark, [a, b], str(out)) == 7
    assert read(out) == [entry("10:00", "a0"), "raw", entry("10:01", "a1", system="kept"), entry("10:01", "tie"), entry("10:01", "b1"), entry("10:03", "a3"), "tail"]


@pytest.mark.parametrize(
    ("lines", "line"),
    [(['{"@timestamp":"1"}', '{"x":1}'], 2), (['{"@timestamp":"1"}', '{"@timestamp":2}'], 2), (['{"@timestamp":"2"}', "raw", '{"@timestamp":"1"}'], 3)],
)
def test_merge_contract(spark, tmp_path, lines, line):
    bad, out = write(tmp_path / "bad.log", *lines), tmp_path / "out.log"
    out.write_text("before")
    with pytest.raises(LogOrderError) as e:
        merge_files(spark, [bad], str(out))
    assert (e.value.file, e.value.line) == (bad, line) and str(e.value).startswith(f"{bad}:{line}: ")
    assert out.read_text() == "before" and sorted(p.name for p in tmp_path.iterdir()) == ["bad.log", "out.log"]


def test_invalid_utf8_and_missing_file(spark, tmp_path):
    (tmp_path / "u.log").write_bytes(b"ok\n\xff\xfe\n")
    with pytest.raises(LogOrderError, match="u.log:2: "):
        sort_files(spark, [str(tmp_path / "u.log")], str(tmp_path / "o"))
    with pytest.raises(LogOrderError) as e:
        sort_files(spark, [str(tmp_path / "none.log")], str(tmp_path / "o"))
    assert e.value.line == 0


def test_empty_and_raw_only(spark, tmp_path):
    e, r = write(tmp_path / "e.log"), write(tmp_path / "r.log", "b", "a")
    t = write(tmp_path / "t.log", "pre", entry("1", "x"))
    out = tmp_path / "out"
    assert merge_files(spark, [e], str(out)) == 0 and out.read_text() == ""
    assert merge_files(spark, [r, e, t, r], str(out)) == 6
    assert read(out) == ["pre", entry("1", "x", system="t.log"), "b", "a", "b", "a"]


def reference_order(files, merge):
    """Plain model: raws wait for the next entry of their file."""
    keyed = []
    for i, lines in enumerate(files):
        last = max((k for k, (ts, _) in enumerate(lines) if ts), default=None)
        for n, (_, text) in enumerate(lines):
            after = next((t for t, _ in lines[n:] if t), None)
            key = after if after else lines[last][0] if merge and last is not None else None
            keyed.append(((key is None, key or "", i, n), text))
    return [t for _, t in sorted(keyed)]


@pytest.mark.parametrize("merge", [True, False])
def test_random_orders(spark, merge):
    rng = random.Random(7)
    for _ in range(3):
        files = []
        for _ in range(3):
            stamps = [str(rng.randint(1, 6)) for _ in range(rng.randint(0, 6))]
            lines = [(t, f"e{rng.random()}") for t in (sorted(stamps) if merge else stamps)]
            for _ in range(rng.randint(0, 5)):
                lines.insert(rng.randint(0, len(lines)), (None, f"r{rng.random()}"))
            files.append(lines)
        rows = [(i, n, ts, text) for i, lines in enumerate(files) for n, (ts, text) in enumerate(lines)]
        df = spark.createDataFrame(rows, "input_index int, line_no bigint, ts string, text string")
        df = od.with_neighbours(df, chunk_lines=2)
        got = [r.text for r in df.orderBy(*(od.merge_key() if merge else od.sort_key())).collect()]
        assert got == reference_order(files, merge)
        numbered = od.number_rows(df, od.merge_key() if merge else od.sort_key(), "p").orderBy("p").collect()
        assert [r.text for r in numbered] == got and [r.p for r in numbered] == list(range(1, len(got) + 1))


def test_the_violation_that_is_met_first(spark, tmp_path):
    a = write(tmp_path / "a.log", entry("05", "a"), entry("09", "b"), entry("08", "late"))
    b = write(tmp_path / "b.log", entry("01", "a"), entry("07", "b"), "raw", entry("02", "early"))
    c = write(tmp_path / "c.log", entry("06", "a"), '{"x":1}', '{"y":1}')
    out = str(tmp_path / "out.log")
    for inputs, merged, sorted_ in (([a, b, c], (c, 2), (c, 2)), ([a, b], (b, 4), None), ([c, c], (c, 2), (c, 2))):
        with pytest.raises(LogOrderError) as e:
            merge_files(spark, inputs, out)
        assert (e.value.file, e.value.line) == merged
        if sorted_:
            with pytest.raises(LogOrderError) as e:
                sort_files(spark, inputs, out)
            assert (e.value.file, e.value.line) == sorted_
        else:
            assert sort_files(spark, inputs, out) == 7


def test_outputs_that_cannot_be_written(spark, tmp_path, capsys):
    a = write(tmp_path / "a.log", entry("1", "x"))
    (tmp_path / "dir").mkdir()
    (tmp_path / "file").write_text("")
    for out in (str(tmp_path / "dir"), str(tmp_path / "file" / "out.log")):
        assert cli.main(["sort", a, "--output", out], spark) == 1
    assert capsys.readouterr().err.count("logweave sort: ") == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.log", "dir", "file"] and list((tmp_path / "dir").iterdir()) == []


def test_cli(spark, tmp_path, capsys):
    a, out = write(tmp_path / "a.log", entry("1", "x")), str(tmp_path / "o")
    assert cli.main(["sort", a, "--output", out], spark) == 0
    assert cli.main(["merge", "--output", out], spark) == 2 and cli.main(["merge", a], spark) == 2 and cli.main([], spark) == 2
    assert cli.main(["merge", "--output", a, a], spark) == 2
    link = tmp_path / "link.log"
    link.symlink_to(a)
    assert cli.main(["merge", "--output", str(link), a], spark) == 1
    assert cli.main(["merge", "--output", out, str(tmp_path / "none")], spark) == 1
    assert "usage: " in capsys.readouterr().err
    assert cli.parse_arguments(["--output", "x", "a", "--y", "--output", "z"]) == ("z", ["a", "--y"])
