"""Queries over sessions, files and the command line: the tables written as logs, opened, filtered, reloaded, merged and followed."""

from __future__ import annotations

import contextlib
import io
import tempfile
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import cli
from logweave.functions.query import QuerySyntaxError, is_valid_field_name, needs_line_text, parse
from logweave.operators import fields as fl
from logweave.operators import ordering as od
from logweave.plans import catalog as c
from logweave.plans.catalog import query
from logweave.plans.materialize import fresh_folder
from logweave.plans.session import Session, Tab, Workspace
from logweave.sources.lines import classify, read_log
from logweave.sources.sink import write_lines
from logweave.streaming.tail import tail

_BEFORE = set(c.QUERIES)


def _event_file(spark: SparkSession, sf_dir: str, name: str = "events.log", where: str = "true") -> str:
    path = f"{fresh_folder(spark, 'logs')}/{name}"
    write_lines(c.event_lines(spark, sf_dir).where(where).orderBy("line_no").select("value"), path)
    return path


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_EVENTS, _MIXED, _TS = c._EVENTS, c._MIXED, """json_extract_string(value, '$."@timestamp"')"""
_NUMBERED = f"{_EVENTS}, numbered AS (SELECT CAST(row_number() OVER (ORDER BY line_no) AS BIGINT) AS line_no, value FROM event_lines)"
_level = lambda name: f"json_extract_string(value, '$.level') = '{name}'"

# Lines that are no UTF-8.


def _damaged(spark, d) -> DataFrame:
    broken = F.concat(F.col("value").cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    return c.event_lines(spark, d).withColumn("value", F.when(F.col("line_no") % 5 == 0, broken).otherwise(F.col("value")))


@query("lossy_text", f"WITH {_EVENTS} SELECT line_no, CASE WHEN line_no % 5 = 0 THEN value || chr(65533) ELSE json_extract_string(value, '$.level') END AS c0 FROM event_lines")
def _lossy(spark, d):
    return fl.project(classify(_damaged(spark, d)), ["level"])


@query(
    "strict_violations",
    f"""WITH {_EVENTS} SELECT line_no, CASE WHEN line_no % 5 = 0 THEN 'invalid UTF-8' ELSE 'entry without a string @timestamp' END AS reason
 FROM event_lines WHERE line_no % 5 = 0 OR line_no % 7 = 0""",
)
def _strict(spark, d):
    stampless = F.when(F.col("line_no") % 7 == 0, F.replace("value", F.lit('"@timestamp":"'), F.lit('"@timestamp":7,"t":"'))).otherwise(F.col("value"))
    lines = _damaged(spark, d).withColumn("value", F.when(F.is_valid_utf8("value"), stampless).otherwise(F.col("value")))
    lines = lines.withColumns({"input_index": F.lit(0), "file": F.lit("a.log"), "prev_ts": F.lit(None).cast("string")})
    return od.violations(od.prepare(lines).withColumn("prev_ts", F.lit(None).cast("string")), ordered=False).select("line_no", "reason")


# Files: single lines, counts, empty and raw-only inputs, ties.


@query("file_line_at", f"WITH {_NUMBERED} SELECT line_no, value FROM numbered WHERE line_no IN (1, 77, 500)")
def _file_line(spark, d):
    return read_log(spark, _event_file(spark, d)).where("line_no in (1, 77, 500)").select("line_no", "value")


@query("file_counts", f"WITH {_MIXED} SELECT input_index, count(*) AS written, count(*) AS found FROM mixed GROUP BY input_index")
def _file_counts(spark, d):
    folder, lines = fresh_folder(spark, "logs"), c.mixed_log(spark, d)
    written = [write_lines(lines.where(F.col("input_index") == i).orderBy(*c.ORDER).select("value"), f"{folder}/in{i}.log") for i in range(3)]
    found = read_log(spark, *(f"{folder}/in{i}.log" for i in range(3))).groupBy("input_index").agg(F.max("line_no").alias("found"))
    return _rows(spark, [*enumerate(written)], "input_index int, written bigint").join(found, "input_index").select("input_index", "written", "found")


@query("field_discovery_file", f"WITH {_NUMBERED} SELECT DISTINCT unnest(json_keys(value)) AS field FROM numbered")
def _discovery(spark, d):
    return fl.discover_fields(classify(read_log(spark, _event_file(spark, d))))


@query(
    "merge_empty_and_raw_inputs",
    f"""WITH {_EVENTS}, {c._DOCS}, r AS (SELECT value, 1 AS late, '' AS ts, doc_id AS a, pos AS b FROM doc_lines WHERE doc_id % 3 = 0),
 e AS (SELECT {c._CANON} || ',"system":"events.log"' || {c._USER} AS value, 0 AS late, ts, line_no AS a, 0 AS b FROM (SELECT *, {_TS} AS ts FROM event_lines))
 SELECT CAST(row_number() OVER (ORDER BY late, ts, a, b) AS BIGINT) AS line_no, value FROM (SELECT * FROM r UNION ALL SELECT * FROM e)""",
)
def _merge_empty(spark, d):
    folder, events = fresh_folder(spark, "logs"), _event_file(spark, d)
    write_lines(c.doc_lines(spark, d).where("doc_id % 3 = 0").orderBy("doc_id", "pos").select("value"), f"{folder}/raw.log")
    write_lines(c.doc_lines(spark, d).where("false").select("value"), f"{folder}/empty.log")
    od.merge_files(spark, [f"{folder}/raw.log", f"{folder}/empty.log", events], f"{folder}/out.log")
    return read_log(spark, f"{folder}/out.log").select("line_no", "value")


def _daily(spark, d) -> DataFrame:
    """Entries that tie by day, with a system of their own, and a raw line after every tenth."""
    day = F.date_format("ts", "yyyy-MM-dd")
    line = F.concat(F.lit('{"@timestamp":"'), day, F.lit('","n":'), F.col("event_id").cast("string"), F.lit(',"system":"kept"}'))
    lines = F.when(F.col("event_id") % 10 == 0, F.array(line, F.concat(F.lit("raw "), F.col("event_id").cast("string")))).otherwise(F.array(line))
    return c._table(spark, d, "events").select("event_id", (F.col("event_id") % 3).cast("int").alias("input_index"), day.alias("day"), F.posexplode(lines).alias("pos", "value"))


_DAILY = """daily AS (SELECT event_id, CAST(event_id % 3 AS INTEGER) AS input_index, strftime(ts, '%Y-%m-%d') AS day, unnest(CASE WHEN event_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS pos FROM events),
 lines AS (SELECT *, CASE WHEN pos = 0 THEN '{"@timestamp":"' || day || '","n":' || CAST(event_id AS VARCHAR) || ',"system":"kept"}' ELSE 'raw ' || CAST(event_id AS VARCHAR) END AS value,
 CASE WHEN pos = 0 THEN day END AS stamp FROM daily)"""
_NEXT = "first_value({0} IGNORE NULLS) OVER (PARTITION BY input_index ORDER BY {1} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_day, last_value({0} IGNORE NULLS) OVER (PARTITION BY input_index ORDER BY {1} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_day"


@query(
    "sort_ties",
    f"""WITH {_DAILY}, n AS (SELECT *, {_NEXT.format("stamp", "event_id, pos")} FROM lines)
 SELECT CAST(row_number() OVER (ORDER BY next_day IS NULL, next_day, input_index, event_id, pos) AS BIGINT) AS line_no, value FROM n""",
)
def _sort_ties(spark, d):
    out = f"{fresh_folder(spark, 'logs')}/sorted.log"
    od.sort_files(spark, c._files(spark, _daily(spark, d), ("event_id", "pos")), out)
    return read_log(spark, out).select("line_no", "value")


@query(
    "merge_ties",
    f"""WITH {_DAILY}, n AS (SELECT *, {_NEXT.format("stamp", "day, event_id, pos")} FROM lines)
 SELECT CAST(row_number() OVER (ORDER BY coalesce(next_day, last_day) IS NULL, coalesce(next_day, last_day), input_index, day, event_id, pos) AS BIGINT) AS line_no,
 replace(value, '"kept"', '"in' || CAST(input_index AS VARCHAR) || '.log"') AS value FROM n""",
)
def _merge_ties(spark, d):
    out = f"{fresh_folder(spark, 'logs')}/merged.log"
    od.merge_files(spark, c._files(spark, _daily(spark, d), ("day", "event_id", "pos")), out)
    return read_log(spark, out).select("line_no", "value")


# The filter language as such.

_TEXTS = ["level={0}", "{0}", "level={0} or {0}", "(level={0} x='{0}')", "level={0}(", "'{0}", "or {0}", "level= {0}", "1{0}=x", "({0} or user=3) y=z"]
_TYPES = "types AS (SELECT DISTINCT event_type AS t FROM events)"


def _types(spark, d) -> list[str]:
    return [r[0] for r in c._table(spark, d, "events").select("event_type").distinct().collect()]


@query(
    "query_texts",
    f"""WITH {_TYPES}, q(k, text, needs, error) AS (VALUES (0, 'level=@', false, NULL), (1, '@', true, NULL), (2, 'level=@ or @', true, NULL), (3, '(level=@ x=''@'')', false, NULL),
 (4, 'level=@(', NULL, 'missing closing'), (5, '''@', NULL, 'unterminated quote'), (6, 'or @', NULL, 'expected a term'), (7, 'level= @', NULL, 'missing value after ''level='''),
 (8, '1@=x', NULL, 'invalid field name ''1@'''), (9, '(@ or user=3) y=z', true, NULL))
 SELECT replace(text, '@', t) AS text, needs AS needs_text, replace(error, '@', t) AS error FROM types, q""",
)
def _query_texts(spark, d):
    rows = []
    for t in _types(spark, d):
        for text in (x.format(t) for x in _TEXTS):
            try:
                rows.append((text, needs_line_text(parse(text)), None))
            except QuerySyntaxError as e:
                said = str(e)
                rows.append((text, None, "missing closing" if said.startswith("missing closing") else said))
    return _rows(spark, rows, "text string, needs_text boolean, error string")


@query(
    "field_names",
    f"""WITH {_TYPES}, n AS (SELECT t || s AS name FROM types, (VALUES (''), ('.x'), ('@'), ('_1'), ('-x'), (' ')) v(s) UNION ALL SELECT s || t FROM types, (VALUES ('1'), ('@'), ('.'), ('_')) v(s))
 SELECT name, regexp_full_match(name, '[@A-Za-z_][@A-Za-z0-9_.]*') AS valid FROM n""",
)
def _field_names(spark, d):
    names = [n for t in _types(spark, d) for n in (t, f"{t}.x", f"{t}@", f"{t}_1", f"{t}-x", f"{t} ", f"1{t}", f"@{t}", f".{t}", f"_{t}")]
    return _rows(spark, [(n, is_valid_field_name(n)) for n in names], "name string, valid boolean")


@query(
    "default_columns",
    f"""WITH {_MIXED}, f AS (SELECT DISTINCT unnest(json_keys(value)) AS field FROM mixed WHERE kind = 0),
 n AS (SELECT unnest(['n_name', 'n_nationkey', 'n_regionkey']) AS field) SELECT 'mixed' AS log, CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS position, f.field
 FROM f JOIN (VALUES ('@timestamp', 1), ('level', 2), ('message', 3)) d(field, p) ON f.field = d.field UNION ALL SELECT 'nations', CAST(row_number() OVER (ORDER BY field) AS INTEGER), field FROM n""",
)
def _default_columns(spark, d):
    logs = {"mixed": c.mixed_log(spark, d), "nations": c._table(spark, d, "nation").select(F.to_json(F.struct("*")).alias("value"))}
    names = {k: [r[0] for r in fl.discover_fields(classify(v)).collect()] for k, v in logs.items()}
    return _rows(spark, [(k, i, x) for k, v in names.items() for i, x in enumerate(fl.default_columns(v), 1)], "log string, position int, field string")


# Sessions.


def _open(spark: SparkSession, path: str, state: str | None = None) -> tuple[Session, Tab]:
    session = Session(spark, state)
    return session, session.open(path)


_CHANGED = ["", "level=ERROR", "level=error", "(level=VIEW or level=CLICK) user=42", "level=ERROR level=VIEW", "level="]


@query(
    "session_counts",
    f"""WITH {_NUMBERED} SELECT '' AS text, count(*) AS shown, count(*) AS total, false AS failed FROM numbered UNION ALL SELECT 'level=ERROR', count(*) FILTER (WHERE {_level('ERROR')}), count(*), false FROM numbered
 UNION ALL SELECT 'level=error', 0, count(*), false FROM numbered UNION ALL SELECT '(level=VIEW or level=CLICK) user=42', count(*) FILTER (WHERE ({_level('VIEW')} OR {_level('CLICK')})
 AND json_extract_string(value, '$.user') = '42'), count(*), false FROM numbered UNION ALL SELECT 'level=ERROR level=VIEW', 0, count(*), false FROM numbered UNION ALL SELECT 'level=', count(*), count(*), true FROM numbered""",
)
def _session_counts(spark, d):
    session, tab = _open(spark, _event_file(spark, d))
    rows = []
    for text in _CHANGED:
        tab.apply(text)
        rows.append((text, *tab.counts(), tab.error is not None))
    session.close(0)
    return _rows(spark, rows, "text string, shown bigint, total bigint, failed boolean")


@query(
    "session_reset",
    f"WITH {_NUMBERED} SELECT 1 AS step, count(*) FILTER (WHERE {_level('PURCHASE')}) AS shown, 'level=PURCHASE' AS text FROM numbered UNION ALL SELECT 2, count(*), '' FROM numbered",
)
def _session_reset(spark, d):
    session, tab = _open(spark, _event_file(spark, d))
    tab.edit("level=PURCHASE")
    rested = tab.poll()  # not before the text has rested
    tab.poll(force=not rested)
    rows = [(1, tab.counts()[0], tab.applied)]
    tab.reset()
    rows.append((2, tab.counts()[0], tab.applied))
    session.close(0)
    return _rows(spark, rows, "step int, shown bigint, text string")


@query(
    "session_click",
    f"""WITH {_NUMBERED}, clicked AS (SELECT line_no AS line, json_extract_string(value, '$.level') AS lv, json_extract_string(value, '$.user') AS u, CAST(json_extract(value, '$.props.k') AS VARCHAR) AS k FROM numbered WHERE line_no IN (3, 40)),
 cells AS (SELECT line, 'level' AS field, 'level=''' || lv || '''' AS text, lv, NULL AS u, NULL AS k FROM clicked UNION ALL SELECT line, 'user', 'user=''' || u || '''', NULL, u, NULL FROM clicked
 UNION ALL SELECT line, 'props', 'props=''{{"k":' || k || '}}''', NULL, NULL, k FROM clicked)
 SELECT line, field, text, (SELECT count(*) FROM numbered n WHERE (cells.lv IS NULL OR json_extract_string(n.value, '$.level') = cells.lv) AND (cells.u IS NULL OR json_extract_string(n.value, '$.user') = cells.u)
 AND (cells.k IS NULL OR CAST(json_extract(n.value, '$.props.k') AS VARCHAR) = cells.k)) AS shown FROM cells""",
)
def _session_click(spark, d):
    session, tab = _open(spark, _event_file(spark, d))
    rows = []
    for line in (3, 40):
        for name in ("level", "user", "props", "none"):
            if tab.filter_by_cell(line, name):
                rows.append((line, name, tab.query, tab.counts()[0]))
    session.close(0)
    return _rows(spark, rows, "line bigint, field string, text string, shown bigint")


@query(
    "session_columns",
    f"""WITH {_NUMBERED} SELECT line_no, json_extract_string(value, '$.user') AS c0, '{{"k":' || CAST(json_extract(value, '$.props.k') AS VARCHAR) || '}}' AS c1 FROM numbered
 WHERE {_level('VIEW')} ORDER BY line_no LIMIT 20 OFFSET 35""",
)
def _session_columns(spark, d):
    """Columns chosen in one session hold in the next one on the same file."""
    path = _event_file(spark, d)
    with tempfile.TemporaryDirectory() as home:  # the workspace is the user's own file
        session, tab = _open(spark, path, f"{home}/state.json")
        for name, visible in (("@timestamp", False), ("level", False), ("user", True), ("props", True), ("user", True)):
            session.set_column_visible(tab, name, visible)
        session.close(0)
        session, tab = _open(spark, path, f"{home}/state.json")
    tab.apply("level=VIEW")
    rows = [tuple(r) for r in tab.page(35, 20)]
    session.close(0)
    return _rows(spark, rows, "line_no bigint, c0 string, c1 string")


@query("session_detail", f"WITH {_NUMBERED} SELECT line_no, {c._PRETTY} AS detail FROM numbered WHERE line_no IN (1, 9, 200)")
def _session_detail(spark, d):
    session, tab = _open(spark, _event_file(spark, d))
    rows = []
    for line in (1, 9, 200, 200, 10**9):  # the second click on a line takes the selection away; the last line is not there
        tab.toggle_selection(line)
        if (text := tab.detail()) is not None:
            rows.append((tab.selected_line, text))
    session.close(0)
    return _rows(spark, rows, "line_no bigint, detail string")


@query(
    "session_reload",
    f"""WITH {_NUMBERED} SELECT 'before' AS at, count(*) FILTER (WHERE {_level('ERROR')}) AS shown, count(*) AS total FROM numbered
 UNION ALL SELECT 'after', count(*) FILTER (WHERE {_level('ERROR')}), count(*) FROM event_lines WHERE line_no % 2 = 0""",
)
def _session_reload(spark, d):
    path = _event_file(spark, d)
    session, tab = _open(spark, path)
    tab.apply("level=ERROR")
    rows = [("before", *tab.counts())]
    write_lines(c.event_lines(spark, d).where("line_no % 2 = 0").orderBy("line_no").select("value"), path)
    tab.reload()
    rows.append(("after", *tab.counts()))
    session.close(0)
    return _rows(spark, rows, "at string, shown bigint, total bigint")


@query(
    "session_tabs",
    f"""WITH {_EVENTS}, n AS (SELECT count(*) FILTER (WHERE {_level('ERROR')}) AS shown, count(*) AS total FROM event_lines WHERE line_no % 2 = 1)
 SELECT step, tabs, active, label, shown, total FROM n, (VALUES (1, 1, 0, 'odd.log'), (2, 2, 1, 'even.log'), (3, 2, 0, 'odd.log'), (4, 1, 0, 'odd.log')) s(step, tabs, active, label)""",
)
def _session_tabs(spark, d):
    """Opening what is open focuses it, each tab keeps its own filter, and closing leaves the other one."""
    odd, even = _event_file(spark, d, "odd.log", "line_no % 2 = 1"), _event_file(spark, d, "even.log", "line_no % 2 = 0")
    session, tab = _open(spark, odd)
    tab.apply("level=ERROR")
    rows = []

    def note(step: int) -> None:
        rows.append((step, len(session.tabs), session.active, session.tabs[session.active].label, *tab.counts()))

    note(1)
    session.open(even).apply("level=VIEW")
    note(2)
    session.open(odd)
    note(3)
    session.close(1)
    note(4)
    session.close(0)
    return _rows(spark, rows, "step int, tabs int, active int, label string, shown bigint, total bigint")


@query("favorites", "SELECT CAST(row_number() OVER (ORDER BY lower(n_name || '.log')) AS INTEGER) AS position, n_name || '.log' AS path FROM nation WHERE n_nationkey % 4 <> 1")
def _favorites(spark, d):
    """Toggled, removed, saved, loaded and sorted without regard to case."""
    nations = c._table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(".log"))).collect()
    with tempfile.TemporaryDirectory() as home:
        session = Session(spark, f"{home}/state.json")
        for key, path in nations:
            session.toggle_favorite(path)
            if key % 8 == 1:
                session.toggle_favorite(path)
        for key, path in nations:
            if key % 4 == 1:
                session.workspace.remove_favorite(path)
        session.workspace.save(f"{home}/state.json")
        found = Workspace.load(f"{home}/state.json").sorted_favorites()
    return _rows(spark, [*enumerate(found, 1)], "position int, path string")


@query(
    "workspace_files",
    """SELECT * FROM (VALUES ('{', 'ctrl', 0), ('{"favorites":["a","b"],"filter_modifier":"alt"}', 'alt', 2), ('{"filter_modifier":"none"}', 'ctrl', 0), ('{"favorites":[1]}', 'ctrl', 0),
 ('{"columns":{"x":["level"]},"filter_modifier":"command"}', 'command', 0)) t(text, modifier, favorites)""",
)
def _workspace(spark, d):
    rows = []
    with tempfile.TemporaryDirectory() as home:
        for text in ("{", '{"favorites":["a","b"],"filter_modifier":"alt"}', '{"filter_modifier":"none"}', '{"favorites":[1]}', '{"columns":{"x":["level"]},"filter_modifier":"command"}'):
            with open(f"{home}/state.json", "w") as f:
                f.write(text)
            found = Workspace.load(f"{home}/state.json")
            rows.append((text, found.filter_modifier, len(found.favorites)))
    return _rows(spark, rows, "text string, modifier string, favorites int")


@query("scan_cancelled", f"WITH {_NUMBERED} SELECT true AS ended, count(*) FILTER (WHERE {_level('ERROR')}) AS shown, count(*) AS total FROM numbered")
def _cancelled(spark, d):
    """A scan that would take hours ends when its tab gets a new query; the new one is answered."""
    session, tab = _open(spark, _event_file(spark, d))

    @F.udf("boolean")
    def slow(text):
        time.sleep(1)
        return True

    tab._predicate, ends = slow("value"), []

    def scan() -> None:
        with contextlib.suppress(Exception):
            tab.counts()
        ends.append(time.monotonic())

    thread = threading.Thread(target=scan)
    thread.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds() and thread.is_alive():
        time.sleep(0.05)
    time.sleep(0.3)
    tab.apply("level=ERROR")
    thread.join(20)
    rows = [(bool(ends), *tab.counts())]
    session.close(0)
    return _rows(spark, rows, "ended boolean, shown bigint, total bigint")


# The command line, and following a folder.


@query(
    "command_line",
    """SELECT * FROM (VALUES ('sort', 0, ''), ('merge', 0, ''), ('no command', 2, 'usage: logweave merge|sort --output <path> <input>...'), ('no output', 2, 'usage: logweave merge --output <path> <input>...'),
 ('no input', 2, 'usage: logweave sort --output <path> <input>...'), ('output is an input', 2, 'logweave merge: output a.log is also an input'), ('output by another name', 1, 'logweave sort: ./a.log: output is also input a.log'),
 ('not there', 1, 'logweave merge: none.log: File none.log does not exist'), ('out of order', 1, 'logweave merge: b.log:2: @timestamp is earlier than the previous entry''s')) t(run, code, said)""",
)
def _command_line(spark, d):
    folder = fresh_folder(spark, "logs")
    events = c.event_lines(spark, d).where("line_no <= 50")
    write_lines(events.orderBy(c.F.get_json_object("value", "$['@timestamp']"), "line_no").select("value"), f"{folder}/a.log")
    write_lines(events.orderBy(F.desc(F.get_json_object("value", "$['@timestamp']"))).select("value"), f"{folder}/b.log")
    a, b, out = f"{folder}/a.log", f"{folder}/b.log", f"{folder}/out.log"
    runs = {
        "sort": ["sort", b, "--output", out, a], "merge": ["merge", "--output", out, a, a], "no command": ["x", a], "no output": ["merge", a], "no input": ["sort", "--output", out],
        "output is an input": ["merge", "--output", a, a], "output by another name": ["sort", "--output", f"{folder}/./a.log", a], "not there": ["merge", "--output", out, f"{folder}/none.log"],
        "out of order": ["merge", "--output", out, b],
    }
    rows = []
    for name, args in runs.items():
        with contextlib.redirect_stderr(io.StringIO()) as said:
            code = cli.main(args, spark)
        lines = said.getvalue().splitlines()
        rows.append((name, code, lines[0].replace(f"{folder}/", "").replace(folder.removeprefix("file:") + "/", "") if lines else ""))
    return _rows(spark, rows, "run string, code int, said string")


@query("tail_stream", f"WITH {_EVENTS} SELECT value FROM event_lines WHERE {_level('ERROR')}")
def _tail(spark, d):
    folder, name = fresh_folder(spark, "logs"), f"tail_{time.monotonic_ns()}"
    c.event_lines(spark, d).select("value").write.text(folder)
    tail(spark, folder, "level=ERROR").select("value").writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


#: The queries of this module.
NAMES = set(c.QUERIES) - _BEFORE
