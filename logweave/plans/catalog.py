"""The query catalogue over the tables, with an SQL twin for each query that SQL can express.

Log views: ``event_lines`` renders ``events`` as JSON lines, ``doc_lines`` splits ``documents.text``,
``mixed_log`` interleaves both over three inputs (entries from the first, raw lines from the second).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import jsontext
from logweave.functions.query import compile_predicate, filter_lines, filter_term, parse
from logweave.operators import fields as fl
from logweave.operators import ordering as od
from logweave.plans.materialize import fresh_folder
from logweave.sources.lines import classify, read_log, split_text
from logweave.sources.sink import write_lines

ORDER = ("id", "kind", "pos")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.concat(
        F.lit('{"@timestamp":"'), stamp, F.lit('","level":"'), F.upper("event_type"), F.lit('","user":'), F.col("user_id").cast("string"), F.lit(',"props":'), "props", F.lit("}")
    )
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), line.alias("value"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_text(_table(spark, sf_dir, "documents"), keep=("doc_id",))


def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_lines(spark, sf_dir).select(F.col("line_no").alias("id"), F.lit(0).alias("kind"), F.lit(0).alias("pos"), "value")
    docs = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit(1).alias("kind"), "pos", "value")
    return events.unionByName(docs).withColumn("input_index", (F.col("id") % 3).cast("int"))


_EVENTS = """event_lines AS (SELECT event_id AS line_no, '{"@timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","level":"' || upper(event_type)
 || '","user":' || CAST(user_id AS VARCHAR) || ',"props":' || props || '}' AS value FROM events)"""
_DOCS = """doc_lines AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, value FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos,
 unnest(string_split(text, chr(10))) AS value FROM documents))"""
_MIXED = f"""{_EVENTS}, {_DOCS}, mixed AS (SELECT id, kind, pos, value, CAST(id % 3 AS INTEGER) AS input_index FROM (
 SELECT line_no AS id, 0 AS kind, 0 AS pos, value FROM event_lines UNION ALL SELECT doc_id, 1, pos, value FROM doc_lines))"""
_NEIGHBOURS = f"""{_MIXED}, e AS (SELECT *, CASE WHEN kind = 0 THEN json_extract_string(value, '$."@timestamp"') END AS ts FROM mixed),
 n AS (SELECT *, first_value(ts IGNORE NULLS) OVER (PARTITION BY input_index ORDER BY id, kind, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_ts,
 last_value(ts IGNORE NULLS) OVER (PARTITION BY input_index ORDER BY id, kind, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_ts FROM e)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("line_split", f"WITH {_DOCS} SELECT doc_id, pos, value FROM doc_lines")
def _line_split(spark, d):
    return doc_lines(spark, d)


@query("classify_lines", f"WITH {_MIXED} SELECT CASE WHEN json_valid(value) AND json_type(value) = 'OBJECT' THEN 'entry' ELSE 'raw' END AS class, count(*) AS n FROM mixed GROUP BY 1")
def _classify(spark, d):
    return classify(mixed_log(spark, d)).groupBy(F.when(F.col("entry").isNull(), "raw").otherwise("entry").alias("class")).agg(F.count("*").alias("n"))


def _filter_docs(name: str, text: str, sql: str) -> None:
    @query(name, f"WITH {_DOCS} SELECT doc_id, pos, value FROM doc_lines WHERE {sql}")
    def run(spark, d):
        return filter_lines(doc_lines(spark, d), parse(text)).select("doc_id", "pos", "value")


def _filter_events(name: str, text: str, sql: str) -> None:
    @query(name, f"WITH {_EVENTS} SELECT line_no, value FROM event_lines WHERE {sql}")
    def run(spark, d):
        return filter_lines(event_lines(spark, d), parse(text)).select("line_no", "value")


_field = lambda name, value: f"json_extract_string(value, '$.\"{name}\"') = '{value}'"
_filter_docs("filter_substring", "THING", "contains(lower(value), 'thing')")
_filter_docs("filter_phrase", "'the the'", "contains(lower(value), 'the the')")
_filter_docs("filter_empty", "  ", "true")
_filter_events("filter_field_eq", "level=ERROR", _field("level", "ERROR"))
_filter_events("filter_field_num", "user=42", _field("user", "42"))
_filter_events("filter_and", "level=CLICK '\"k\": 7'", f"{_field('level', 'CLICK')} AND contains(lower(value), '\"k\": 7')")
_filter_events("filter_or", "level=CLICK OR level=VIEW", f"{_field('level', 'CLICK')} OR {_field('level', 'VIEW')}")
FLAGSHIP = "level=ERROR ('\"k\": 9' or '\"k\": 7')"
_filter_events("filter_group", FLAGSHIP, f"{_field('level', 'ERROR')} AND (contains(value, '\"k\": 9') OR contains(value, '\"k\": 7'))")
_filter_events(
    "filter_nested",
    "(level=ERROR or (level=VIEW ('\"k\": 1' or user=3))) 2024",
    f"({_field('level', 'ERROR')} OR ({_field('level', 'VIEW')} AND (contains(value, '\"k\": 1') OR {_field('user', '3')}))) AND contains(value, '2024')",
)
_filter_events("filter_nested_value", "props={\"k\":7}", "json_extract(value, '$.props.k')::VARCHAR = '7'")


def _errors(spark, d):
    return filter_lines(event_lines(spark, d), parse("level=ERROR"))


@query("row_mapping", f"WITH {_EVENTS} SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS row FROM event_lines WHERE {_field('level', 'ERROR')}")
def _row_mapping(spark, d):
    return fl.row_mapping(_errors(spark, d).select("line_no"))


@query("page_rows", f"WITH {_EVENTS} SELECT line_no, value FROM event_lines WHERE {_field('level', 'ERROR')} ORDER BY line_no LIMIT 50 OFFSET 100")
def _page(spark, d):
    return fl.page(_errors(spark, d).select("line_no", "value"), 100, 50)


@query("line_at", f"WITH {_EVENTS} SELECT line_no, value FROM event_lines WHERE line_no = 123")
def _line_at(spark, d):
    return event_lines(spark, d).where("line_no = 123")


@query("line_count", f"WITH {_EVENTS} SELECT count(*) AS n FROM event_lines")
def _line_count(spark, d):
    return event_lines(spark, d).agg(F.count("*").alias("n"))


@query("shown_total", f"WITH {_EVENTS} SELECT count(*) FILTER (WHERE {_field('level', 'ERROR')}) AS shown, count(*) AS total FROM event_lines")
def _shown(spark, d):
    lines = classify(event_lines(spark, d))
    return fl.shown_total(lines, compile_predicate(parse("level=ERROR")))


@query("discover_fields", f"WITH {_MIXED} SELECT DISTINCT unnest(json_keys(value)) AS field FROM mixed WHERE kind = 0")
def _discover(spark, d):
    return fl.discover_fields(classify(mixed_log(spark, d)))


_LONG = "CASE WHEN length(value) > 5000 THEN left(value, 5000) || '...' ELSE value END"
_EVENT_FIELDS = "json_extract_string(value, '$.\"@timestamp\"')", "json_extract_string(value, '$.level')"


@query(
    "project_columns",
    f"""WITH {_MIXED} SELECT id, kind, pos, CASE WHEN kind = 0 THEN {_EVENT_FIELDS[0]} ELSE {_LONG} END AS c0,
 CASE WHEN kind = 0 THEN {_EVENT_FIELDS[1]} ELSE '' END AS c1, '' AS c2 FROM mixed""",
)
def _project(spark, d):
    lines = classify(mixed_log(spark, d))
    return fl.project(lines, ["@timestamp", "level", "missing"], keep=ORDER)


@query("raw_projection", f"WITH {_MIXED} SELECT id, kind, pos, {_LONG} AS raw FROM mixed")
def _raw(spark, d):
    return fl.project(mixed_log(spark, d), [], keep=ORDER)


@query("severity_class", f"WITH {_EVENTS} SELECT line_no, CASE WHEN json_extract_string(value, '$.level') = 'ERROR' THEN 'error' END AS severity FROM event_lines")
def _severity(spark, d):
    lines = classify(event_lines(spark, d))
    return lines.select("line_no", fl.severity(lines).alias("severity"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS cut FROM documents")
def _truncate(spark, d):
    return _table(spark, d, "documents").select("doc_id", fl.truncate(F.col("text"), 1000).alias("cut"))


@query("field_name_filter", f"WITH {_EVENTS} SELECT DISTINCT k AS field FROM (SELECT unnest(json_keys(value)) AS k FROM event_lines) WHERE contains(lower(k), 'ser')")
def _name_filter(spark, d):
    found = fl.discover_fields(classify(event_lines(spark, d)))
    return found.where(fl.matches_field_filter(F.col("field"), " SER "))


def _ordered(spark, d, stamp: bool) -> DataFrame:
    lines = mixed_log(spark, d).withColumn("file", F.concat(F.lit("/logs/in"), F.col("input_index"), F.lit(".log")))
    return od.with_neighbours(od.prepare(lines, stamp=stamp), order=ORDER)


_MERGE_POS = "CAST(row_number() OVER (ORDER BY CASE WHEN coalesce(next_ts, last_ts) IS NULL THEN 1 ELSE 0 END, coalesce(next_ts, last_ts), input_index, id, kind, pos) AS BIGINT)"
_SORT_POS = "CAST(row_number() OVER (ORDER BY CASE WHEN next_ts IS NULL THEN 1 ELSE 0 END, next_ts, input_index, id, kind, pos) AS BIGINT)"
#: Keys of the canonical text are sorted.
_CANON = """'{"@timestamp":"' || ts || '","level":"' || json_extract_string(value, '$.level') || '","props":{"k":' || CAST(json_extract(value, '$.props.k') AS VARCHAR) || '}'"""
_USER = """',"user":' || json_extract_string(value, '$.user') || '}'"""


@query("merge_ordered", f"WITH {_NEIGHBOURS} SELECT {_MERGE_POS} AS position, id, kind, pos, input_index, CASE WHEN kind = 0 THEN {_CANON} || {_USER} ELSE value END AS text FROM n")
def _merge(spark, d):
    lines = _ordered(spark, d, False)
    return od.number_rows(lines, od.merge_key(ORDER), "position").select("position", *ORDER, "input_index", "text")


@query(
    "merge_stamped",
    f"""WITH {_NEIGHBOURS} SELECT {_MERGE_POS} AS position, id, kind, pos, input_index,
 CASE WHEN kind = 0 THEN {_CANON} || ',"system":"in' || CAST(input_index AS VARCHAR) || '.log"' || {_USER} ELSE value END AS text FROM n""",
)
def _merge_stamped(spark, d):
    lines = _ordered(spark, d, True)
    return od.number_rows(lines, od.merge_key(ORDER), "position").select("position", *ORDER, "input_index", "text")


@query("sort_ordered", f"WITH {_NEIGHBOURS} SELECT {_SORT_POS} AS position, id, kind, pos, input_index FROM n")
def _sort(spark, d):
    return od.number_rows(_ordered(spark, d, False), od.sort_key(ORDER), "position").select("position", *ORDER, "input_index")


@query(
    "merge_violations",
    f"""WITH {_EVENTS}, s AS (SELECT line_no, CAST(line_no % 3 AS INTEGER) AS input_index, (line_no * 7919) % 10007 AS slot, json_extract_string(value, '$."@timestamp"') AS ts
 FROM event_lines), l AS (SELECT *, lag(ts) OVER (PARTITION BY input_index ORDER BY slot, line_no) AS prev_ts FROM s)
 SELECT line_no, input_index, prev_ts FROM l WHERE ts < prev_ts""",
)
def _violations(spark, d):
    lines = event_lines(spark, d).withColumns({"input_index": (F.col("line_no") % 3).cast("int"), "slot": (F.col("line_no") * 7919) % 10007, "file": F.lit("shuffled.log")})
    lines = od.with_neighbours(od.prepare(lines), order=("slot", "line_no"))
    return od.violations(lines, ordered=True).select("line_no", "input_index", "prev_ts")


@query("filter_term_roundtrip", f"WITH {_EVENTS} SELECT line_no, value FROM event_lines WHERE {_field('level', 'PURCHASE')}")
def _roundtrip(spark, d):
    return filter_lines(event_lines(spark, d), parse(filter_term("level", "PURCHASE"))).select("line_no", "value")


_PRETTY = """'{' || chr(10) || '  "@timestamp": "' || json_extract_string(value, '$."@timestamp"') || '",' || chr(10) || '  "level": "' || json_extract_string(value, '$.level') || '",' || chr(10)
 || '  "props": {' || chr(10) || '    "k": ' || CAST(json_extract(value, '$.props.k') AS VARCHAR) || chr(10) || '  },' || chr(10) || '  "user": ' || json_extract_string(value, '$.user') || chr(10) || '}'"""


@query("detail_pretty", f"WITH {_EVENTS} SELECT line_no, {_PRETTY} AS detail FROM event_lines")
def _detail(spark, d):
    return event_lines(spark, d).select("line_no", jsontext.pretty_text("value").alias("detail"))


# Exact field texts: key order, repeated keys, floats, large numbers.


def odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines written oddly: a repeated key, nested keys out of order, a float with an exponent, an integer beyond 64 bits, an escaped letter."""
    line = F.concat(
        F.lit('{"level":"FIRST","o":{"b":'), F.col("user_id").cast("string"), F.lit(', "a":["'), "event_type", F.lit('", null]},"f":'), F.col("user_id").cast("string"),
        F.lit('E+1,"n":-0,"big":1234567890123456789012,"esc":"\\u0065rror","level":"'), F.upper("event_type"), F.lit('"}'),
    )
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), line.alias("value"))


def _odd(name: str, text: str, sql: str) -> None:
    @query(name, f"SELECT event_id AS line_no FROM events WHERE {sql}")
    def run(spark, d):
        return filter_lines(odd_lines(spark, d), parse(text)).select("line_no")


_odd("field_last_key", "level=ERROR", "upper(event_type) = 'ERROR'")
_odd("field_first_key_is_gone", "level=FIRST", "false")
_odd("field_sorted_keys", "o='{\"a\":[\"view\",null],\"b\":42}'", "event_type = 'view' AND user_id = 42")
_odd("field_float", "f=420.0 or f=4.2e2", "user_id = 42")
_odd("field_big_number", "big=1.2345678901234568e21 n=-0.0", "true")
_odd("field_escaped", "esc=error level=VIEW", "event_type = 'view'")


@query("field_texts", """SELECT event_id AS line_no, upper(event_type) AS c0, '{"a":["' || event_type || '",null],"b":' || CAST(user_id AS VARCHAR) || '}' AS c1,
 CAST(user_id * 10 AS VARCHAR) || '.0' AS c2, '-0.0' AS c3, '1.2345678901234568e21' AS c4, 'error' AS c5 FROM events""")
def _field_texts(spark, d):
    return fl.project(classify(odd_lines(spark, d)), ["level", "o", "f", "n", "big", "esc"])


# Files: the tables written as logs, read, merged and sorted as files.


def _files(spark: SparkSession, lines: DataFrame, order: tuple[str, ...]) -> list[str]:
    """One log for each of the three ``input_index``, its lines in this order, in a folder of the shared one."""
    folder = fresh_folder(spark, "logs")
    for i in range(3):
        write_lines(lines.where(F.col("input_index") == i).orderBy(*order).select("value"), f"{folder}/in{i}.log")
    return [f"{folder}/in{i}.log" for i in range(3)]


@query("file_lines", f"WITH {_MIXED} SELECT input_index, CAST(row_number() OVER (PARTITION BY input_index ORDER BY id, kind, pos) AS BIGINT) AS line_no, value FROM mixed")
def _file_lines(spark, d):
    return read_log(spark, *_files(spark, mixed_log(spark, d), ORDER)).select("input_index", "line_no", "value")


@query("file_lines_crlf", f"WITH {_EVENTS} SELECT CAST(row_number() OVER (ORDER BY line_no) AS BIGINT) AS line_no, value FROM event_lines")
def _file_crlf(spark, d):
    path = f"{fresh_folder(spark, 'logs')}/_hidden.gz"  # a name that Spark's own readers skip or decompress
    write_lines(event_lines(spark, d).orderBy("line_no").select(F.concat("value", F.lit("\r"))), path)
    return read_log(spark, path).select("line_no", "value")


_STAMPED = f"""CASE WHEN kind = 0 THEN {_CANON} || ',"system":"in' || CAST(input_index AS VARCHAR) || '.log"' || {_USER} ELSE value END"""


@query("merge_files", f"WITH {_NEIGHBOURS} SELECT {_MERGE_POS} AS line_no, {_STAMPED} AS value FROM n")
def _merge_files(spark, d):
    inputs = _files(spark, mixed_log(spark, d), ORDER)
    out = f"{fresh_folder(spark, 'logs')}/merged.log"
    od.merge_files(spark, inputs, out)
    return read_log(spark, out).select("line_no", "value")


@query("sort_files", f"WITH {_NEIGHBOURS} SELECT {_SORT_POS} AS line_no, CASE WHEN kind = 0 THEN {_CANON} || {_USER} ELSE value END AS value FROM n")
def _sort_files(spark, d):
    inputs = _files(spark, mixed_log(spark, d), ORDER)
    out = f"{fresh_folder(spark, 'logs')}/sorted.log"
    od.sort_files(spark, inputs, out)
    return read_log(spark, out).select("line_no", "value")


def _failure(spark: SparkSession, run: Callable, inputs: list[str]) -> DataFrame:
    """The error of a run, its file by name, and whether an output is there."""
    out = f"{fresh_folder(spark, 'logs')}/none.log"
    try:
        run(spark, inputs, out)
        rows = []
    except od.LogOrderError as e:
        rows = [(od.origin(e.file), e.line, e.reason)]
    return spark.createDataFrame(rows, "file string, line_no bigint, reason string")


def _shuffled(spark, d):
    lines = event_lines(spark, d)
    return lines.withColumns({"input_index": (F.col("line_no") % 3).cast("int"), "slot": (F.col("line_no") * 7919) % 10007})


_SHUFFLED = f"""{_EVENTS}, s AS (SELECT *, CAST(line_no % 3 AS INTEGER) AS input_index, (line_no * 7919) % 10007 AS slot, json_extract_string(value, '$."@timestamp"') AS ts FROM event_lines),
 l AS (SELECT *, lag(ts) OVER (PARTITION BY input_index ORDER BY slot, line_no) AS prev_ts, row_number() OVER (PARTITION BY input_index ORDER BY slot, line_no) AS line FROM s)"""


@query(
    "merge_first_violation",
    f"""WITH {_SHUFFLED}, v AS (SELECT input_index, line, prev_ts, row_number() OVER (PARTITION BY input_index ORDER BY line) AS k FROM l WHERE ts < prev_ts)
 SELECT 'in' || CAST(input_index AS VARCHAR) || '.log' AS file, CAST(line AS BIGINT) AS line_no, '@timestamp is earlier than the previous entry''s' AS reason
 FROM v WHERE k = 1 ORDER BY prev_ts, input_index LIMIT 1""",
)
def _merge_first(spark, d):
    return _failure(spark, od.merge_files, _files(spark, _shuffled(spark, d), ("slot", "line_no")))


@query(
    "sort_first_violation",
    f"""WITH {_SHUFFLED} SELECT 'in' || CAST(input_index AS VARCHAR) || '.log' AS file, CAST(line AS BIGINT) AS line_no, 'entry without a string @timestamp' AS reason
 FROM l WHERE line_no % 41 = 7 AND input_index > 0 ORDER BY input_index, line LIMIT 1""",
)
def _sort_first(spark, d):
    broken = (F.col("line_no") % 41 == 7) & (F.col("input_index") > 0)
    lines = _shuffled(spark, d).withColumn("value", F.when(broken, F.replace("value", F.lit('"@timestamp":"'), F.lit('"at":"'))).otherwise(F.col("value")))
    return _failure(spark, od.sort_files, _files(spark, lines, ("slot", "line_no")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, severity and projection over the event log."""
    lines = filter_lines(event_lines(spark, sf_dir), parse(FLAGSHIP))
    return fl.project(lines.withColumn("severity", fl.severity(lines)), ["@timestamp", "level", "user", "props"], keep=("line_no", "severity"))
