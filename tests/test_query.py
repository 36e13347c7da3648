import itertools

import pytest

from logweave.functions.query import And, Field, Or, QuerySyntaxError, Substring, compile_predicate, filter_lines, filter_term, needs_line_text, parse, possible
from logweave.sources.lines import classify

S = Substring


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("", None),
        ("   ", None),
        ("Foo", S("foo")),
        ("a b", And((S("a"), S("b")))),
        ("a OR b c", Or((S("a"), And((S("b"), S("c")))))),
        ("(a or b) c", And((Or((S("a"), S("b"))), S("c")))),
        ("((a))", S("a")),
        ("'a or (b)'", S("a or (b)")),
        ("'or'", S("or")),
        ("order and not", And((S("order"), S("and"), S("not")))),
        ("''", S("")),
        ('foo"bar', S('foo"bar')),
        ("level=ERROR", Field("level", "ERROR")),
        ("f=or", Field("f", "or")),
        ("f=''", Field("f", "")),
        ("a=b=c", Field("a", "b=c")),
        ("a='x'y", And((Field("a", "x"), S("y")))),
        ('body={"page":7}', Field("body", '{"page":7}')),
        ("@timestamp=1 a.b=2", And((Field("@timestamp", "1"), Field("a.b", "2")))),
        ("(f=v)", Field("f", "v")),
        ("a b", And((S("a"), S("b")))),
    ],
)
def test_trees(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("or", "expected a term"), ("a or", "expected a term"), ("a or or b", "expected a term"), ("(or a)", "expected a term"), ("(a or )", "expected a term"),
        ("()", "empty group"), ("(a", "missing closing"), ("a)", "unbalanced"), ("'a", "unterminated quote"), ("f='a", "unterminated quote"),
        ("f=", "missing value"), ("f= x", "missing value"), ("=", "missing value"), ("1a=", "missing value"), ("=v", "missing field name"), ("1a=x", "invalid field name"),
    ],
)
def test_errors(text, message):
    with pytest.raises(QuerySyntaxError, match=message):
        parse(text)


LINES = [
    '{"level":"INFO","n":null,"d":2758,"f":1.0}',
    "raw text about a timeout",
    '{"level":"ERROR","message":"Timeout hit"}',
    '{"level":"ERROR","a.b":"x","e":""}',
    "PANIC: timeout level=ERROR",
    '{"level":"ERROR"} trailing',
    '{"n":"null","b":true,"o":{"k":[1,2]}}',
]


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("level=ERROR timeout", [2]), ("timeout", [1, 2, 4]), ("n=null", [0, 6]), ("d=2758", [0]), ("f=1.0", [0]), ("f=1", []), ("a.b=x", [3]), ("e=''", [3]),
        ("level=error", []), ("b=true", [6]), ('o={"k":[1,2]}', [6]), ("''", list(range(7))), ("level=INFO or panic", [0, 4]), ("(level=INFO or panic) raw", []), ("missing=null", []),
    ],
)
def test_matching(spark, text, rows):
    df = spark.createDataFrame([*enumerate(LINES), (99, None)], "i int, value string")
    assert sorted(r.i for r in classify(df).where(compile_predicate(parse(text))).collect()) == rows
    assert sorted(r.i for r in filter_lines(df, parse(text)).collect()) == rows


def test_long_or_compiles(spark):
    tree = parse(" or ".join(f"w{i}" for i in range(600)))
    assert spark.createDataFrame([("w599",), ("x",)], "value string").where(compile_predicate(tree)).count() == 1


def test_filter_terms():
    assert filter_term("a", "v w") == "a='v w'" and filter_term("a", "it's") == 'a="it\'s"'
    assert filter_term("a", "'\"") is None and filter_term("a", "x\ny") is None and filter_term("1a", "x") is None
    for value in ("", "or", "(x)", "a=b", "it's"):
        assert parse(filter_term("f", value)) == Field("f", value)


def test_needs_text():
    assert needs_line_text(parse("a=b (c or d=e)")) and not needs_line_text(parse("a=b or c=d")) and not needs_line_text(None)


EXACT = [
    '{"level":"ERROR","props":{"b":1,"a":2}}',
    '{"level":"A","level":"B"}',
    '{"n":12345678901234567890123,"i":18446744073709551615,"j":-9223372036854775808,"k":18446744073709551616}',
    '{"f":1.50,"g":1E2,"h":-0,"e":1e-7}',
    '{"s":"tab\\tq\\"uote","u":"\\u00e9","\\u0061":1}',
    '{"l":[1.0, {"z":null,"y":"\\n"}],"t":true}',
]


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("props='{\"a\":2,\"b\":1}'", [0]), ("props='{\"b\":1,\"a\":2}'", []), ("level=A", []), ("level=B", [1]), ("n=1.2345678901234568e22", [2]), ("n=12345678901234567890123", []),
        ("i=18446744073709551615 j=-9223372036854775808", [2]), ("k=1.8446744073709552e19", [2]), ("f=1.5 g=100.0 h=-0.0", [3]), ("e=1e-7", [3]), ("f=1.50", []),
        ("u=é", [4]), ("a=1", [4]), ("s='tab\tq\"uote'", [4]), ("l='[1.0,{\"y\":\"\\n\",\"z\":null}]'", [5]), ("t=true", [5]),
    ],
)
def test_exact_field_texts(spark, text, rows):
    df = spark.createDataFrame([*enumerate(EXACT)], "i int, value string")
    assert sorted(r.i for r in classify(df).where(compile_predicate(parse(text))).collect()) == rows
    assert sorted(r.i for r in filter_lines(df, parse(text)).collect()) == rows


def test_filters_before_parsing_lose_nothing(spark):
    """Every term that a cell can make, alone and combined, with and without the filter on bytes."""
    lines = [*EXACT, *LINES, '{"esc\\u0061pe":"x y","o":{}}', '{"a":"{","b":"1e5","c":1e5}']
    df = spark.createDataFrame([*enumerate(lines)], "i int, value string")
    whole = classify(df).persist()
    terms = sorted({t for r in whole.collect() for k, v in (r.entry or {}).items() if (t := filter_term(k, v)) is not None})
    texts = terms + [f"{a} or {b}" for a, b in itertools.pairwise(terms)] + [f"({a} or timeout) {b}" for a, b in itertools.pairwise(terms)]
    assert len(terms) > 25
    nodes = [parse(text) for text in texts]
    lost = [(compile_predicate(n) & ~possible(n)).alias(f"p{k}") for k, n in enumerate(nodes)]
    met = [compile_predicate(n).alias(f"m{k}") for k, n in enumerate(nodes)]
    rows = whole.select(*lost, *met).collect()
    assert not [texts[k] for k in range(len(nodes)) if any(r[f"p{k}"] for r in rows)]
    assert all(any(r[f"m{k}"] for r in rows) for k in range(len(terms)))


def test_a_line_is_parsed_once(spark):
    df = spark.createDataFrame([*enumerate(LINES)], "i int, value string")
    plan = filter_lines(df, parse("level=INFO or level=ERROR or (d=2758 n=null)"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("from_json") == 0
