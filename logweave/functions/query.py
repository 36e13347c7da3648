"""The boolean filter language: text -> syntax tree -> Spark predicate.

    level=ERROR (timeout or 'connection reset')

Terms next to each other are ANDed, the bare word ``or`` (any case) is OR and binds looser,
parentheses group. A plain or quoted term is a case-insensitive substring of the whole line; a
``name=value`` term is a case-sensitive equality on the text of a top-level field.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD_NAME = re.compile(r"[@A-Za-z_][@A-Za-z0-9_.]*")


class QuerySyntaxError(ValueError):
    """The filter text is not a query; ``str(error)`` says why."""


@dataclass(frozen=True)
class Substring:
    needle: str  # lower-cased


@dataclass(frozen=True)
class Field:
    name: str
    value: str


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


Node = Substring | Field | And | Or
_OPEN, _CLOSE, _OR = "(", ")", "or"


def is_valid_field_name(name: str) -> bool:
    return FIELD_NAME.fullmatch(name) is not None


def _quoted(text: str, at: int) -> tuple[str, int]:
    """Content of the quoted run opening at ``at`` and the position after it; there are no escapes."""
    end = text.find(text[at], at + 1)
    if end < 0:
        raise QuerySyntaxError("unterminated quote")
    return text[at + 1 : end], end + 1


def _bare_end(text: str, at: int, stops: str) -> int:
    while at < len(text) and not text[at].isspace() and text[at] not in stops:
        at += 1
    return at


def tokenize(text: str) -> list:
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif c in "()":
            out.append(c)
            at += 1
        elif c in "'\"":
            phrase, at = _quoted(text, at)
            out.append(Substring(phrase.lower()))
        else:
            end = _bare_end(text, at, "()=")
            word = text[at:end]
            if end < len(text) and text[end] == "=":
                term, at = _field(text, word, end + 1)
                out.append(term)
            else:
                out.append(_OR if word.lower() == "or" else Substring(word.lower()))
                at = end
    return out


def _field(text: str, name: str, at: int) -> tuple[Field, int]:
    if at < len(text) and text[at] in "'\"":
        value, at = _quoted(text, at)
    else:
        end = _bare_end(text, at, "()")
        if end == at:
            raise QuerySyntaxError(f"missing value after '{name}='")
        value, at = text[at:end], end
    if not name:
        raise QuerySyntaxError(f"missing field name before '={value}'")
    if not is_valid_field_name(name):
        raise QuerySyntaxError(f"invalid field name '{name}'")
    return Field(name, value), at


def parse(text: str) -> Node | None:
    """The syntax tree; None for a blank query, which matches every row."""
    tokens = tokenize(text)
    if not tokens:
        return None
    # One frame per open group: finished OR branches and the AND run being read.
    frames: list[tuple[list, list]] = [([], [])]

    def close_branch(frame: tuple[list, list]) -> None:
        branches, run = frame
        if not run:
            raise QuerySyntaxError("expected a term")
        branches.append(run[0] if len(run) == 1 else And(tuple(run)))
        run.clear()

    def close_group(frame: tuple[list, list]) -> Node:
        close_branch(frame)
        return frame[0][0] if len(frame[0]) == 1 else Or(tuple(frame[0]))

    for token in tokens:
        if token == _OPEN:
            frames.append(([], []))
        elif token == _CLOSE:
            if len(frames) == 1:
                raise QuerySyntaxError("unbalanced ')'")
            if frames[-1] == ([], []):
                raise QuerySyntaxError("empty group '()'")
            group = close_group(frames.pop())
            frames[-1][1].append(group)
        elif token == _OR:
            close_branch(frames[-1])
        else:
            frames[-1][1].append(token)
    if len(frames) > 1:
        raise QuerySyntaxError("missing closing ')'")
    return close_group(frames[0])


def needs_line_text(node: Node | None) -> bool:
    if isinstance(node, (And, Or)):
        return any(map(needs_line_text, node.children))
    return isinstance(node, Substring)


def field_text(entry: Column, name: str) -> Column:
    """Text of a field: NULL when absent, the text ``null`` for a JSON null."""
    return F.when(F.map_contains_key(entry, F.lit(name)), F.coalesce(F.element_at(entry, F.lit(name)), F.lit("null")))


def compile_predicate(node: Node | None, value: Column | None = None, entry: Column | None = None) -> Column:
    """A two-valued predicate over the line text and the entry map (NULL map: raw line)."""
    value = F.col("value") if value is None else value
    entry = F.col("entry") if entry is None else entry
    if node is None:
        return F.lit(True)
    if isinstance(node, Substring):
        return F.coalesce(F.contains(F.lower(F.make_valid_utf8(value)), F.lit(node.needle)), F.lit(False))
    if isinstance(node, Field):
        return F.coalesce(field_text(entry, node.name) == F.lit(node.value), F.lit(False))
    parts = [compile_predicate(c, value, entry) for c in node.children]
    return balanced(parts, (lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b))


def possible(node: Node | None, value: Column | None = None) -> Column:
    """True for every line that can match, at the cost of a byte search: a filter to put before the lines are parsed.

    A field's text stands in its line as it is, unless the line has an escape, or the text is the canonical form of something
    written otherwise: a float, an integer too large for one, an array or an object.
    """
    value = F.col("value") if value is None else value
    if isinstance(node, Substring):
        return compile_predicate(node, value)
    if isinstance(node, Field):
        verbatim = F.contains(value, F.lit(node.name))
        if not _REWRITTEN.match(node.value):
            verbatim &= F.contains(value, F.lit(node.value))
        return F.coalesce(F.contains(value, F.lit("{")) & (verbatim | F.contains(value, F.lit("\\"))), F.lit(False))
    if node is None:
        return F.lit(True)
    return balanced([possible(c, value) for c in node.children], (lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b))


#: Texts of floats, arrays and objects.
_REWRITTEN = re.compile(r"-?[0-9]*[.eE][0-9]|-?[0-9]+[eE.]|[\[{]")


def has_fields(node: Node | None) -> bool:
    if isinstance(node, (And, Or)):
        return any(map(has_fields, node.children))
    return isinstance(node, Field)


def filter_lines(df: DataFrame, node: Node | None) -> DataFrame:
    """The lines of ``df (value, ...)`` that match, ``entry`` added where fields decide; only lines that can match are parsed."""
    from logweave.sources.lines import classify

    if not has_fields(node):
        return df.where(compile_predicate(node, entry=F.lit(None)))
    return classify(df.where(possible(node))).where(compile_predicate(node))


def balanced(parts: list[Column], op) -> Column:
    """Reduces as a tree of logarithmic depth: long lists keep Catalyst's recursion shallow."""
    while len(parts) > 2:
        parts = [reduce(op, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return reduce(op, parts)


def filter_term(name: str, value: str) -> str | None:
    """The query text that selects rows whose field has this text; None where the grammar has no way to say it."""
    if not is_valid_field_name(name) or "\n" in value or "\r" in value:
        return None
    if "'" not in value:
        return f"{name}='{value}'"
    return None if '"' in value else f'{name}="{value}"'
