"""Explorer state without a screen: tabs over logs, saved columns, favourites, filters."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import jsontext
from logweave.functions.query import QuerySyntaxError, compile_predicate, filter_term, parse
from logweave.operators import fields as fl
from logweave.sources.files import file_size
from logweave.sources.lines import classify, read_log

MODIFIERS = ("ctrl", "alt", "shift", "command")
DEBOUNCE_S, CANCEL_S = 0.25, 0.2


def new_session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def path_key(path: str) -> str:
    return os.path.realpath(path) if os.path.exists(path) else path


@dataclass
class Workspace:
    """Favourites, columns by file and the click modifier; an unreadable file gives the defaults."""

    favorites: list[str] = field(default_factory=list)
    columns: dict[str, list[str]] = field(default_factory=dict)
    filter_modifier: str = "ctrl"

    @classmethod
    def load(cls, path: str) -> Workspace:
        try:
            with open(path, encoding="utf-8") as f:
                data = json.load(f)
            found = cls(**{k: data[k] for k in ("favorites", "columns", "filter_modifier") if k in data})
            ok = all(isinstance(x, str) for x in [*found.favorites, *(c for v in found.columns.values() for c in v)])
            return found if ok and isinstance(found.favorites, list) and found.filter_modifier in MODIFIERS else cls()
        except (OSError, ValueError, TypeError, AttributeError):
            return cls()

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2, ensure_ascii=False)
        os.replace(temp, path)

    def is_favorite(self, path: str) -> bool:
        return path_key(path) in self.favorites

    def toggle_favorite(self, path: str) -> None:
        self.favorites.remove(path_key(path)) if self.is_favorite(path) else self.favorites.append(path_key(path))

    def remove_favorite(self, path: str) -> None:
        self.favorites = [p for p in self.favorites if p != path_key(path)]

    def sorted_favorites(self) -> list[str]:
        return sorted(self.favorites, key=str.lower)


class Tab:
    """One open log: its lines, applied query, visible columns and selected line."""

    def __init__(self, spark: SparkSession, path: str, saved: list[str] | None):
        self.spark, self.path, self.tag = spark, path, f"tab-{uuid.uuid4()}"
        self.query = self.applied = ""
        self.error: str | None = None
        self.field_filter = ""
        self.selected_line: int | None = None
        self._predicate = compile_predicate(None)
        self._edited = 0.0
        self._lock, self._tags = threading.Lock(), set()
        self._load()
        self.columns = fl.choose_columns(self.fields, saved)

    def _load(self) -> None:
        try:
            file_size(self.spark, self.path)
        except OSError as e:
            raise FileNotFoundError(self.path) from e
        self.lines = classify(read_log(self.spark, self.path)).persist()
        with self.running():
            self.fields = [r[0] for r in fl.discover_fields(self.lines).collect()]  # field names, not rows

    @contextlib.contextmanager
    def running(self) -> Iterator[None]:
        """Jobs that this thread starts inside belong to the tab, and ``cancel`` ends them."""
        own = f"{self.tag}-{uuid.uuid4()}"
        with self._lock:
            self._tags.add(own)
        self.spark.sparkContext.addJobTag(own)
        try:
            yield
        finally:
            self.spark.sparkContext.removeJobTag(own)
            with self._lock:
                self._tags.discard(own)

    @property
    def label(self) -> str:
        return os.path.basename(self.path) or self.path

    def edit(self, text: str) -> None:
        self.query, self._edited = text, time.monotonic()

    def poll(self, force: bool = False) -> bool:
        """Applies the edited text once it has rested, or at once when forced; True if the rows changed."""
        text = self.query.strip()
        if text == self.applied and not force or not force and time.monotonic() - self._edited < DEBOUNCE_S:
            return False
        self.cancel()  # a scan for the query before has nothing left to tell
        try:
            self._predicate, self.error = compile_predicate(parse(text)), None
        except QuerySyntaxError as e:  # an invalid query shows all rows
            self._predicate, self.error = compile_predicate(None), str(e)
        self.applied = text
        return True

    def apply(self, text: str) -> DataFrame:
        self.edit(text)
        self.poll(force=True)
        return self.rows

    def reset(self) -> None:
        self.apply("")

    @property
    def rows(self) -> DataFrame:
        return self.lines.where(self._predicate)

    def counts(self) -> tuple[int, int]:
        with self.running():
            row = fl.shown_total(self.lines, self._predicate).first()
        return row["shown"], row["total"]

    def page(self, offset: int, limit: int) -> list:
        with self.running():
            return fl.project(fl.page(self.rows, offset, limit), self.columns).orderBy("line_no").collect()

    def listed_fields(self) -> list[str]:
        return [f for f in self.fields if self.field_filter.strip().lower() in f.lower()]

    def toggle_selection(self, line_no: int) -> None:
        self.selected_line = None if self.selected_line == line_no else line_no

    def detail(self) -> str | None:
        """Pretty JSON of the selected entry, or the raw text; cut after a fixed number of characters."""
        with self.running():
            row = self.lines.where(F.col("line_no") == self.selected_line).select(F.make_valid_utf8("value")).first()
        if row is None:
            return None
        entry = jsontext.parse_object(row[0])
        text = row[0] if entry is None else jsontext.pretty(entry)
        return text if len(text) <= fl.DETAIL_CHARS else text[: fl.DETAIL_CHARS] + "..."

    def filter_by_cell(self, line_no: int, name: str) -> bool:
        """Replaces the query by the term of one cell; raw lines, missing fields and unsayable values do nothing."""
        with self.running():
            row = self.lines.where(F.col("line_no") == line_no).select("value").first()
        entry = jsontext.parse_object(row[0]) if row else None
        term = filter_term(name, jsontext.value_text(entry[name])) if entry and name in entry else None
        if term is None:
            return False
        self.apply(term)
        return True

    def reload(self) -> None:
        try:
            file_size(self.spark, self.path)
        except OSError as e:  # a file that is gone leaves the tab as it was
            raise FileNotFoundError(self.path) from e
        self.cancel()
        self.lines.unpersist()  # else the same plan would be answered from the old contents
        self._load()
        self.selected_line = None
        self.poll(force=True)

    def cancel(self) -> None:
        """Ends the tab's running jobs, whichever threads started them; later ones are not touched."""
        with self._lock:
            tags = [*self._tags]
        for tag in tags:
            self.spark.sparkContext.cancelJobsWithTag(tag)
        if tags:
            threading.Thread(target=self._until_ended, args=(tags,), daemon=True).start()

    def _until_ended(self, tags: list[str]) -> None:
        """A job that was still being planned begins after the first call; so the call is repeated until its block has ended."""
        while left := [t for t in tags if t in self._tags]:
            time.sleep(CANCEL_S)
            for tag in left:
                self.spark.sparkContext.cancelJobsWithTag(tag)

    def close(self) -> None:
        self.cancel()
        self.lines.unpersist()


class Session:
    def __init__(self, spark: SparkSession, workspace_path: str | None = None):
        self.spark, self.workspace_path = spark, workspace_path
        self.workspace = Workspace.load(workspace_path) if workspace_path else Workspace()
        self.tabs: list[Tab] = []
        self.active: int | None = None

    def _save(self) -> None:
        if self.workspace_path:
            self.workspace.save(self.workspace_path)

    def open(self, path: str) -> Tab:
        """Focuses the tab of a file that is open already; a failure leaves everything as it was."""
        for i, tab in enumerate(self.tabs):
            if path_key(tab.path) == path_key(path):
                self.active = i
                return tab
        tab = Tab(self.spark, path, self.workspace.columns.get(path_key(path)))
        self.tabs.append(tab)
        self.active = len(self.tabs) - 1
        return tab

    def close(self, index: int) -> None:
        self.tabs.pop(index).close()
        if self.active is not None and self.active >= index:
            self.active = max(self.active - 1, 0) if self.tabs else None

    def set_column_visible(self, tab: Tab, name: str, visible: bool) -> None:
        if visible and name not in tab.columns:
            tab.columns.append(name)
        elif not visible and name in tab.columns:
            tab.columns.remove(name)
        self.workspace.columns[path_key(tab.path)] = list(tab.columns)
        self._save()

    def toggle_favorite(self, path: str) -> None:
        self.workspace.toggle_favorite(path)
        self._save()
