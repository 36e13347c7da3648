import threading
import time

import pytest
from pyspark.sql import functions as F

from logweave.plans.session import Session, Workspace
from logweave.streaming.tail import tail


def test_session(spark, tmp_path):
    log, state = tmp_path / "a.log", str(tmp_path / "state.json")
    log.write_text('{"level":"ERROR","m":"it\'s"}\nraw timeout\n{"level":"INFO","m":1}\n')
    s = Session(spark, state)
    tab = s.open(str(log))
    assert s.open(str(log)) is tab and tab.columns == ["level"] and tab.label == "a.log"
    assert tab.apply("level=ERROR or timeout").count() == 2 and tab.counts() == (2, 3)
    assert [tuple(r)[1:] for r in tab.page(0, 5)] == [("ERROR",), ("raw timeout",)]
    assert tab.apply("(").count() == 3 and tab.error
    tab.toggle_selection(3)
    assert tab.detail() == '{\n  "level": "INFO",\n  "m": 1\n}'
    assert tab.filter_by_cell(1, "m") and tab.query == 'm="it\'s"' and tab.counts() == (1, 3)
    assert not tab.filter_by_cell(2, "m") and not tab.filter_by_cell(1, "none") and tab.selected_line == 3
    tab.toggle_selection(3)
    assert tab.selected_line is None and tab.detail() is None
    s.set_column_visible(tab, "m", True)
    s.set_column_visible(tab, "level", False)
    s.toggle_favorite(str(log))
    tab.edit("timeout")
    assert not tab.poll()
    log.write_text("timeout\ntimeout\nx\n")
    tab.reload()
    assert tab.counts() == (2, 3) and tab.fields == []
    s.close(0)
    assert s.tabs == [] and s.active is None
    again = Session(spark, state)
    assert again.open(str(log)).columns == ["m"] and again.workspace.is_favorite(str(log))


def test_workspace(tmp_path):
    path = tmp_path / "w.json"
    for text in ("{", "[]", '{"favorites":3}', '{"filter_modifier":"x"}'):
        path.write_text(text)
        assert Workspace.load(str(path)) == Workspace()
    assert Workspace(favorites=["b", "C", "a"]).sorted_favorites() == ["a", "b", "C"]


def test_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('{"level":"ERROR"}\nother\n')
    q = tail(spark, str(tmp_path / "in"), "level=ERROR").writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.value for r in spark.table("tailed").collect()] == ['{"level":"ERROR"}']


def test_cancel_ends_a_running_scan_and_no_other(spark, tmp_path):
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text("x\n" * 50)
    session = Session(spark)
    slow, other = session.open(str(tmp_path / "a.log")), session.open(str(tmp_path / "b.log"))

    @F.udf("boolean")
    def sleeps(text):
        time.sleep(1)
        return True

    @F.udf("boolean")
    def naps(text):
        time.sleep(0.05)
        return True

    slow._predicate, other._predicate = sleeps("value"), naps("value")
    ends = {}

    def count(tab):
        began = time.monotonic()
        try:
            ends[tab.path] = tab.counts()
        except Exception as e:
            ends[tab.path] = type(e).__name__, time.monotonic() - began

    threads = [threading.Thread(target=count, args=(t,)) for t in (slow, other)]
    for t in threads:
        t.start()
    while not slow._tags:
        time.sleep(0.01)
    time.sleep(0.2)
    slow.apply("y")  # a new query ends the scan of the one before, whether its job runs already or is still being planned
    for t in threads:
        t.join(60)
    assert ends[other.path] == (50, 50) and ends[slow.path][0] != 50 and ends[slow.path][1] < 19
    assert slow.counts() == (0, 50)  # later jobs of the tab run
    session.close(0)
    assert other.counts() == (50, 50)


def test_opening_what_is_not_there_changes_nothing(spark, tmp_path):
    session = Session(spark)
    for path in (str(tmp_path / "none.log"), str(tmp_path)):
        with pytest.raises(OSError):
            session.open(path)
    assert session.tabs == [] and session.active is None
