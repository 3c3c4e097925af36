"""Batches are added once, whole or not at all, whatever fails in between."""

import pytest
from pyspark.sql import functions as F

from fluvial import sinks
from fluvial.operators.notes import note_store, write_notes


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def of(store, name="t"):
    return sorted((r.batch_id, r.v) for r in store.read(name).collect())


@pytest.fixture
def store(spark, tmp_path):
    return sinks.BatchStore(spark, f"file://{tmp_path}/store", {"t": "v int", "u": "v int"})


def test_commit_retry_replace(spark, store):
    assert of(store) == [] and store.committed() == set()
    assert store.commit("a", {"t": rows(spark, 1, 1), "u": rows(spark, 9)})
    assert not store.commit("a", {"t": rows(spark, 5)})
    assert store.commit("b", {"t": rows(spark, 2)})
    assert of(store) == [("a", 1), ("a", 1), ("b", 2)] and of(store, "u") == [("a", 9)]
    assert store.commit("a", {"t": rows(spark, 7)}, replace=True)
    assert of(store) == [("a", 7), ("b", 2)] and of(store, "u") == []
    assert store.commit("b", {"t": rows(spark)}, replace=True)
    assert of(store) == [("a", 7)] and store.committed() == {"a", "b"}
    with pytest.raises(ValueError):
        store.commit("", {"t": rows(spark, 1)})


def test_crash_between_stage_and_publish(spark, store, monkeypatch):
    store.commit("a", {"t": rows(spark, 1), "u": rows(spark, 1)})
    publish = sinks.BatchStore._publish

    def crash(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(sinks.BatchStore, "_publish", crash)
    with pytest.raises(RuntimeError):
        store.commit("b", {"t": rows(spark, 2), "u": rows(spark, 2)})
    monkeypatch.setattr(sinks.BatchStore, "_publish", publish)
    again = sinks.BatchStore(spark, store.path, {"t": "v int", "u": "v int"})  # a new job
    assert of(again) == of(again, "u") == [("a", 1)]
    assert again.commit("b", {"t": rows(spark, 2), "u": rows(spark, 2)})
    assert of(again) == of(again, "u") == [("a", 1), ("b", 2)]
    assert again.vacuum() > 0 and of(again) == [("a", 1), ("b", 2)]


def test_two_writers(spark, store, monkeypatch):
    """The manifest that another writer gives first is taken into account."""
    latest, raced = sinks.BatchStore._latest, []

    def race(self):
        found = latest(self)
        if not raced and self is store:
            raced.append(1)
            sinks.BatchStore(spark, store.path, {"t": "v int", "u": "v int"}).commit("other", {"t": rows(spark, 3)})
        return found

    staged = store.stage("a", {"t": rows(spark, 1)})
    monkeypatch.setattr(sinks.BatchStore, "_latest", race)
    assert store._change(lambda entries: [*entries, {"folder": staged, "batches": ["a"], "gone": [], "tables": ["t"]}])
    monkeypatch.setattr(sinks.BatchStore, "_latest", latest)
    assert of(store) == [("a", 1), ("other", 3)]


def test_compact(spark, store, monkeypatch):
    for i in range(5):
        store.commit(f"b{i}", {"t": rows(spark, i)})
    store.commit("b1", {"t": rows(spark, 11)}, replace=True)
    want = of(store)
    assert store.compact() and of(store) == want and len(store._latest()[1]) == 1
    assert not store.compact()
    assert not store.commit("b3", {"t": rows(spark, 0)})  # merged batches are still known
    assert store.commit("b3", {"t": rows(spark, 33)}, replace=True) and store.commit("b9", {"t": rows(spark, 9)})
    assert of(store) == sorted([x for x in want if x[0] != "b3"] + [("b3", 33), ("b9", 9)])
    # a batch that comes, and one that is replaced, while files are merged
    whole, done = sinks.BatchStore._change, []

    def late(self, change):
        if not done:
            done.append(1)
            self.commit("late", {"t": rows(spark, 5)})
            self.commit("b0", {"t": rows(spark, 100)}, replace=True)
        return whole(self, change)

    monkeypatch.setattr(sinks.BatchStore, "_change", late)
    before = of(store)
    assert store.compact()
    assert of(store) == sorted([x for x in before if x[0] != "b0"] + [("b0", 100), ("late", 5)])
    monkeypatch.setattr(sinks.BatchStore, "_change", whole)
    assert store.compact() and store.vacuum() > 0
    assert of(store) == sorted([x for x in before if x[0] != "b0"] + [("b0", 100), ("late", 5)])


def test_notes_of_a_batch_come_with_outcomes_and_audit(spark, tmp_path, monkeypatch):
    store = note_store(spark, f"file://{tmp_path}/notes")
    cards = [(1, 1, "What  is x?", "A"), (2, 1, "What is x?", "B"), (3, 2, "What is x?", "C"), (4, 1, " ", "D"), (5, None, "What is x?", "<b>"), (6, None, "What is x? ", "F"), (7, 1, None, None)]
    cards = spark.createDataFrame(cards, "card_id long, section long, front string, back string")
    whole = sinks.BatchStore._publish
    monkeypatch.setattr(sinks.BatchStore, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        write_notes(store, "one", cards)
    monkeypatch.setattr(sinks.BatchStore, "_publish", whole)
    assert all(store.read(t).isEmpty() for t in ("notes", "outcomes", "audit"))
    assert write_notes(store, "one", cards) and not write_notes(store, "one", cards)
    got = {r.card_id: (r.state, r.error, r.note_id) for r in store.read("outcomes").collect()}
    assert got == {1: ("created", None, 1), 2: ("failed", "duplicate_note", None), 3: ("created", None, 3), 4: ("failed", "empty_field", None), 5: ("created", None, 5), 6: ("failed", "duplicate_note", None), 7: ("failed", "empty_field", None)}
    assert {(r.note_id, r.back) for r in store.read("notes").collect()} == {(1, "A"), (3, "C"), (5, "&lt;b&gt;")}
    assert write_notes(store, "two", cards.filter(F.col("card_id") < 4)) and write_notes(store, "none", cards.limit(0))
    audit = {r.batch_id: (r.requested, r.created, r.failed, r.first_note, r.last_note, r.state) for r in store.read("audit").collect()}
    assert audit == {"one": (7, 3, 4, 1, 5, "partial"), "two": (3, 0, 3, None, None, "failed"), "none": (0, 0, 0, None, None, "success")}
