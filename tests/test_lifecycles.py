"""Retries, bounds, nested JSON, places and modes of cards, and runs that are long."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fluvial import limits, staging
from fluvial.operators import drafts, planning, runs
from fluvial.sources import paths


def test_stages_of_a_long_run(spark):
    """One run has nearly all events; each range of them is one map."""
    rng = random.Random(2)
    names = [*runs.NEXT, "completed", "other", None]
    log = [(1, i * 3, "standard", rng.choice(names)) for i in range(5000)] + [(2, i, "fast", rng.choice(names)) for i in range(40)] + [(None, 0, "deep", "planning"), (3, 0, "deep", "failed"), (3, 1, "deep", "planning")]
    want = {}
    for run, _, level, stage in sorted(log, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        now, yes, no = want.get(run, ("analyzing", 0, 0))
        legal = stage in (*runs.NEXT.get(now, ()), *(runs.ENDS if now in runs.NEXT else ())) and not (level == "fast" and stage == "repairing")
        want[run] = (stage if legal else now, yes + legal, no + (not legal))
    rows = spark.createDataFrame(log, "run_id int, ord long, level string, stage string").repartition(3)
    assert {r.run_id: (r.stage, r.accepted, r.refused) for r in runs.stages(rows).collect()} == want


def test_retry_in_order_of_chunks(spark):
    chunks = [(1, 5, "failed", False, 3, None), (1, 2, "failed", False, 4, None), (1, 9, "failed", None, 5, None), (1, 11, "failed", False, 1, None), (1, 3, "succeeded", False, 9, None), (1, 4, "failed", False, 7, "bad"), (2, 1, "failed", True, 1, None), (3, 1, "pending", False, 1, None), (4, 1, "failed", False, 1, None), (4, 2, "failed", False, 1, None), (None, 1, "failed", False, None, None)]
    rows = spark.createDataFrame(chunks, "run_id int, ord long, state string, scheduled boolean, cards int, error string")
    allowed = spark.createDataFrame([(1, 10, 1, 9), (2, 10, 0, 9), (3, 10, 0, 9), (4, 10, 0, 1), (5, 10, 0, 1), (None, 2, 0, 5)], "run_id int, card_limit int, cards int, calls_left int")
    attempts, done = runs.retry_failed(rows, allowed)
    assert {(r.run_id, r.ord): (r.state, r.error, r.called, r.accepted) for r in attempts.collect()} == {
        (1, 2): ("succeeded", None, True, 4), (1, 4): ("failed", "bad", True, 0), (1, 5): ("succeeded", None, True, 3), (1, 9): ("succeeded", None, True, 2), (1, 11): ("failed", "card_limit_reached", False, 0), (None, 1): ("succeeded", None, True, 0),
    }
    assert {r.run_id: (r.error, r.calls, r.accepted) for r in done.collect()} == {1: (None, 4, 9), 2: ("retry_already_scheduled", 0, 0), 3: ("no_failed_chunks", 0, 0), 4: ("retry_call_budget_insufficient", 0, 0), 5: ("no_failed_chunks", 0, 0), None: (None, 1, 0)}


@pytest.mark.parametrize("n,most", [(0, 0), (100, 100), (100, 1000), (100, 99), (5000, 10)])
def test_bounded(spark, n, most):
    rows = spark.range(n).repartition(3)
    if n > most:
        with pytest.raises(limits.TooManyRows):
            limits.materialize_bounded(rows, "bounded", most)
    else:
        assert limits.materialize_bounded(rows, "bounded", most).count() == n


def test_json_lines(spark):
    deep = "[" * 64 + "1" + "]" * 64
    lines = ['{"a": {"b.c": [1, 1.50, "x = y", null, true, []]}, "e = f": "g"}', " ", "3", "{", '{"a": NaN}', deep, deep[1:-1], "[" * 100_000]
    rows = spark.createDataFrame([(1, "\r\n".join(lines)), (2, None), (None, '"s"\n')], "doc_id long, text string")
    got = sorted((tuple(r) for r in paths.json_lines(rows, "doc_id", "text").collect()), key=repr)
    want = [(1, 1, 1, i, f"{p} = {v}", s, None) for i, (p, v, s) in enumerate([("$.a.b\\.c[0]", 1, "$.a.b\\"), ("$.a.b\\.c[1]", 1.5, "$.a.b\\"), ("$.a.b\\.c[2]", "x = y", "$.a.b\\"), ("$.a.b\\.c[3]", "null", "$.a.b\\"), ("$.a.b\\.c[4]", "true", "$.a.b\\"), ("$.e = f", "g", "$")])]
    want += [(1, 2, 3, 0, "$ = 3", "$", None), (1, 3, 4, 0, None, None, "invalid_json"), (1, 4, 5, 0, None, None, "invalid_json"), (1, 5, 6, 0, None, None, "document_too_complex"), (1, 6, 7, 0, "$" + "[0]" * 63 + " = 1", "$" + "[0]" * 63, None), (1, 7, 8, 0, None, None, "invalid_json"), (None, 1, 1, 0, "$ = s", "$", None)]
    assert got == sorted(want, key=repr)
    assert json.loads(lines[0])["a"]["b.c"][1] == 1.5


def test_modes_places_and_drafts(spark):
    cards = spark.createDataFrame([(i, p, f, "b", "e") for i, (p, f) in enumerate([(1, "f"), (2, "f"), (3, " "), (None, "f"), (1, None), (9, "f")])], "ord long, point_id int, front string, back string, source_excerpt string")
    points = spark.createDataFrame([(1, "exam_answer"), (2, "poem"), (3, None)], "point_id int, recommended_template string")
    got = drafts.effective_modes(cards, points, F.when(F.col("ord") == 5, "definition").otherwise("auto")).collect()
    assert {r.ord: r["mode"] for r in got} == {0: "exam_answer", 1: "concept", 2: "concept", 3: "concept", 4: "exam_answer", 5: "definition"}
    places = spark.createDataFrame([(1, "p1"), (2, None)], "point_id int, location string")
    assert {r.draft: (r.ord, r.location) for r in drafts.located_drafts(cards, places).collect()} == {"universal-1": (0, "p1"), "universal-2": (1, None), "universal-4": (3, None), "universal-6": (5, None)}
    chunks = spark.createDataFrame([("a", 1, "one"), ("b", 1, "one"), ("c", 2, "two")], "chunk_id string, document_id int, source_label string")
    asked = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["a", "c"]), (4, ["c", "z"]), (5, ["z"]), (6, []), (7, None)], "point_id int, chunk_ids array<string>")
    assert {r.point_id: tuple(r)[1:] for r in drafts.point_spans(asked, chunks, "all").collect()} == {
        1: (1, "1", "one", "a"), 2: (2, "1", "one", None), 3: (2, "all", "Imported material", None), 4: (1, "2", "two", "c"), **{k: (0, "all", "Imported material", None) for k in (5, 6, 7)},
    }


def test_evidence_of_many_chunks(spark):
    """A point that names thousands of chunks takes the first ones alone."""
    chunks = spark.createDataFrame([(f"c{i}", "x" * (i % 7) if i % 11 else None) for i in range(3000)] + [("long", "y" * 5000)], "chunk_id string, text string")
    points = spark.createDataFrame([(1, [f"c{i}" for i in range(3000)] + ["none"]), (2, ["c3", "long", "c5"]), (3, []), (4, None), (None, ["c1", None])], "point_id int, chunk_ids array<string>")
    got = {r.point_id: (r.chunks, r.missing, r.text) for r in planning.evidence(points, chunks, 50).collect()}
    texts = ["x" * (i % 7) for i in range(3000) if i % 11]
    assert got == {1: (len(texts), 3001 - len(texts), "\n".join(texts)[:50]), 2: (3, 0, "xxx\n" + "y" * 46), 3: (0, 0, ""), 4: (0, 0, ""), None: (1, 0, "x")}


def test_tables_need_a_shared_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        staging.shared_dir(Session)
