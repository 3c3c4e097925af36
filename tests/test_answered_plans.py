"""Planners' answers: each fault by itself, and the whole plan that stands in for a faulty answer."""

import json

from fluvial.operators import answered_plans
from fluvial.plans import answered


def point(**changes):
    sound = {"title": "Alpha beta", "point_type": "concept", "priority": "high", "source_chunk_ids": ["a"], "recommended_template": "concept", "rationale": "why"}
    return {k: v for k, v in (sound | changes).items() if v is not ...}


CASES = [
    (json.dumps({"points": [point(), point(title="Gamma", source_chunk_ids=["b", "a"])]}), None),
    (json.dumps({"points": [point(title="  ALPHA, beta!  ", priority=" low ")]}), None),
    (None, "not_json"), ("", "not_json"), ("{", "not_json"), ('{"points": [NaN]}', "not_json"), ('{"points": [], "points": []}', "not_json"), (json.dumps({"points": [point(rationale="x" * 256_000)]}), "not_json"),
    ("[]", "wrong_keys"), ("7", "wrong_keys"), ("null", "wrong_keys"), ("{}", "wrong_keys"), (json.dumps({"points": [point()], "more": 1}), "wrong_keys"), ('{"points": {"a": 1}}', "wrong_keys"), ('{"points": null}', "wrong_keys"),
    ('{"points": []}', "wrong_count"), (json.dumps({"points": [point()] * 97}), "wrong_count"),
    (json.dumps({"points": [point(title=...)]}), "wrong_fields"), (json.dumps({"points": [point(more=1)]}), "wrong_fields"), (json.dumps({"points": [point(), 3]}), "wrong_fields"), (json.dumps({"points": [point(title=1)]}), "wrong_fields"), (json.dumps({"points": [point(title=None)]}), "wrong_fields"),
    (json.dumps({"points": [point(source_chunk_ids="a")]}), "wrong_fields"), (json.dumps({"points": [point(source_chunk_ids=[])]}), "wrong_fields"), (json.dumps({"points": [point(source_chunk_ids=["a", 1])]}), "wrong_fields"),
    (json.dumps({"points": [point(title=" ")]}), "unbounded_text"), (json.dumps({"points": [point(rationale="x" * 241)]}), "unbounded_text"), (json.dumps({"points": [point(priority="x" * 13)]}), "unbounded_text"),
    (json.dumps({"points": [point(point_type="novel")]}), "unknown_value"), (json.dumps({"points": [point(priority="urgent")]}), "unknown_value"), (json.dumps({"points": [point(recommended_template="table")]}), "unknown_value"),
    (json.dumps({"points": [point(source_chunk_ids=["a", "a"])]}), "wrong_chunks"), (json.dumps({"points": [point(source_chunk_ids=["a", None])]}), "wrong_chunks"), (json.dumps({"points": [point(source_chunk_ids=list("abcde"))]}), "wrong_chunks"),
    (json.dumps({"points": [point(source_chunk_ids=["z"])]}), "unknown_chunk"), (json.dumps({"points": [point(source_chunk_ids=["a", "c"])]}), "several_sections"),
    (json.dumps({"points": [point(title="Delta")]}), "not_grounded"), (json.dumps({"points": [point(title="?!")]}), "not_grounded"),
    (json.dumps({"points": [point(), point(title="alpha BETA", source_chunk_ids=["b"])]}), "repeated_title"),
    (json.dumps({"points": [point(title="Delta"), point(title=1)]}), "wrong_fields"),
]


def test_each_fault(spark):
    assert {f for _, f in CASES} == {None, *answered_plans.FAULTS}
    answers = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "run long, answer string")
    chunks = [(i, c, s, t) for i in range(len(CASES)) for c, s, t in (("a", 1, "alpha-beta and gamma"), ("b", 1, "Gamma: alpha beta"), ("c", 2, "alpha beta"), ("d", 1, None))]
    chunks = spark.createDataFrame(chunks, "run long, chunk_id string, section long, text string")
    local = spark.createDataFrame([(i, k, 1, "L", "fact", "low", "concept", "", ["a"]) for i in range(len(CASES)) for k in range(3)], "run long, at int, section long, title string, point_type string, priority string, recommended_template string, rationale string, chunk_ids array<string>")
    plans, verdicts = answered_plans.choose_plans(answers, chunks, local)
    assert {r.run: r.fault for r in verdicts.collect()} == {i: f for i, (_, f) in enumerate(CASES)}
    got = {}
    for r in plans.collect():
        got.setdefault(r.run, set()).add((r.at, r.source, r.title, r.section, r.priority, tuple(r.chunk_ids)))
    assert got[0] == {(0, "llm", "Alpha beta", "1", "high", ("a",)), (1, "llm", "Gamma", "1", "high", ("b", "a"))} and got[1] == {(0, "llm", "ALPHA, beta!", "1", "low", ("a",))}
    assert all(got[i] == {(k, "local", "L", "1", "low", ("a",)) for k in range(3)} for i in range(2, len(CASES)))
    assert len({r.point_id for r in plans.collect()}) == plans.count()


def test_query_meets_most_faults(spark):
    found = {r.fault for r in answered.planner_verdicts(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) >= 10 and None in found
