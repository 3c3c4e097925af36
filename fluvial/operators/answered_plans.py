"""Planners' answers checked point by point, and the local plan for a run whose answer has any fault.

An answer is read as a variant: its schema says in one comparison which keys a point has and of what types they are. Each
check gives a point a fault or none; a run's verdict is the first of its faults, and only runs without any keep their answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.text import letters_only
from fluvial.staging import discard, join_skewed, materialize

# Characters of an answer and points of a plan at most, chunks of a point, lengths of texts; the kinds of points, priorities and templates.
MOST_CHARS, MOST_POINTS, MOST_CHUNKS = 256_000, 96, 4
LENGTHS = {"title": 240, "point_type": 40, "priority": 12, "recommended_template": 64, "rationale": 240}
POINT_TYPES = ("concept", "definition", "comparison", "process", "formula", "code", "table", "transcript", "mistake", "exam", "fact")
PRIORITIES = ("high", "medium", "low")
TEMPLATES = ("concept", "definition", "exam_answer", "quick_review", "compare_contrast", "process_steps", "formula_rule", "mistake_trap")
_SCHEMA = "OBJECT<point_type: STRING, priority: STRING, rationale: STRING, recommended_template: STRING, source_chunk_ids: ARRAY<STRING>, title: STRING>"

#: Faults of a run, the first that holds: of the whole answer, then of its points.
FAULTS = ("not_json", "wrong_keys", "wrong_count", "wrong_fields", "unbounded_text", "unknown_value", "wrong_chunks", "unknown_chunk", "several_sections", "not_grounded", "repeated_title")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _fault(rank: str, when: Column) -> Column:
    return F.when(when, F.lit(FAULTS.index(rank)))


def parsed(answers: DataFrame) -> DataFrame:
    """run, at, fault (a place in FAULTS, or null) and the fields of each point of answers (run, answer); at is null in a row for the answer as a whole."""
    value = F.when(F.length("answer") <= MOST_CHARS, F.try_parse_json("answer"))
    rows = answers.select("run", value.alias("v"))
    top = F.expr("try_variant_get(v, '$', 'map<string, variant>')")
    points = F.expr("try_variant_get(v, '$.points', 'array<variant>')")
    rows = rows.withColumns({"keys": F.map_keys(top), "points": points})
    n = F.size("points")
    whole = F.coalesce(_fault("not_json", F.col("v").isNull()), _fault("wrong_keys", ~F.col("keys").eqNullSafe(F.array(F.lit("points"))) | F.col("points").isNull()), _fault("wrong_count", ~n.between(1, MOST_POINTS)))
    rows = rows.withColumn("fault", whole)
    each = rows.filter("fault is null").select("run", F.posexplode("points").alias("at", "p"))
    field = lambda name: F.expr(f"try_variant_get(p, '$.{name}', 'string')")
    each = each.select("run", "at", F.schema_of_variant("p").alias("schema"), *(field(f).alias(f) for f in LENGTHS), F.expr("try_variant_get(p, '$.source_chunk_ids', 'array<string>')").alias("chunk_ids"))
    ids = F.col("chunk_ids")
    bounded = F.lit(True)
    for name, most in LENGTHS.items():
        bounded = bounded & (_strip(F.col(name)) != "") & (F.length(name) <= most)
    values = _strip(F.col("point_type")).isin(*POINT_TYPES) & _strip(F.col("priority")).isin(*PRIORITIES) & _strip(F.col("recommended_template")).isin(*TEMPLATES)
    distinct = F.size(ids).between(1, MOST_CHUNKS) & ~F.exists(ids, lambda x: x.isNull()) & (F.size(F.array_distinct(ids)) == F.size(ids))
    fault = F.coalesce(_fault("wrong_fields", ~F.col("schema").eqNullSafe(_SCHEMA)), _fault("unbounded_text", ~F.coalesce(bounded, F.lit(False))), _fault("unknown_value", ~F.coalesce(values, F.lit(False))), _fault("wrong_chunks", ~F.coalesce(distinct, F.lit(False))))
    each = each.select("run", "at", fault.alias("fault"), *(_strip(F.col(f)).alias(f) for f in LENGTHS), "chunk_ids")
    none = [F.lit(None).cast(each.schema[c].dataType).alias(c) for c in each.columns[3:]]
    return each.unionByName(rows.filter("fault is not null").select("run", F.lit(None).cast("int").alias("at"), "fault", *none))


def choose_plans(answers: DataFrame, chunks: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, verdicts) of runs: plans has run, at, source (llm or local), point_id, section and the fields of points; verdicts has run, fault (null: the answer counts) and points.

    answers: run, answer (JSON text), one a run; chunks: run, chunk_id, section, text, one a chunk; local: run, at, section, title,
    point_type, priority, recommended_template, rationale, chunk_ids of the local plans. An answer must be an object of points
    alone, each with its fields and no other; its chunks must be the run's, of one section, and its title must stand in one of
    them, letters and digits alone compared; no two points may have one title. Keys that repeat make no JSON here.
    """
    points = materialize(parsed(answers), "answered_points")
    asked = points.filter("fault is null").select("run", "at", letters_only(F.col("title")).alias("key"), F.explode("chunk_ids").alias("chunk_id"))
    asked = materialize(asked, "asked_chunks")
    known = chunks.select("run", "chunk_id", F.col("section").cast("string").alias("section"), letters_only(F.col("text")).alias("letters"), F.lit(True).alias("there"))
    found = join_skewed(asked, known, ["run", "chunk_id"], ["at"], "left")
    grounded = (F.col("key") != "") & F.coalesce(F.contains(F.col("letters"), F.col("key")), F.lit(False))
    found = found.groupBy("run", "at").agg(F.first("key").alias("key"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_distinct("section").alias("sections"), F.max(grounded).alias("grounded"), F.min("section").alias("section"))
    found = materialize(found, "grounds")
    twice = found.groupBy("run", "key").agg(F.count("*").alias("n"), F.min("at").alias("at")).filter("n > 1").select("run", F.lit(FAULTS.index("repeated_title")).alias("fault"))
    of_points = F.coalesce(_fault("unknown_chunk", F.col("missing") > 0), _fault("several_sections", F.col("sections") > 1), _fault("not_grounded", ~F.col("grounded")))
    every = points.select("run", "fault").unionByName(found.select("run", of_points.alias("fault"))).unionByName(twice)
    first = every.groupBy("run").agg(F.min("fault").alias("place"))
    names = F.array(*map(F.lit, FAULTS))
    counts = points.groupBy("run").agg(F.count("at").alias("points"))
    verdicts = materialize(first.join(counts, "run").select("run", F.when(F.col("place").isNotNull(), F.element_at(names, (F.col("place") + 1).cast("int"))).alias("fault"), "points"), "verdicts")

    fields = ["title", "point_type", "priority", "recommended_template", "rationale", "chunk_ids"]
    good = points.join(verdicts.filter("fault is null").select("run"), "run", "left_semi").join(found.select("run", "at", "section"), ["run", "at"])
    good = good.select("run", "at", F.lit("llm").alias("source"), "section", *fields)
    rest = local.join(verdicts.filter("fault is null").select("run"), "run", "left_anti").select("run", F.col("at").cast("int").alias("at"), F.lit("local").alias("source"), F.col("section").cast("string").alias("section"), *fields)
    named = F.concat_ws("\x1f", F.col("run").cast("string"), "source", F.col("at").cast("string"), "chunk_ids")
    plans = good.unionByName(rest).withColumn("point_id", F.concat(F.lit("point-"), F.substring(F.sha2(named.cast("binary"), 256), 1, 16)))
    plans = materialize(plans, "plans")
    discard(points, asked, found)
    return plans, verdicts
