"""Queries of retries, bounds, nested JSON, modes and places of cards, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial import limits
from fluvial.operators import drafts, runs
from fluvial.operators import cards as C
from fluvial.plans import queries as base
from fluvial.sources import paths


def _retry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as chunks of the run of their user, users' numbers give what a run may still do."""
    n = F.col("event_id")
    events = base._table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), n.alias("ord"), F.when(n % 3 == 1, "failed").when(n % 3 == 2, "pending").otherwise("succeeded").alias("state"), (n % 11 == 4).alias("scheduled"), (n % 4).alias("cards"), F.when(n % 7 == 3, "generation_output_invalid").alias("error"))
    events = events.withColumn("scheduled", F.when(F.col("run_id") % 9 == 5, True).otherwise(F.col("scheduled")))
    u = F.col("run_id")
    limits_ = events.select(u).distinct().select(u, (u % 5 * 12).alias("card_limit"), (u % 4 * 3).alias("cards"), F.when(u % 6 == 1, 2).otherwise(100_000).alias("calls_left"))
    return events, limits_


def retry_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.retry_failed(*_retry(spark, sf_dir))[0]


def retry_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.retry_failed(*_retry(spark, sf_dir))[1]


def bounded_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events under a bound of one row less, as many, and one more than there are."""
    events = base._table(spark, sf_dir, "events")
    n, out = events.count(), []
    for more in (-1, 0, 1):
        try:
            out.append(limits.materialize_bounded(events, "events", n + more).agg(F.lit(more).alias("more"), F.count("*").alias("rows"), F.lit(None).cast("string").alias("error")))
        except limits.TooManyRows:
            out.append(spark.range(1).select(F.lit(more).alias("more"), F.lit(None).cast("long").alias("rows"), F.lit("too_many_rows").alias("error")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of JSON within JSON: objects, lists, empty ones, numbers, booleans, nulls and escaped keys; a line a record of its conversation."""
    turns = base._table(spark, sf_dir, "conversations")
    text = F.to_json(F.struct(F.coalesce(F.substring("text", 1, 40), F.lit("")).alias("said")))
    line = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"who":{"role":"'), F.coalesce("role", F.lit("")), F.lit('","flags":[true,null,['), F.col("conv_id").cast("string"), F.lit('.5,{}]],"none":[]},"a.b":{"c":'), text, F.lit('},"last":false}'))
    line = F.when(F.col("conv_id") % 10 == 3, F.concat(line, F.lit("]"))).otherwise(line)
    lines = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"]), "\n \n").alias("text"))
    return paths.json_lines(lines, "doc_id", "text")


def _moded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cards = C.numbered(base._cards(spark, sf_dir), "card_id").select("card_id", F.col("section").alias("point_id"), "front", "back")
    names = F.array(*map(F.lit, (*drafts.TEMPLATES, "unheard_of")))
    points = base._table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("point_id")).distinct().filter("point_id is not null")
    return cards, points.select("point_id", F.when(F.col("point_id") % 11 < 10, F.element_at(names, (F.col("point_id") % 9 + 1).cast("int"))).alias("recommended_template"))


def card_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards, points = _moded(spark, sf_dir)
    return drafts.effective_modes(cards, points, F.when(F.col("card_id") % 3 == 0, "exam_answer").otherwise("auto")).select("card_id", "mode")


def point_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a point of one to three of its turns, one of them another conversation's or none's."""
    turns = base._table(spark, sf_dir, "conversations")
    name = lambda c, t: F.concat_ws("-", c, t)
    chunks = turns.select(name(F.col("conv_id"), F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("document_id"), F.concat(F.lit("part "), F.col("conv_id").cast("string")).alias("source_label"))
    p = F.col("conv_id")
    ids = F.slice(F.array(name(p, F.lit("0")), name(p, F.lit("1")), name(p + F.when(p % 4 == 0, 1).otherwise(0), F.lit("2"))), F.lit(1), (p % 4).cast("int"))
    points = turns.select(p).distinct().select(p.alias("point_id"), F.when(p % 7 == 0, F.array(name(p, F.lit("x")))).when(p % 4 == 0, F.array(name(p, F.lit("0")), name(p + 1, F.lit("0")))).otherwise(ids).alias("chunk_ids"))
    return drafts.point_spans(points, chunks, "batch")


def card_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards, points = _moded(spark, sf_dir)
    cards = cards.select(F.col("card_id").alias("ord"), "point_id", "front", "back", F.when(F.col("card_id") % 5 != 0, F.col("front")).otherwise(" \n").alias("source_excerpt"))
    found = drafts.located_drafts(cards, points.filter("recommended_template is not null").select("point_id", F.concat(F.lit("line "), F.col("point_id").cast("string")).alias("location")))
    return found.select("draft", "ord", "location")


def retained_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards, _ = _moded(spark, sf_dir)
    n = F.col("card_id")
    cards = cards.select(n.alias("candidate_id"), F.when(F.col("point_id") % 3 == 0, "failed").when(F.col("point_id") % 3 == 1, "succeeded").alias("state"))
    return drafts.retained(cards, cards.select("candidate_id", F.floor(F.col("candidate_id") / 10_000).alias("p")).filter("p % 2 = 0").select("candidate_id"))


def write_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = base._table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    regions = base._table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return drafts.targets(nations, "deck").unionByName(drafts.targets(regions, "note type"))


_RETRY = """WITH RECURSIVE e AS (SELECT user_id AS run_id, event_id AS ord, event_id % 3 = 1 AS failed, event_id % 11 = 4 OR user_id % 9 = 5 AS scheduled, CASE WHEN event_id % 7 = 3 THEN 0 ELSE event_id % 4 END AS cards, CASE WHEN event_id % 7 = 3 THEN 'generation_output_invalid' END AS error FROM events),
l AS (SELECT run_id, (run_id % 5) * 12 - (run_id % 4) * 3 AS slots, CASE WHEN run_id % 6 = 1 THEN 2 ELSE 100000 END AS calls_left, count_if(failed) AS failed, count_if(failed AND NOT scheduled) AS open FROM e GROUP BY run_id),
v AS (SELECT *, CASE WHEN open = 0 AND failed > 0 THEN 'retry_already_scheduled' WHEN open = 0 THEN 'no_failed_chunks' WHEN calls_left < open THEN 'retry_call_budget_insufficient' END AS refused FROM l),
o AS (SELECT e.*, row_number() OVER (PARTITION BY e.run_id ORDER BY ord) AS k FROM e JOIN v ON v.run_id = e.run_id WHERE e.failed AND NOT scheduled AND refused IS NULL),
w AS (SELECT run_id, 0::BIGINT AS k, NULL::BIGINT AS ord, greatest(slots, 0) AS remaining, NULL::VARCHAR AS state, NULL::VARCHAR AS error, FALSE AS called, 0::BIGINT AS accepted FROM v WHERE refused IS NULL
UNION ALL SELECT w.run_id, o.k, o.ord, remaining - CASE WHEN remaining > 0 THEN least(remaining, cards) ELSE 0 END, CASE WHEN remaining > 0 AND o.error IS NULL THEN 'succeeded' ELSE 'failed' END, CASE WHEN remaining < 1 THEN 'card_limit_reached' ELSE o.error END, remaining > 0, CASE WHEN remaining > 0 THEN least(remaining, cards) ELSE 0 END FROM w JOIN o ON o.run_id = w.run_id AND o.k = w.k + 1)"""
_CASES = """p AS (SELECT DISTINCT conv_id AS point_id FROM conversations)"""
_MODES = "['concept', 'definition', 'exam_answer', 'quick_review', 'compare_contrast', 'process_steps', 'formula_rule', 'mistake_trap', 'unheard_of']"

QUERIES = {f.__name__: f for f in (retry_attempts, retry_runs, bounded_tables, nested_json, card_modes, point_places, card_drafts, retained_cards, write_targets)}
ORACLES = {
    "retry_attempts": f"{_RETRY} SELECT run_id, ord, state, error, called, accepted FROM w WHERE k > 0",
    "retry_runs": f"{_RETRY} SELECT v.run_id, refused AS error, coalesce(c.calls, 0) AS calls, coalesce(c.accepted, 0) AS accepted FROM v LEFT JOIN (SELECT run_id, count_if(called) AS calls, CAST(sum(accepted) AS BIGINT) AS accepted FROM w WHERE k > 0 GROUP BY run_id) c ON c.run_id = v.run_id",
    "bounded_tables": "SELECT more, CASE WHEN more >= 0 THEN (SELECT count(*) FROM events) END AS rows, CASE WHEN more < 0 THEN 'too_many_rows' END AS error FROM (VALUES (-1), (0), (1)) t(more)",
    "nested_json": """WITH x AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS record, conv_id % 10 = 3 AS bad, json_object('turn', turn, 'who', json_object('role', coalesce(role, ''), 'flags', json_array(true, NULL, json_array(CAST(conv_id || '.5' AS DOUBLE), json('{}'))), 'none', json('[]')), 'a.b', json_object('c', json_object('said', coalesce(substr(text, 1, 40), ''))), 'last', false) AS j FROM conversations),
t AS (SELECT doc_id, record, bad, unnest(['$.turn', '$.who.role', '$.who.flags[0]', '$.who.flags[1]', '$.who.flags[2][0]', '$."a.b".c.said', '$.last']) AS path, unnest(range(7)) AS k, j FROM x),
v AS (SELECT doc_id, record, k, CASE k WHEN 5 THEN '$.a\\.b.c.said' ELSE path END AS path, coalesce(json_extract_string(j, path), 'null') AS value FROM t WHERE NOT bad)
SELECT doc_id, CAST(record AS INTEGER) AS record, CAST(record * 2 - 1 AS INTEGER) AS line, CAST(k AS INTEGER) AS block_ord, path || ' = ' || value AS text, regexp_replace(path, '\\.[^.]*$', '') AS section, NULL::VARCHAR AS error FROM v
UNION ALL SELECT doc_id, CAST(record AS INTEGER), CAST(record * 2 - 1 AS INTEGER), 0, NULL, NULL, 'invalid_json' FROM x WHERE bad""",
    "card_modes": f"WITH {base._CARDS_SQL}, m AS (SELECT card_id, CASE WHEN section % 11 < 10 THEN {_MODES}[section % 9 + 1] END AS t FROM cards) SELECT card_id, CASE WHEN card_id % 3 = 0 THEN 'exam_answer' WHEN t IS NULL OR t = 'unheard_of' THEN 'concept' ELSE t END AS mode FROM m",
    "point_places": f"""WITH {_CASES}, k AS (SELECT concat_ws('-', conv_id, turn) AS chunk_id, conv_id FROM conversations),
i AS (SELECT point_id, unnest(CASE WHEN point_id % 7 = 0 THEN [point_id || '-x'] WHEN point_id % 4 = 0 THEN [point_id || '-0', (point_id + 1) || '-0'] ELSE [point_id || '-0', point_id || '-1', point_id || '-2'][1:point_id % 4] END) AS chunk_id FROM p),
s AS (SELECT i.point_id, count(k.chunk_id) AS chunks, count(DISTINCT k.conv_id) AS d, min(k.conv_id) AS doc, max(k.chunk_id) AS c FROM i LEFT JOIN k ON k.chunk_id = i.chunk_id GROUP BY i.point_id)
SELECT point_id, chunks, CASE WHEN d = 1 THEN CAST(doc AS VARCHAR) ELSE 'batch' END AS document_id, CASE WHEN d = 1 THEN 'part ' || doc ELSE 'Imported material' END AS source_label, CASE WHEN chunks = 1 THEN c END AS chunk_id FROM s""",
    "card_drafts": f"""WITH {base._CARDS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY card_id) AS n FROM cards)
SELECT 'universal-' || n AS draft, card_id AS ord, CASE WHEN section % 11 < 10 THEN 'line ' || section END AS location FROM n WHERE regexp_matches(front, '\\S') AND regexp_matches(back, '\\S') AND card_id % 5 <> 0""",
    "retained_cards": f"WITH {base._CARDS_SQL} SELECT card_id AS candidate_id, CASE section % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'succeeded' END AS state FROM cards WHERE section % 3 <> 1 OR section % 2 = 0",
    "write_targets": """WITH o AS (SELECT 'deck' AS kind, n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation UNION ALL SELECT 'note type', r_regionkey, r_name FROM region)
SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY lower(name), id) - 1 AS INTEGER) AS position, id, name FROM o""",
}
