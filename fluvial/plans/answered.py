"""Queries of planners' answers, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.operators import answered_plans
from fluvial.plans import queries as base

#: An answer's points as JSON from a turn (title, its chunk, its section), by the number of its conversation: sound ones, and one for each fault.
_POINT = '{"title":"%t","point_type":"concept","priority":"high","source_chunk_ids":["%c"],"recommended_template":"concept","rationale":" said "}'
_VARIANTS = (
    _POINT, _POINT.replace(',"rationale":" said "', ""), _POINT.replace('"priority"', '"more":1,"priority"'), _POINT.replace('"%t"', "12"), _POINT.replace('"concept"', '"novel"', 1), _POINT.replace('"high"', '"urgent"'),
    _POINT.replace("%c", "%c-x"), _POINT.replace('"%c"', '"%c","0-0","0-1","0-2"'), _POINT.replace("%t", "%tq"), _POINT.replace("%t", "same"), _POINT.replace('"%c"', '"%c","%c"'), _POINT.replace('["%c"]', "[]"),
    _POINT.replace('["%c"]', '["%c",1]'), _POINT.replace('["%c"]', '["%c",null]'), _POINT.replace('" said "', '"  "'), _POINT.replace('"%c"', '"%c","%d"'), _POINT.replace('"high"', '" low "'), _POINT,
)
_AROUND = (('{"points":[', "]}"), ('{"points":[', "]"), ('{"points":[', '],"note":1}'), ("[", "]"), ('{"points":[', "]}"), ('{"points":{"a":', "}}"), ('{"points":[', "]}"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """answers, chunks and local plans: a conversation is a run, a turn a chunk, four turns a section; a title is a turn's first letters."""
    turns = base._table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("-", "conv_id", t)
    title = F.trim(F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N} ]", ""), 1, 30))
    title = F.when(title == "", "none").otherwise(title)
    chunks = turns.select(F.col("conv_id").alias("run"), name(F.col("turn")).alias("chunk_id"), F.floor(F.col("turn") / 4).alias("section"), "text", "turn", title.alias("title"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    point = F.replace(pick(_VARIANTS, F.col("run")), F.lit("%t"), F.col("title"))
    point = F.replace(F.replace(point, F.lit("%c"), F.col("chunk_id")), F.lit("%d"), F.concat_ws("-", "run", (F.col("turn") + 1) % 2))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", point.alias("p")))), lambda x: x["p"]), ",")
    answers = chunks.groupBy("run").agg(body.alias("body")).select("run", F.concat(pick([a for a, _ in _AROUND], F.floor(F.col("run") / 2)), "body", pick([b for _, b in _AROUND], F.floor(F.col("run") / 2))).alias("answer"))
    local = chunks.select("run", F.col("turn").alias("at"), "section", "title", F.lit("fact").alias("point_type"), F.lit("medium").alias("priority"), F.lit("concept").alias("recommended_template"), F.lit("").alias("rationale"), F.array("chunk_id").alias("chunk_ids"))
    return answers, chunks.select("run", "chunk_id", "section", "text"), local


def planner_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered_plans.choose_plans(*_tables(spark, sf_dir))[1]


def chosen_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered_plans.choose_plans(*_tables(spark, sf_dir))[0].withColumn("chunk_ids", F.array_join("chunk_ids", ","))


def _texts(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_LETTERS = "regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_SQL = f"""WITH t AS (
  SELECT conv_id AS run, turn, concat_ws('-', conv_id, turn) AS chunk_id, turn // 4 AS section, text, trim(substr(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), 1, 30)) AS x FROM conversations
), c AS (SELECT *, CASE WHEN x = '' THEN 'none' ELSE x END AS title FROM t
), a AS (
  SELECT run, {_texts([a for a, _ in _AROUND])}[run // 2 % {len(_AROUND)} + 1] || string_agg(replace(replace(replace({_texts(list(_VARIANTS))}[run % {len(_VARIANTS)} + 1], '%t', title), '%c', chunk_id), '%d', concat_ws('-', run, (turn + 1) % 2)), ',' ORDER BY turn)
    || {_texts([b for _, b in _AROUND])}[run // 2 % {len(_AROUND)} + 1] AS answer FROM c GROUP BY run
), v AS (
  SELECT run, CASE WHEN NOT json_valid(answer) THEN 0 WHEN json_type(answer) <> 'OBJECT' OR json_keys(answer) <> ['points'] OR json_type(answer, '$.points') <> 'ARRAY' THEN 1 WHEN json_array_length(answer, '$.points') NOT BETWEEN 1 AND 96 THEN 2 END AS fault,
    CASE WHEN json_valid(answer) THEN json(answer) END AS v FROM a
), p AS (
  SELECT run, k AS "at", json_extract(v, '$.points[' || k || ']') AS p FROM v, range(96) r(k) WHERE fault IS NULL AND k < json_array_length(v, '$.points')
), f AS (
  SELECT run, "at", trim(p->>'$.title') AS title, trim(p->>'$.point_type') AS point_type, trim(p->>'$.priority') AS priority, trim(p->>'$.recommended_template') AS recommended_template, trim(p->>'$.rationale') AS rationale,
    CASE WHEN json_type(p, '$.source_chunk_ids') = 'ARRAY' THEN CAST(p->'$.source_chunk_ids' AS VARCHAR[]) END AS ids,
    CASE WHEN list_sort(json_keys(p)) <> ['point_type', 'priority', 'rationale', 'recommended_template', 'source_chunk_ids', 'title'] OR len(list_filter(['title', 'point_type', 'priority', 'recommended_template', 'rationale'], lambda k: json_type(p, '$.' || k) <> 'VARCHAR')) > 0
      OR json_type(p, '$.source_chunk_ids') <> 'ARRAY' OR len(list_filter(range(CAST(json_array_length(p, '$.source_chunk_ids') AS BIGINT)), lambda i: json_type(p, '$.source_chunk_ids[' || i || ']') NOT IN ('VARCHAR', 'NULL'))) > 0 OR json_array_length(p, '$.source_chunk_ids') = 0 THEN 3 END AS fields FROM p
), g AS (
  SELECT *, coalesce(fields, CASE WHEN '' IN (title, point_type, priority, recommended_template, rationale) OR length(title) > 240 OR length(rationale) > 240 THEN 4
    WHEN point_type NOT IN {tuple(answered_plans.POINT_TYPES)} OR priority NOT IN ('high', 'medium', 'low') OR recommended_template NOT IN {tuple(answered_plans.TEMPLATES)} THEN 5
    WHEN len(ids) NOT BETWEEN 1 AND 4 OR len(list_filter(ids, lambda x: x IS NULL)) > 0 OR len(list_distinct(ids)) < len(ids) THEN 6 END) AS fault FROM f
), e AS (SELECT run, "at", title, unnest(ids) AS chunk_id FROM g WHERE fault IS NULL
), h AS (
  SELECT e.run, e."at", any_value({_LETTERS.format("e.title")}) AS key, count_if(c.run IS NULL) AS missing, count(DISTINCT section) AS sections, bool_or(contains({_LETTERS.format("c.text")}, {_LETTERS.format("e.title")})) AS grounded, min(section) AS section FROM e LEFT JOIN c ON c.run = e.run AND c.chunk_id = e.chunk_id GROUP BY e.run, e."at"
), every AS (
  SELECT run, fault FROM v WHERE fault IS NOT NULL UNION ALL SELECT run, fault FROM g UNION ALL SELECT run, CASE WHEN missing > 0 THEN 7 WHEN sections > 1 THEN 8 WHEN NOT coalesce(grounded, FALSE) OR key = '' THEN 9 END FROM h
  UNION ALL SELECT run, 10 FROM h GROUP BY run, key HAVING count(*) > 1
), verdicts AS (SELECT run, min(fault) AS place, (SELECT count(*) FROM g WHERE g.run = every.run) AS points FROM every GROUP BY run
), plans AS (
  SELECT g.run, CAST(g."at" AS INTEGER) AS "at", 'llm' AS source, CAST(h.section AS VARCHAR) AS section, title, point_type, priority, recommended_template, rationale, array_to_string(ids, ',') AS chunk_ids FROM g JOIN h ON h.run = g.run AND h."at" = g."at" WHERE g.run IN (SELECT run FROM verdicts WHERE place IS NULL)
  UNION ALL SELECT run, CAST(turn AS INTEGER), 'local', CAST(section AS VARCHAR), title, 'fact', 'medium', 'concept', '', chunk_id FROM c WHERE run NOT IN (SELECT run FROM verdicts WHERE place IS NULL)
)"""

QUERIES = {f.__name__: f for f in (planner_verdicts, chosen_plans)}
ORACLES = {
    "planner_verdicts": f"{_SQL} SELECT run, {_texts(list(answered_plans.FAULTS))}[place + 1] AS fault, points FROM verdicts",
    "chosen_plans": f"""{_SQL} SELECT *, 'point-' || substr(sha256(concat_ws(chr(31), run, source, "at", replace(chunk_ids, ',', chr(31)))), 1, 16) AS point_id FROM plans""",
}
