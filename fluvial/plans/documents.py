"""More queries of the study-document engine: signals, routes, estimates, labels, renderers, critic and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.functions import labels
from fluvial.operators import cards as C
from fluvial.operators import critic, render, routing, runs
from fluvial.operators import planning as P
from fluvial.operators import quality as Q
from fluvial.plans import queries as base
from fluvial.sources import markdown, pages


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents, all in one section without a heading."""
    return base.paragraphs(spark, sf_dir).withColumns({"section_ord": F.lit(0), "heading": F.lit(None).cast("string"), "heading_path": F.array().cast("array<string>")})


def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.signals(base.paragraphs(spark, sf_dir)).withColumn("modes", F.array_join("modes", ","))


def document_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's template; every seventh asks for a mode, every fifth has a point of a type."""
    rows = routing.signals(base.paragraphs(spark, sf_dir))
    mode, kind = F.when(F.col("doc_id") % 7 == 0, "exam"), F.when(F.col("doc_id") % 5 == 0, "Process")
    return routing.route(rows, mode, kind, F.lit(None).cast("array<string>")).select("doc_id", "mode", "template", "reason_code", "route_confidence")


def generation_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.estimate(base.document_analysis(spark, sf_dir).select("doc_id", "estimated_points"))


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.plain_text(_sections(spark, sf_dir))


def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.summary(_sections(spark, sf_dir)).select("doc_id", "section_count", "block_count", "characters", F.element_at("blocks_by_kind", "paragraph").alias("paragraphs"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._table(spark, sf_dir, "pages")
    return rows.select("page_id", labels.source_label(F.col("url")).alias("label"), labels.tag(F.col("url")).alias("tag"), labels.model_tag(F.col("url")).alias("model_tag"), labels.preview(F.col("html")).alias("preview"), labels.clock(F.col("page_id") * 7).alias("clock"))


def escaped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base._table(spark, sf_dir, "conversations").select("conv_id", "turn", labels.escaped(F.col("text")).alias("html"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.blocks(base._docs(spark, sf_dir))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.blocks(base._table(spark, sf_dir, "pages"))


def duplicate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered(C.deduplicate(base._changed(spark, sf_dir)), "card_id", "matched_id")


def critic_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each card judged against its front; every third was repaired before, the model flags every fourth and gives reasons, some of them no codes."""
    rated = Q.evaluate(base._cards(spark, sf_dir), F.col("front"), F.lit("concept"))
    out = critic.decide(rated, F.col("front"), F.when(F.col("section") % 4 == 0, "flag"), F.array(F.lit("weak_answer"), F.lit("Bad-Reason"), F.lit("weak_answer"), F.lit("too.long"), F.concat(F.lit("r"), F.col("section").cast("string"))), F.col("section") % 3 == 0)
    return C.numbered(out, "card_id").select("card_id", "action", F.array_join("reason_codes", ",").alias("reason_codes"), "local_blocking")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = base.card_quality(spark, sf_dir)
    return rated.agg(F.count("*").alias("cards"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ready", "review", "blocked")))


def first_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered(runs.first_of_each(base._cards(spark, sf_dir), "section", "card_id", 2), "card_id")


def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.size_classes(base.paragraphs(spark, sf_dir), F.length("text"))


def point_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per conversation; its chunks are the turns, in order, and one that isn't there."""
    turns = base._table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws("-", "conv_id", turn)
    most = turns.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    points = most.select(F.col("conv_id").alias("point_id"), F.transform(F.sequence("a", F.col("b") + 1), name).alias("chunk_ids"))
    return P.evidence(points, turns.select(name(F.col("turn")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text")), 400)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: each user is a run, its number gives the level, an event's number the purpose."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))
    return base._table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), pick(_LEVELS, "user_id").alias("level"), pick(_PURPOSES, "event_id").alias("purpose"))


_LEVELS, _PURPOSES = ("fast", "standard", "deep"), ("generate", "planner", "critic", "repair")
_STATES = ("succeeded", "failed", "pending", "succeeded", "succeeded")


def call_reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.reserve(_calls(spark, sf_dir)).select("run_id", "ord", "call_number", "error")


def run_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 5 + 1).cast("int"))
    return runs.completion(base._table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), states.alias("state")))


def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose events are stages by their number, legal and not."""
    names = F.array(*map(F.lit, [*runs.NEXT, "completed"]))
    rows = _calls(spark, sf_dir).withColumn("stage", F.element_at(names, (F.col("ord") % 8 + 1).cast("int")))
    return runs.stages(rows)


def setting_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base._table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return runs.revisions(rows, "user_id", "event_id", "event_type")


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SIGNALS = f"""WITH {base._PARAGRAPHS}, c AS (SELECT *, length(text) AS n, regexp_matches(text, {_re(routing.DEFINITION)}) AS d, regexp_matches(text, {_re(routing.COMPARISON)}) AS m,
len(regexp_extract_all(text, {_re(routing.STEP)})) >= 2 AS p, length(regexp_replace(text, '[^\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS zh, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS en FROM blocks),
k AS (SELECT doc_id, count(*) AS block_count, count(*) AS content_blocks, CAST(sum(n) AS BIGINT) AS char_count, count_if(d) AS definition, count_if(m) AS comparison, count_if(p) AS process,
0::BIGINT AS formula, 0::BIGINT AS code, 0::BIGINT AS "table", 0::BIGINT AS transcript, CAST(least(96, sum(greatest(1, ceil(n / 800)))) AS BIGINT) AS estimated_points,
CASE WHEN sum(zh + en) = 0 THEN 'unknown' WHEN least(sum(zh), sum(en)) >= 8 OR (least(sum(zh), sum(en)) > 0 AND least(sum(zh), sum(en)) / sum(zh + en) >= 0.2) THEN 'mixed' WHEN sum(zh) > sum(en) THEN 'zh' ELSE 'en' END AS language FROM c GROUP BY doc_id),
s AS (SELECT *, 'text' AS document_kind, round(char_count / block_count, 2) AS content_density, round(0.55 + ((definition > 0)::INT + (comparison > 0)::INT + (process > 0)::INT) * 0.06, 2)::DOUBLE AS confidence,
concat_ws(',', CASE WHEN comparison > 0 THEN 'compare_contrast' END, CASE WHEN process > 0 THEN 'process_steps' END, CASE WHEN definition > 0 THEN 'definition' END, 'concept') AS modes FROM k)"""
_CLEAN = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]{{3,}}'))"

QUERIES = {
    f.__name__: f
    for f in (
        document_signals, document_routes, generation_estimates, plain_documents, document_summary, page_labels, escaped_turns, markdown_blocks, html_blocks,
        duplicate_decisions, critic_decisions, quality_counts, first_cards, block_sizes, point_evidence, call_reservations, run_completion, run_stages, setting_revisions,
    )
}
ORACLES = {
    "run_stages": f"""WITH RECURSIVE e AS (SELECT user_id AS run_id, {list(_LEVELS)}[user_id % 3 + 1] AS level, ['analyzing', 'planning', 'generating', 'reviewing', 'repairing', 'checking_coverage', 'deduplicating', 'completed'][event_id % 8 + 1] AS stage, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT run_id, level, CAST(0 AS BIGINT) AS n, 'analyzing' AS stage, 0 AS accepted, 0 AS refused FROM e UNION ALL
SELECT run_id, level, n, CASE WHEN ok THEN new ELSE stage END, accepted + CASE WHEN ok THEN 1 ELSE 0 END, refused + CASE WHEN ok THEN 0 ELSE 1 END FROM (
SELECT s.run_id, s.level, e.n, s.stage, e.stage AS new, s.accepted, s.refused, (s.stage, e.stage) IN (('analyzing', 'planning'), ('planning', 'generating'), ('generating', 'reviewing'), ('reviewing', 'repairing'), ('reviewing', 'checking_coverage'), ('repairing', 'reviewing'), ('repairing', 'checking_coverage'), ('checking_coverage', 'deduplicating'), ('deduplicating', 'completed')) AND NOT (s.level = 'fast' AND e.stage = 'repairing') AS ok
FROM s JOIN e ON e.run_id = s.run_id AND e.n = s.n + 1))
SELECT run_id, stage, accepted, refused FROM s QUALIFY n = max(n) OVER (PARTITION BY run_id)""",
    "document_signals": f"{_SIGNALS} SELECT * FROM s",
    "document_routes": f"""{_SIGNALS}, m AS (SELECT doc_id, confidence, CASE WHEN doc_id % 7 = 0 THEN 'exam' END AS asked, CASE WHEN doc_id % 5 = 0 THEN 'process_steps' END AS point, string_split(modes, ',')[1] AS doc FROM s),
r AS (SELECT *, coalesce(asked, point, doc) AS mode FROM m)
SELECT doc_id, mode, CASE mode WHEN 'exam' THEN 'exam_answer' ELSE mode END AS template,
CASE WHEN asked IS NOT NULL THEN 'explicit_mode' ELSE 'auto.' || CASE mode WHEN 'compare_contrast' THEN 'comparison' WHEN 'process_steps' THEN 'process' WHEN 'concept' THEN 'concept_fallback' ELSE mode END END AS reason_code,
CASE WHEN asked IS NOT NULL THEN 1.0 WHEN point IS NOT NULL THEN 0.92 WHEN doc = 'concept' THEN greatest(0.5, confidence) ELSE greatest(0.8, confidence) END::DOUBLE AS route_confidence FROM r""",
    "generation_estimates": f"""{_SIGNALS}, v(level, low, high, call_min, call_max) AS (VALUES ('fast', 0.5, 1.0, 1, 3), ('standard', 0.75, 1.25, 3, 8), ('deep', 1.0, 1.5, 4, 12)),
e AS (SELECT doc_id, estimated_points, level, CAST(greatest(1, ceil(estimated_points * low)) AS BIGINT) AS card_min, CAST(ceil(estimated_points * high) AS BIGINT) AS top, call_min, call_max FROM s, v)
SELECT doc_id, estimated_points, level, card_min, greatest(least(96, top), card_min) AS card_max, call_min, call_max, level <> 'fast' AS confirm FROM e""",
    "plain_documents": f"WITH {base._PARAGRAPHS} SELECT doc_id, string_agg(text, chr(10) ORDER BY block_ord) AS text FROM blocks GROUP BY doc_id",
    "document_summary": f"WITH {base._PARAGRAPHS} SELECT doc_id, 1::BIGINT AS section_count, count(*) AS block_count, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS paragraphs FROM blocks GROUP BY doc_id",
    "page_labels": """WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(coalesce(url, ''), '[^/\\\\]*$'), '\\s+', ' ', 'g')) AS name, trim(regexp_replace(lower(coalesce(url, '')), '[^a-z0-9]+', '-', 'g'), '-') AS tag,
replace(lower(trim(regexp_replace(coalesce(url, ''), '\\s+', ' ', 'g'))), ' ', '_') AS mt, trim(regexp_replace(coalesce(html, ''), '\\s+', ' ', 'g')) AS flat, page_id * 7 AS sec FROM pages)
SELECT page_id, CASE WHEN name IN ('', '.', '..') THEN 'document' ELSE rtrim(substr(name, 1, 120)) END AS label, rtrim(substr(tag, 1, 48), '-') AS tag, CASE WHEN length(mt) <= 32 THEN mt ELSE '' END AS model_tag,
CASE WHEN length(flat) <= 120 THEN flat ELSE rtrim(substr(flat, 1, 117)) || '...' END AS preview,
CASE WHEN sec >= 3600 THEN CASE WHEN sec < 36000 THEN '0' ELSE '' END || (sec // 3600) || ':' ELSE '' END || lpad((sec // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((sec % 60)::VARCHAR, 2, '0') AS clock FROM t""",
    "escaped_turns": """SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), '<br>') AS html FROM conversations""",
    "critic_decisions": f"""WITH q AS ({base.ORACLES["card_quality"]}), {base._CARDS_SQL},
w AS (SELECT card_id, section, back, front, list_filter({_WORDS.format("back")}, lambda x: NOT list_contains({critic.STOPWORDS}, x)) AS own, {_WORDS.format("front")} AS src FROM cards),
g AS (SELECT *, (len(own) = 0 OR len(list_intersect(own, src)) / len(own) < 0.6) AND back <> '' AND front <> '' AS loose FROM w),
r AS (SELECT g.*, list_filter(string_split(rule_ids, ','), lambda r: list_contains({list(Q.BLOCKING)}, r)) || CASE WHEN loose OR list_contains(string_split(rule_ids, ','), 'source_not_grounded_simple') THEN ['source_not_grounded'] ELSE [] END AS local FROM g JOIN q USING (card_id))
SELECT card_id, CASE WHEN len(local) > 0 THEN CASE WHEN section % 3 = 0 THEN 'reject' ELSE 'repair' END WHEN section % 4 = 0 THEN 'flag' ELSE 'pass' END AS action,
array_to_string(CASE WHEN len(local) > 0 AND section % 3 = 0 THEN local || ['repair_failed_local_validation'] WHEN len(local) > 0 THEN local WHEN section % 4 = 0 THEN ['weak_answer', 'r' || section] ELSE [] END, ',') AS reason_codes, len(local) > 0 AS local_blocking FROM r""",
    "quality_counts": f"SELECT count(*) AS cards, count_if(status = 'ready') AS ready, count_if(status = 'review') AS review, count_if(status = 'blocked') AS blocked FROM ({base.ORACLES['card_quality']})",
    "first_cards": f"WITH {base._CARDS_SQL} SELECT * FROM cards QUALIFY row_number() OVER (PARTITION BY section ORDER BY card_id) <= 2",
    "block_sizes": f"""WITH {base._PARAGRAPHS}, k(class, low, high) AS (VALUES ('0-32', 0, 32), ('33-64', 33, 64), ('65-128', 65, 128), ('129+', 129, 2000000000))
SELECT class, (SELECT count(*) FROM blocks WHERE length(text) BETWEEN low AND high) AS n FROM k""",
    "point_evidence": "SELECT conv_id AS point_id, CAST(count(*) AS INTEGER) AS chunks, max(turn) - min(turn) + 2 - count(*) AS missing, substr(string_agg(coalesce(text, ''), chr(10) ORDER BY turn), 1, 400) AS text FROM conversations GROUP BY conv_id",
    "call_reservations": f"""WITH c AS (SELECT user_id AS run_id, event_id AS ord, {list(_LEVELS)}[user_id % 3 + 1] AS level, {list(_PURPOSES)}[event_id % 4 + 1] AS purpose FROM events),
m AS (SELECT *, purpose = 'generate' OR (level = 'standard' AND purpose IN ('planner', 'repair')) OR level = 'deep' AS may, CASE level WHEN 'fast' THEN 3 WHEN 'standard' THEN 8 ELSE 12 END AS most FROM c),
n AS (SELECT *, sum(may::INT) OVER (PARTITION BY run_id ORDER BY ord) AS n FROM m)
SELECT run_id, ord, CASE WHEN may AND n <= most THEN CAST(n AS BIGINT) END AS call_number, CASE WHEN NOT may THEN 'call_not_allowed' WHEN n > most THEN 'call_budget_exhausted' END AS error FROM n""",
    "run_completion": f"""WITH c AS (SELECT user_id AS run_id, {list(_STATES)}[event_id % 5 + 1] AS state FROM events),
n AS (SELECT run_id, count_if(state = 'succeeded') AS succeeded, count_if(state = 'failed') AS failed, count_if(state = 'pending') AS open FROM c GROUP BY run_id)
SELECT *, CASE WHEN open > 0 THEN 'running' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM n""",
    "setting_revisions": """WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, event_type, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS revision FROM c""",
}
