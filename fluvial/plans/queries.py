"""Queries of the study-document engine over the tables in a folder, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.operators import cards as C
from fluvial.operators import planning as P
from fluvial.operators import quality as Q
from fluvial.sources import islands, paths


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.from_conversations(_table(spark, sf_dir, "conversations"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cards stand in for notes that exist; the fronts of odd conversations and the backs of those that 3 doesn't divide were changed since."""
    rows = _cards(spark, sf_dir).withColumnRenamed("card_id", "note_id")
    return rows.withColumns({"front": F.when(F.col("section") % 2 != 0, F.concat("front", F.lit(" (old)"))).otherwise(F.col("front")), "back": F.when(F.col("section") % 3 != 0, F.concat("back", F.lit(" (old)"))).otherwise(F.col("back"))})


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a blank line behind each sentence, so that they have more than one block."""
    return _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n")))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.blocks(_sentences(spark, sf_dir))


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.blocks(_sentences(spark, sf_dir), "code")


def document_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.analyze(paragraphs(spark, sf_dir))


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kinds(paragraphs(spark, sf_dir))


def card_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = Q.evaluate(_cards(spark, sf_dir), F.col("front"), F.lit("concept"))
    return C.numbered(rated, "card_id").select("card_id", F.array_join("rule_ids", ",").alias("rule_ids"), "score", "status")


def structural_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of two types, some without a source."""
    rows = _cards(spark, sf_dir).withColumn("card_type", F.when(F.col("section") % 6 == 0, "cloze").otherwise("basic")).withColumn("source", F.when(F.col("section") % 5 != 0, F.col("section").cast("string")))
    return C.numbered(Q.structural_gate(rows), "card_id").select("card_id", F.array_join("codes", ",").alias("codes"), "passed")


def duplicate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered(C.mark_duplicates(_cards(spark, sf_dir)), "card_id").select("card_id", "duplicate")


def existing_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered(C.match_existing(_cards(spark, sf_dir), _notes(spark, sf_dir)), "card_id", "note_id")


def notes_to_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered(C.to_append(_cards(spark, sf_dir), _notes(spark, sf_dir)), "card_id")


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cards and, under the ids of the turns that answer them, each of them with a word more; a conversation is a section."""
    rows = _cards(spark, sf_dir)
    later = F.struct(F.col("card_id.conv_id").alias("conv_id"), (F.col("card_id.turn") + 1).alias("turn"))
    return rows.unionByName(rows.withColumns({"card_id": later, "back": F.concat("back", F.lit(" again"))}))


def similar_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered(C.similar_pairs(_changed(spark, sf_dir), 0.5), "first_id", "second_id")


_STATE = {"mapping_complete": "section % 2 = 0", "duplicate_check_complete": "section % 3 <> 0", "final_confirmation_confirmed": "section % 5 <> 0", "target_valid": "section % 11 <> 0", "generation_complete": "section % 7 <> 0"}


def write_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of a write for each conversation's cards; its other conditions follow from its number."""
    rows = _cards(spark, sf_dir).groupBy("section").agg(F.count_if(F.length("back") <= 500).alias("kept_count"), F.count_if(F.trim("back") == "").alias("blocking_write_count"))
    rows = C.write_gates(rows.select("*", *(F.expr(c).alias(k) for k, c in _STATE.items())))
    return rows.select("section", F.array_join("reasons", ",").alias("reasons"), "allowed")


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.json_blocks(_table(spark, sf_dir, "events"), "event_id", "props")


def round_robin_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _docs(spark, sf_dir).select(F.col("source").alias("section"), F.col("doc_id").alias("chunk_ord"), P.chunk_title(F.col("text")).alias("title"))
    return P.round_robin(chunks)


def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("chunk_ord"))
    return P.batches(turns, 20)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return turns.groupBy(F.col("conv_id").alias("point_id")).agg((F.min("conv_id") % 7).alias("section"), F.when(F.min("conv_id") % 3 == 0, "high").otherwise("medium").alias("priority"))


def point_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coverage(_points(spark, sf_dir), _cards(spark, sf_dir).select(F.col("section").alias("point_id")))


def deck_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.style(_cards(spark, sf_dir).withColumn("deck", F.col("section") % 10), "deck")


def ranked_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.concat_ws("-", "source", "lang").alias("tag"), F.col("doc_id").alias("ord"))
    return P.top_tags(rows)


def caption_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sessions(_table(spark, sf_dir, "events"), "user_id", "ts", 3600)


def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return P.latest(rows, "user_id", "event_id")


_CARDS_SQL = """
u AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS back FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
cards AS (SELECT conv_id * 10000 + turn AS card_id, conv_id AS section, coalesce(text, '') AS front, coalesce(back, '') AS back FROM u WHERE role = 'user' AND next_role = 'assistant')"""
_FOLD = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_BLOCKS_SQL = """
l AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)), chr(10)), 1) AS line FROM documents),
f AS (SELECT doc_id, {x} AS x, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM l WHERE trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''),
g AS (SELECT doc_id, run, string_agg(x, chr(10) ORDER BY line) AS text, CAST(min(line) AS INTEGER) AS line_start, CAST(max(line) AS INTEGER) AS line_end FROM f GROUP BY doc_id, run),
blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 AS INTEGER) AS block_ord, '{kind}' AS kind, text, line_start, line_end FROM g)"""
_PARAGRAPHS = _BLOCKS_SQL.format(x="regexp_replace(x, '\\s+$', '')", kind="paragraph")


def _hits(checks: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in checks.items()) + "], lambda r: r IS NOT NULL), ',')"


def _quote(*patterns: str) -> str:
    return "'(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "'"


# The rules of single modes, as literals of their own.
_MODE_RULES = {
    "compare_card_missing_two_sides": r"mode = 'compare_contrast' AND NOT regexp_matches(f, '(?i)\bvs\.?\b|\bversus\b|difference between|compare.+(?:and|with)|.+(?:与|和).+(?:区别|异同|相比|不同)')",
    "process_card_missing_order": r"mode = 'process_steps' AND len(regexp_extract_all(b, '(?i)(?:首先|其次|然后|接着|最后|第一|第二|第三|\bfirst\b|\bthen\b|\bnext\b|\bfinally\b|(?:^|\n)\s*\d+[.)])')) < 2",
    "formula_card_missing_condition": r"mode = 'formula_rule' AND NOT regexp_matches(f || chr(10) || b, '(?i)条件|适用|当.+时|在.+情况下|\bwhen\b|\bif\b|\bwhere\b|\bprovided\b|\bappl(?:y|ies)\b')",
    "definition_card_missing_term": r"mode = 'definition' AND (length(regexp_replace(lower(f), '[\s?？!！。，,.、:：;；]', '', 'g')) < 4 OR regexp_matches(regexp_replace(lower(f), '[\s?？!！。，,.、:：;；]', '', 'g'), '^(?:(?:它|这|这个|上述内容)(?:是)?什么|what(?:is)?it)$'))",
    "exam_card_too_vague": r"mode = 'exam' AND regexp_matches(f, '(?i)(?:讨论|分析|简述|解释)(?:上述|相关|这个|以下)?内容|\b(?:discuss|describe|explain) (?:this|the above|the material)\b')",
    "quick_review_too_long": "mode = 'quick_review' AND (length(f) > 80 OR length(b) > 80)",
}
_VERBOSE = "CASE mode WHEN 'quick_review' THEN 90 WHEN 'definition' THEN 220 WHEN 'exam' THEN 280 WHEN 'compare_contrast' THEN 320 WHEN 'process_steps' THEN 360 WHEN 'mistake_trap' THEN 240 WHEN 'cloze_candidate' THEN 160 ELSE 260 END"
_CLOZE = r"\{\{c[1-9][0-9]*::[^{}\n]+?(?:::[^{}\n]+?)?\}\}"


def _quality_sql(cards: str = "SELECT card_id, front, back, 'concept' AS mode, front AS source FROM cards", short: bool = False, cloze: bool = False) -> str:
    """Cards with all rules that they hit; cards: card_id, front, back, mode, source."""
    words = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9_]{{3,}}')"
    pairs = lambda x: f"list_transform(range(1, greatest(length(regexp_replace({x}, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g')), 1)), lambda i: substr(regexp_replace({x}, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g'), i, 2))"
    core = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9\\x{{3400}}-\\x{{9fff}}]', '', 'g')"
    bullets = f"len(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '{Q.BULLET}')))"
    checks = {
        "empty_front": "f = ''", "empty_back": "b = ''",
        "short_front": f"f <> '' AND length(regexp_replace(f, '{Q.PUNCTUATION}', '', 'g')) < 4",
        "generic_front": f"regexp_matches(f, {_quote(*Q.GENERIC_FRONT)})",
        "long_back": f"length(b) > CASE mode WHEN 'quick_review' THEN 140 ELSE {240 if short else 500} END",
        "multiple_questions": "length(f) - length(translate(f, '?？', '')) > 1",
        "multi_point_card": f"{bullets} >= 3 OR regexp_matches(f, {_quote(Q.SEVERAL_POINTS)})",
        "too_many_bullets": f"{bullets} >= 4",
        "boilerplate_phrase": f"regexp_matches(f || chr(10) || b, {_quote(*Q.BOILERPLATE)})",
        "markdown_residue": f"regexp_matches(f || chr(10) || b, '{Q.MARKDOWN.replace('!??', '!?')}')",
        "answer_too_verbose_for_mode": f"length(b) > {_VERBOSE}",
        "front_not_question_like": f"f <> '' AND mode NOT IN ('definition', 'cloze_candidate') AND NOT (contains(f, '?') OR contains(f, '？') OR regexp_matches(f, {_quote(Q.QUESTION_START)}) OR {' OR '.join(f'contains(f, {w!r})' for w in Q.QUESTION_WORDS)})",
        "unsupported_cloze": "FALSE" if cloze else "contains(lower(f || chr(10) || b), '{{c') OR mode = 'cloze_candidate'",
        "cloze_syntax_invalid": f"mode = 'cloze_candidate' AND NOT (regexp_matches(f, '{_CLOZE}') AND NOT contains(lower(regexp_replace(f, '{_CLOZE}', '', 'g')), '{{{{c') AND NOT contains(regexp_replace(f, '{_CLOZE}', '', 'g'), '}}}}'))" if cloze else "FALSE",
        "source_not_grounded_simple": f"s <> '' AND f <> '' AND b <> '' AND NOT (list_has_any({words('b')}, {words('s')}) OR list_has_any({pairs('b')}, {pairs('s')}))",
        "answer_contains_prompt_artifact": f"regexp_matches(b, {_quote(Q.PROMPT_ARTIFACT)})",
        "front_contains_answer_leak": f"length({core('b')}) >= 4 AND contains({core('f')}, {core('b')})",
        "back_contains_unnecessary_intro": f"regexp_matches(b, {_quote(Q.INTRO)})",
    } | _MODE_RULES
    cost = "CASE " + " ".join(f"WHEN r = '{k}' THEN {v}" for k, v in Q.COSTS.items()) + f" WHEN r = '' THEN 0 ELSE {Q.DEFAULT_COST} END"
    return f"""WITH {_CARDS_SQL}, t AS (SELECT card_id, mode, regexp_replace(front, '^\\s+|\\s+$', '', 'g') AS f, regexp_replace(back, '^\\s+|\\s+$', '', 'g') AS b, regexp_replace(coalesce(source, ''), '^\\s+|\\s+$', '', 'g') AS s FROM ({cards})),
h AS (SELECT card_id, {_hits(checks)} AS rule_ids FROM t)
SELECT card_id, rule_ids, greatest(0, 100 - CAST(list_sum(list_transform(string_split(rule_ids, ','), lambda r: {cost})) AS BIGINT)) / 100 AS score,
CASE WHEN list_has_any(string_split(rule_ids, ','), {list(Q.BLOCKING)}) THEN 'blocked' WHEN rule_ids <> '' THEN 'review' ELSE 'ready' END AS status FROM h"""


_F, _B = _FOLD.format("front"), _FOLD.format("back")
_COLLAPSE = "trim(regexp_replace(front, '\\s+', ' ', 'g'))"
_GATE = {"unsupported_card_type": "section % 6 = 0", "empty_front": "f = ''", "empty_back": "b = ''", "front_back_same": "f = b", "front_too_long": "length(f) > 200", "back_too_short": "length(b) < 8", "missing_source": "section % 5 = 0"}
_WRITE = {k: c if "count" in c else f"NOT ({_STATE[c.removeprefix('not ')]})" for k, c in C.GATES.items()}

QUERIES = {f.__name__: f for f in (document_analysis, paragraphs, code_blocks, block_kinds, card_quality, structural_gate, duplicate_cards, existing_notes, notes_to_append, similar_cards, write_gates, json_values, round_robin_plan, chunk_batches, point_coverage, deck_style, ranked_tags, caption_sessions, latest_results)}
ORACLES = {
    "paragraphs": f"WITH {_PARAGRAPHS} SELECT * FROM blocks",
    "code_blocks": f"WITH {_BLOCKS_SQL.format(x='x', kind='code')} SELECT * FROM blocks",
    "block_kinds": f"WITH {_PARAGRAPHS} SELECT doc_id, kind, count(*) AS n FROM blocks GROUP BY doc_id, kind",
    "document_analysis": f"""WITH {_PARAGRAPHS}, c AS (SELECT *, length(regexp_replace(text, '[^\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) AS zh, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS en FROM blocks)
SELECT doc_id, count(*) AS block_count, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(0 AS BIGINT) AS code_blocks, least(96, CAST(sum(greatest(1, ceil(length(text) / 800))) AS BIGINT)) AS estimated_points,
CASE WHEN sum(zh + en) = 0 THEN 'unknown' WHEN least(sum(zh), sum(en)) >= 8 OR (least(sum(zh), sum(en)) > 0 AND least(sum(zh), sum(en)) / sum(zh + en) >= 0.2) THEN 'mixed' WHEN sum(zh) > sum(en) THEN 'zh' ELSE 'en' END AS language FROM c GROUP BY doc_id""",
    "card_quality": _quality_sql(),
    "structural_gate": f"WITH {_CARDS_SQL}, t AS (SELECT card_id, section, regexp_replace(front, '^\\s+|\\s+$', '', 'g') AS f, regexp_replace(back, '^\\s+|\\s+$', '', 'g') AS b FROM cards) SELECT card_id, {_hits(_GATE)} AS codes, f <> '' AND b <> '' AND section % 6 <> 0 AS passed FROM t",
    "duplicate_cards": f"WITH {_CARDS_SQL} SELECT card_id, ({_F} <> '' OR {_B} <> '') AND row_number() OVER (PARTITION BY {_F}, {_B} ORDER BY card_id) > 1 AS duplicate FROM cards",
    "existing_notes": f"""WITH {_CARDS_SQL}, k AS (SELECT card_id, section, {_F} AS f, {_B} AS b FROM cards)
SELECT c.card_id, (SELECT min(n.card_id) FROM k n WHERE (n.f || CASE WHEN n.section % 2 <> 0 THEN ' (old)' ELSE '' END = c.f AND c.f <> '') OR (n.b || CASE WHEN n.section % 3 <> 0 THEN ' (old)' ELSE '' END = c.b AND c.b <> '')) AS note_id FROM k c""",
    "notes_to_append": f"""WITH {_CARDS_SQL}, k AS (SELECT *, {_COLLAPSE} AS f FROM cards), r AS (SELECT *, row_number() OVER (PARTITION BY f, section ORDER BY card_id) AS r FROM k WHERE NOT EXISTS (SELECT 1 FROM k n WHERE n.f || CASE WHEN n.section % 2 <> 0 THEN ' (old)' ELSE '' END = k.f AND n.section = k.section))
SELECT card_id, section, front, back FROM r WHERE r = 1""",
    "similar_cards": f"""WITH {_CARDS_SQL}, o AS (SELECT card_id, section, front, back FROM cards UNION ALL SELECT card_id + 1, section, front, back || ' again' FROM cards),
t AS (SELECT card_id, section, list_distinct(regexp_extract_all(lower(front || chr(10) || back), '[a-z0-9_]{{2,}}')) AS t FROM o),
p AS (SELECT a.card_id AS first_id, b.card_id AS second_id, len(list_intersect(a.t, b.t)) AS k, len(a.t) + len(b.t) AS n FROM t a JOIN t b ON a.card_id < b.card_id AND a.section = b.section)
SELECT first_id, second_id, round(k / (n - k), 3) AS similarity FROM p WHERE n > k AND k / (n - k) >= 0.5""",
    "write_gates": f"WITH {_CARDS_SQL}, g AS (SELECT section, count_if(length(back) <= 500) AS kept_count, count_if(trim(back) = '') AS blocking_write_count FROM cards GROUP BY section), h AS (SELECT section, {_hits(_WRITE)} AS reasons FROM g) SELECT section, reasons, reasons = '' AS allowed FROM h",
    "json_values": "SELECT event_id, CAST(0 AS INTEGER) AS block_ord, '$.k = ' || json_extract_string(props, '$.k') AS text, CAST(NULL AS VARCHAR) AS error FROM events",
    "round_robin_plan": """WITH l AS (SELECT source AS section, doc_id AS chunk_ord, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(x, '# ')) AS ls FROM documents),
c AS (SELECT section, chunk_ord, substr(trim(regexp_replace(coalesce(ls[1], ''), '^[-*+ ]+', '')), 1, 240) AS title FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY chunk_ord) AS turn, min(chunk_ord) OVER (PARTITION BY section) AS section_ord, regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM c),
f AS (SELECT * FROM r WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY turn, section_ord) = 1),
t AS (SELECT * FROM f ORDER BY turn, section_ord LIMIT 96)
SELECT section, chunk_ord, title, CASE WHEN row_number() OVER (PARTITION BY section ORDER BY turn) = 1 THEN 'high' ELSE 'medium' END AS priority, CAST(row_number() OVER (ORDER BY turn, section_ord) - 1 AS INTEGER) AS point_ord FROM t""",
    "chunk_batches": """WITH n AS (SELECT conv_id AS run, turn AS chunk_ord, least(3, count(*) OVER (PARTITION BY conv_id)) AS k, row_number() OVER w AS r, ntile(3) OVER w AS t3, ntile(2) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT run, chunk_ord, k, CASE k WHEN 3 THEN t3 WHEN 2 THEN t2 ELSE 1 END - 1 AS batch FROM n)
SELECT run, chunk_ord, CAST(batch AS INTEGER) AS batch, CAST(20 // k + CASE WHEN batch < 20 % k THEN 1 ELSE 0 END AS INTEGER) AS quota FROM b""",
    "point_coverage": f"""WITH {_CARDS_SQL}, p AS (SELECT DISTINCT conv_id AS point_id, conv_id % 7 AS section, CASE WHEN conv_id % 3 = 0 THEN 'high' ELSE 'medium' END AS priority FROM conversations),
r AS (SELECT p.*, (SELECT count(*) FROM cards c WHERE c.section = p.point_id) AS cards FROM p)
SELECT *, priority = 'high' AND cards = 0 AS missing, cards > greatest(2, 2 * avg(cards) OVER ()) AS over_covered FROM r""",
    "deck_style": f"WITH {_CARDS_SQL} SELECT section % 10 AS deck, count(*) AS cards, CAST(min(length(front)) AS INTEGER) AS front_min, CAST(max(length(front)) AS INTEGER) AS front_max, CAST(min(length(back)) AS INTEGER) AS back_min, CAST(max(length(back)) AS INTEGER) AS back_max, round(count_if(contains(front, '?')) / count(*), 4) AS question_ratio FROM cards GROUP BY 1",
    "ranked_tags": "SELECT concat_ws('-', source, lang) AS tag, count(*) AS n, min(doc_id) AS first_ord FROM documents GROUP BY 1 ORDER BY n DESC, first_ord LIMIT 16",
    "caption_sessions": """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session FROM m)
SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session""",
    "latest_results": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
}
