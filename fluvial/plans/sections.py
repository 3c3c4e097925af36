"""Queries of Markdown sections, and the same in SQL: a walk along the lines with fence and stack as a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.plans import queries as base
from fluvial.sources import sections

#: What stands before each sentence, by its number; the second part stands behind it.
_MARKS = (("", ""), ("# ", ""), ("", ""), ("### ", " ##"), ("", ""), ("```", ""), ("", ""), ("## ", ""), ("~~~~", ""), ("", ""), ("#### ", ""), ("````", ""), ("  ", " "), ("~~~~~", ""), ("```", ""), ("###### ", " #"), ("#", ""))


def _marked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a sentence a line, some of them headings or fences by their number."""
    pick = lambda k, n: F.element_at(F.array(*(F.lit(m[k]) for m in _MARKS)), (n % len(_MARKS) + 1).cast("int"))
    row = lambda x, i: F.concat(pick(0, F.col("doc_id") * 5 + i * i), x, pick(1, F.col("doc_id") * 5 + i * i))
    return base._docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), r"\. "), row), "\n").alias("text"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.markdown_sections(_marked_docs(spark, sf_dir))
    return rows.withColumn("heading_path", F.array_join("heading_path", " > "))


def padded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the path of an importer: levels that are skipped are left out instead of taken."""
    rows = sections.markdown_sections(_marked_docs(spark, sf_dir), padded=True)
    return rows.select("doc_id", "ordinal", F.array_join("heading_path", " > ").alias("heading_path"), F.length("text").alias("size"))


_SQL = f"""WITH RECURSIVE sentences AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), '. ')) AS x, unnest(range(len(string_split(coalesce(text, ''), '. ')))) AS i FROM documents
), texts AS (
  SELECT doc_id, string_agg({[m[0] for m in _MARKS]}[(doc_id * 5 + i * i) % {len(_MARKS)} + 1] || x || {[m[1] for m in _MARKS]}[(doc_id * 5 + i * i) % {len(_MARKS)} + 1], chr(10) ORDER BY i) AS text FROM sentences GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM texts
), parsed AS (
  SELECT doc_id, line, x, regexp_extract(x, '^\\s{{0,3}}(`{{3,}}|~{{3,}})', 1) AS mark, length(regexp_extract(x, '^\\s{{0,3}}(#{{1,6}})[ \\t]+(.+?)(?:[ \\t]+#+[ \\t]*)?$', 1)) AS level, trim(regexp_extract(x, '^\\s{{0,3}}(#{{1,6}})[ \\t]+(.+?)(?:[ \\t]+#+[ \\t]*)?$', 2)) AS title FROM lines
), walk AS (
  SELECT doc_id, -1::BIGINT AS line, '' AS fence, 0::BIGINT AS section, 'Untitled' AS heading, 0::BIGINT AS level, CAST([] AS VARCHAR[]) AS stack, CAST([] AS VARCHAR[]) AS padded, NULL::VARCHAR AS x FROM texts
  UNION ALL
  SELECT doc_id, line, CASE WHEN mark = '' THEN fence WHEN fence = '' THEN mark WHEN starts_with(mark, fence) THEN '' ELSE fence END, CASE WHEN head THEN section + 1 ELSE section END,
    CASE WHEN head THEN title ELSE heading END, CASE WHEN head THEN new ELSE level END, CASE WHEN head THEN list_append(stack[1:new - 1], title) ELSE stack END,
    CASE WHEN head THEN list_append(padded[1:new - 1] || list_transform(range(greatest(0, new - 1 - len(padded))), lambda k: ''), title) ELSE padded END, CASE WHEN head THEN NULL ELSE x END
  FROM (SELECT w.doc_id, p.line, w.fence, w.section, w.heading, w.level, w.stack, w.padded, p.x, p.mark, p.level AS new, p.title, w.fence = '' AND p.mark = '' AND p.level > 0 AS head
    FROM walk w JOIN parsed p ON p.doc_id = w.doc_id AND p.line = w.line + 1)
), bodies AS (
  SELECT doc_id, section, any_value(heading) AS heading, any_value(level) AS level, any_value(stack) AS stack, any_value(padded) AS padded, regexp_replace(string_agg(x, chr(10) ORDER BY line), '^\\s+|\\s+$', '', 'g') AS text
  FROM walk WHERE x IS NOT NULL GROUP BY doc_id, section
), found AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS INTEGER) AS ordinal, CASE WHEN section = 0 THEN ['Untitled'] ELSE stack END AS path, CASE WHEN section = 0 THEN ['Untitled'] ELSE list_filter(padded, lambda p: p <> '') END AS wide FROM bodies WHERE text <> ''
)"""

QUERIES = {f.__name__: f for f in (markdown_sections, padded_sections)}
ORACLES = {
    "markdown_sections": f"{_SQL} SELECT doc_id, ordinal, heading, CAST(level AS INTEGER) AS level, array_to_string(path, ' > ') AS heading_path, text FROM found",
    "padded_sections": f"{_SQL} SELECT doc_id, ordinal, array_to_string(wide, ' > ') AS heading_path, CAST(length(text) AS INTEGER) AS size FROM found",
}
