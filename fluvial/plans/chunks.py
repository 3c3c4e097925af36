"""Queries of the chunker, and the same in SQL: greedy packing and text cuts as recursive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.operators import chunking
from fluvial.plans import queries as base

#: Kinds of blocks by their number; a block of over 1,000 characters is no table.
_KINDS = "paragraph paragraph code list_item list_item paragraph formula paragraph paragraph list_item paragraph paragraph paragraph code code paragraph transcript list_item list_item list_item table paragraph table table paragraph paragraph paragraph quote".split()


def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents as blocks of several kinds, in sections of 60 and on pages of 45; every third section has no heading."""
    rows = base.paragraphs(spark, sf_dir).join(base._docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), ((F.col("doc_id") + F.col("block_ord")) % len(_KINDS) + 1).cast("int"))
    section = F.floor(F.col("block_ord") / 60).cast("int")
    path = F.when(section % 3 == 2, F.array().cast("array<string>")).otherwise(F.array(F.col("source"), F.lit("/tmp/x"), F.concat(F.lit(" Part "), section.cast("string")), F.lit("a/../b")))
    return rows.select("doc_id", section.alias("section_ord"), F.lit(None).cast("string").alias("heading"), path.alias("heading_path"), "block_ord", F.when((kind == "table") & (F.length("text") > 1000), "paragraph").otherwise(kind).alias("kind"), "text", F.floor(F.col("block_ord") / 45).cast("int").alias("page"))


def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.structural_chunks(chunk_blocks(spark, sf_dir), target=600, most=1200, place=("page",))
    joined = {"heading_path": F.array_join("heading_path", " > "), "block_ords": F.array_join(F.transform("block_ords", lambda x: x.cast("string")), ","), "block_kinds": F.array_join("block_kinds", ",")}
    return rows.withColumns(joined)


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.text_chunks(base._docs(spark, sf_dir), 600, 1200)


def _end(rest: str, target: str, most: str) -> str:
    """SQL: where the first piece of a text ends, in characters."""
    behind = []
    for low, size in ((f"greatest(1, {target} // 2)", f"{target} - greatest(1, {target} // 2)"), (target, f"{most} - {target}")):
        window = f"substr({rest}, {low} + 1, {size})"
        for separator in ("chr(10) || chr(10)", "chr(10)", "'. '", "'。'", "'; '", "'；'", "' '"):
            found = f"instr(reverse({window}), reverse({separator}))"
            behind.append(f"CASE WHEN {found} > 0 THEN {low} + length({window}) - {found} + 1 END")
    return f"CASE WHEN length({rest}) <= {most} THEN length({rest}) ELSE coalesce({', '.join(behind)}, {target}) END"


def _cuts_sql(source: str) -> str:
    """SQL: cut(id, k, start, piece) of source's (id, txt, target, most)."""
    return f"""cut_at AS (
  SELECT id, 0 AS k, 0 AS start, txt AS rest, target, most, {_end("txt", "target", "most")} AS stop FROM {source}
  UNION ALL
  SELECT id, k + 1, start + stop, tail, target, most, {_end("tail", "target", "most")} FROM (SELECT *, substr(rest, stop + 1) AS tail FROM cut_at WHERE length(rest) > stop)
), cut AS (SELECT id, k, start, substr(rest, 1, stop) AS piece FROM cut_at)"""


_TEXTS = f"""WITH RECURSIVE given AS (SELECT doc_id AS id, coalesce(text, '') AS txt, 600 AS target, 1200 AS most FROM documents), {_cuts_sql("given")}
SELECT id AS doc_id, CAST(k AS INTEGER) AS sequence, CAST(start AS INTEGER) AS start, piece AS text FROM cut"""

_STRUCTURE = f"""WITH RECURSIVE {base._PARAGRAPHS.lstrip()}, numbered AS (
  SELECT doc_id, block_ord // 60 AS section_ord, block_ord, blocks.text AS text, block_ord // 45 AS page, source, {_KINDS}[(doc_id + block_ord) % {len(_KINDS)} + 1] AS kind FROM blocks JOIN documents USING (doc_id)
), kinds AS (
  SELECT * REPLACE (CASE WHEN kind = 'table' AND length(text) > 1000 THEN 'paragraph' ELSE kind END AS kind), CASE WHEN section_ord % 3 = 2 THEN '' ELSE concat_ws(' > ', trim(source), 'Part ' || section_ord) END AS path FROM numbered
), begun AS (
  SELECT *, CASE WHEN path = '' THEN '' ELSE '# ' || path || chr(10) || chr(10) END AS head, CASE WHEN (kind = 'list_item' AND lag(kind) OVER w = 'list_item') OR (kind IN ('code', 'formula') AND lag(kind) OVER w = 'paragraph') THEN 0 ELSE 1 END AS begins
  FROM kinds WINDOW w AS (PARTITION BY doc_id, section_ord ORDER BY block_ord)
), inside AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id, section_ord ORDER BY block_ord) AS unit FROM begun
), units AS (
  SELECT doc_id, section_ord, unit, any_value(head) AS head, any_value(path) AS path, string_agg(text, chr(10) || chr(10) ORDER BY block_ord) AS text, arg_min(page, block_ord) AS page, list(kind ORDER BY block_ord) AS ks, list(text ORDER BY block_ord) AS ts,
    string_agg(block_ord, ',' ORDER BY block_ord) AS ords FROM inside GROUP BY doc_id, section_ord, unit
), sized AS (
  SELECT *, length(text) AS n, list_contains(ks, 'table') OR length(text) > 1200 - length(head) AS alone, greatest(1, 600 - length(head)) AS target, 1200 - length(head) AS most FROM units
), packed AS (
  SELECT doc_id, section_ord, unit, 1 AS chunk, n AS used, alone, page FROM sized WHERE unit = 1
  UNION ALL
  SELECT doc_id, section_ord, unit, CASE WHEN fresh THEN chunk + 1 ELSE chunk END, CASE WHEN fresh THEN n ELSE used + 2 + n END, alone, page FROM (
    SELECT s.doc_id, s.section_ord, s.unit, p.chunk, p.used, s.n, s.alone, s.page, s.alone OR p.alone OR s.page <> p.page OR p.used + 2 + s.n > s.target AS fresh
    FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.section_ord = p.section_ord AND s.unit = p.unit + 1)
), chunks AS (
  SELECT p.doc_id, p.section_ord, p.chunk, any_value(head) AS head, any_value(path) AS path, string_agg(text, chr(10) || chr(10) ORDER BY p.unit) AS text, string_agg(ords, ',' ORDER BY p.unit) AS block_ords,
    string_agg(array_to_string(ks, ','), ',' ORDER BY p.unit) AS block_kinds, bool_or(n > most) AS large, any_value(target) AS target, any_value(most) AS most, any_value(ks) AS ks, any_value(ts) AS ts
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.section_ord = p.section_ord AND s.unit = p.unit GROUP BY p.doc_id, p.section_ord, p.chunk
), large AS (
  SELECT *, CASE WHEN len(ks) = 2 AND ks[1] = 'paragraph' AND length(ts[1]) + 2 < most THEN ts[1] || chr(10) || chr(10) ELSE '' END AS context FROM chunks WHERE large
), given AS (
  SELECT (doc_id, section_ord, chunk) AS id, substr(text, length(context) + 1) AS txt, greatest(1, target - length(context)) AS target, most - length(context) AS most FROM large
), {_cuts_sql("given")}, pieces AS (
  SELECT doc_id, section_ord, chunk, 0 AS k, path, head || text AS text, block_ords, block_kinds FROM chunks WHERE NOT large
  UNION ALL
  SELECT doc_id, section_ord, chunk, k, path, head || context || piece, block_ords, block_kinds FROM large JOIN cut ON id = (doc_id, section_ord, chunk)
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_ord, chunk, k) - 1 AS sequence, count(*) OVER (PARTITION BY doc_id) AS total FROM pieces
)
SELECT doc_id, CAST(section_ord AS INTEGER) AS section_ord, path AS heading_path, text, block_ords, block_kinds, CASE WHEN total > 48 THEN 'too_many_chunks' END AS error, CAST(sequence AS INTEGER) AS sequence,
  'chunk-' || substr(sha256(concat_ws(chr(31), doc_id, section_ord, sequence, replace(block_ords, ',', chr(31)))), 1, 16) AS chunk_id FROM rows"""

QUERIES = {f.__name__: f for f in (structural_chunks, text_chunks)}
ORACLES = {"structural_chunks": _STRUCTURE, "text_chunks": _TEXTS}
