"""First-line headings of YAML, reStructuredText, Org and LaTeX texts; the rest is paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.sources import islands

# The heading of each type, on the first line or, where it is underlined, the first two; and lines it takes.
HEADINGS = {
    "yaml": (r"(?i)\A\s*title\s*:[ \t]*['\"]*([^\n]+?)['\"]*[ \t]*(?:\n|\z)", 1),
    "rst": (r"\A[ \t]*([^\n]*?)[ \t]*\n[ \t]*[=~-]{3,}[ \t]*(?:\n|\z)", 2),
    "org": (r"\A\*+[ \t]+([^\n]+?)[ \t]*(?:\n|\z)", 1),
    "latex": (r"\A[ \t]*\\(?:part|chapter|section|subsection)\{([^{}\n]+)\}", 1),
}


def blocks(docs: DataFrame, source_type: str, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, block_ord, kind, text, line_start, line_end), a heading first where there is one. Other types have paragraphs alone."""
    pattern, taken = HEADINGS.get(source_type, (r"\A\z()", 0))
    text = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\r\n?", "\n")
    rows = docs.select(key, text.alias("_text")).withColumn("_heading", F.regexp_extract("_text", pattern, 1))
    # the lines of the heading stay as blank ones, so line numbers hold
    rest = F.when(F.col("_heading") != "", F.concat(F.repeat(F.lit("\n"), F.lit(taken)), F.regexp_replace("_text", r"\A(?:[^\n]*(?:\n|\z)){%d}" % taken, ""))).otherwise(F.col("_text"))
    found = islands.blocks(rows.select(F.struct(key, (F.col("_heading") != "").alias("more")).alias("_key"), rest.alias("_rest")), "paragraph", "_key", "_rest")
    body = found.select(F.col("_key")[key].alias(key), (F.col("block_ord") + F.col("_key.more").cast("int")).alias("block_ord"), "kind", "text", "line_start", "line_end")
    heads = rows.filter("_heading <> ''").select(key, F.lit(0).alias("block_ord"), F.lit("heading").alias("kind"), F.col("_heading").alias("text"), F.lit(1).alias("line_start"), F.lit(taken).alias("line_end"))
    return heads.unionByName(body)
