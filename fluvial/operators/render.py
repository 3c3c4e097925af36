"""Blocks back to texts: plain, Markdown, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(blocks: DataFrame, key: str, part: Column, within: str) -> DataFrame:
    """The parts of each section in block order, then the sections in order; null parts are left out.

    The arrays are no larger than the document that the blocks were cut from.
    """
    rows = blocks.select(key, "section_ord", "block_ord", part.alias("part")).filter("part is not null")
    sections = rows.groupBy(key, "section_ord").agg(F.array_sort(F.collect_list(F.struct("block_ord", "part"))).alias("parts"))
    texts = sections.select(key, "section_ord", F.array_join(F.transform("parts", lambda x: x["part"]), within).alias("part"))
    whole = texts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_ord", "part"))).alias("parts"))
    return whole.select(key, F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("text"))


def _own_heading() -> Column:
    return (F.col("kind") == "heading") & F.col("text").eqNullSafe(F.col("heading"))


def plain_text(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): blocks by lines, sections by blank lines. A section's heading is told only where it comes first."""
    first = F.min("block_ord").over(_section(key))
    return _joined(blocks.withColumn("_first", first), key, F.when(~_own_heading() | (F.col("block_ord") == F.col("_first")), F.col("text")), "\n")


def _section(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key, "section_ord")


def markdown(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) as Markdown; each section opens with its heading at the depth of its path, 6 at most."""
    text, language = F.coalesce("text", F.lit("")), F.coalesce("language", F.lit("")) if "language" in blocks.columns else F.lit("")
    bare = blocks.filter(~_own_heading())
    part = (
        F.when(F.col("kind") == "code", F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```")))
        .when(F.col("kind") == "quote", F.regexp_replace(text, "(?m)^", "> "))
        .when(F.col("kind") == "list_item", F.concat(F.lit("- "), text))
        .when(F.col("kind") == "formula", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .when(F.col("kind") == "heading", F.concat(F.lit("## "), text))
        .otherwise(text)
    )
    level = F.least(F.greatest(F.size("heading_path"), F.lit(1)), F.lit(6))
    opening = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("heading"))
    heads = blocks.filter(F.length("heading") > 0).groupBy(key, "section_ord").agg(F.first(opening).alias("part"), (F.min("block_ord") - 1).alias("block_ord"))
    rows = bare.select(key, "section_ord", "block_ord", part.alias("part")).unionByName(heads.select(key, "section_ord", "block_ord", "part"))
    return _joined(rows, key, F.col("part"), "\n\n")


def summary(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section_count, block_count, characters, blocks_by_kind), the kinds in order."""
    kinds = blocks.groupBy(key, "kind").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("characters"))
    sections = blocks.select(key, "section_ord").distinct().groupBy(key).agg(F.count("*").alias("section_count"))
    per = kinds.groupBy(key).agg(F.sum("n").alias("block_count"), F.sum("characters").alias("characters"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("blocks_by_kind"))
    return sections.join(per, key)
