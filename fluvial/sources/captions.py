"""SRT and VTT captions to transcript blocks, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.sources import islands

# The line of a caption's times; seconds between captions of one block.
TIMING = r"(\d{1,2}:\d{2}(?::\d{2})?[,.]\d{3})\s*-->\s*(\d{1,2}:\d{2}(?::\d{2})?[,.]\d{3})"
GAP = 1.0


def seconds(clock: Column) -> Column:
    """h:mm:ss.mmm or mm:ss,mmm as seconds."""
    parts = F.split(F.replace(clock, F.lit(","), F.lit(".")), ":")
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x.cast("double"))


def captions(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, caption_ord, start, end, text, line_start, line_end): the lines below the first times in a run of lines."""
    runs = islands.blocks(docs.select(key, column), "code", key, column)
    lines = F.split("text", "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(TIMING)), F.lit(True)).cast("int")
    rows = runs.withColumn("lines", lines).withColumn("at", at).filter("at > 0 and at < size(lines)")
    timing = F.element_at("lines", F.col("at"))
    body = F.transform(F.slice("lines", F.col("at") + 1, F.size("lines")), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return rows.select(
        key, F.col("block_ord").alias("caption_ord"), seconds(F.regexp_extract(timing, TIMING, 1)).alias("start"), seconds(F.regexp_extract(timing, TIMING, 2)).alias("end"),
        F.array_join(body, "\n").alias("text"), (F.col("line_start") + F.col("at") - 1).alias("line_start"), "line_end",
    )


def blocks(docs: DataFrame, column: str = "text", key: str = "doc_id", gap: float = GAP) -> DataFrame:
    """(key, block_ord, kind, text, start, end, line_start, line_end): captions that follow within the gap, as one."""
    w = Window.partitionBy(key).orderBy("caption_ord")
    new = F.col("start") - F.lag("end").over(w) > gap
    rows = captions(docs, column, key).withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    rows = rows.withColumn("block_ord", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    own = F.array_sort(F.collect_list(F.struct("caption_ord", "text")))
    return rows.groupBy(key, "block_ord").agg(
        F.lit("transcript").alias("kind"), F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"),
        F.min("start").alias("start"), F.max_by("end", "caption_ord").alias("end"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"),
    )
