"""What a document, a chunk or a batch is shown as: plain points, spans, sizes, summary lines, flagged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.text import clean


def plain_points(chunks: DataFrame) -> DataFrame:
    """A point of each chunk with a text: title (its last heading that isn't blank, else Untitled), explanation, evidence, importance."""
    heads = F.filter(F.transform(F.coalesce("heading_path", F.array().cast("array<string>")), clean), lambda h: h != "")
    rows = chunks.withColumn("explanation", clean(F.col("text"))).filter("explanation <> ''")
    return rows.withColumns({"title": F.coalesce(F.try_element_at(heads, F.lit(-1)), F.lit("Untitled")), "evidence": F.col("explanation"), "importance": F.lit("medium")}).drop("text")


def span(document: Column, blocks: Column, places: Column) -> Column:
    """struct(kind, value) of a chunk: its only place, if it has one; without any, its only block; else the document.

    places: structs of kind and value, each once (`unique_places`); a place that is the document names the document.
    """
    at = lambda kind, value: F.struct(kind.alias("kind"), value.cast("string").alias("value"))
    whole, one = at(F.lit("document"), document), F.get(places, 0)
    return F.when((F.size(places) == 1) & (one["kind"] != "document"), at(one["kind"], one["value"])).when((F.size(places) == 0) & (F.size(blocks) == 1), at(F.lit("block"), F.get(blocks, 0))).otherwise(whole)


def unique_places(places: Column) -> Column:
    """Places in their order, each once, without nulls."""
    return F.array_distinct(F.array_compact(places))


def text_chars(documents: DataFrame, blocks: DataFrame, key: str, shown: list[str]) -> DataFrame:
    """key, text_chars: characters of a document's blocks and of its columns `shown`."""
    own = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in shown), F.lit(0)).cast("long")
    sums = blocks.groupBy(key).agg(F.sum(F.length("text")).alias("_n"))
    return documents.select(key, own.alias("_own")).join(sums, key, "left").select(key, (F.col("_own") + F.coalesce("_n", F.lit(0))).alias("text_chars"))


def summary_line(sections: Column, blocks: Column, characters: Column) -> Column:
    """`1 section · 2 blocks · 30 characters`."""
    part = lambda n, word: F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, word).otherwise(word + "s"))
    return F.concat_ws(" · ", part(sections, "section"), part(blocks, "block"), part(characters, "character"))


def warning_count(*warnings: Column) -> Column:
    return sum((F.size(F.coalesce(w, F.array().cast("array<string>"))) for w in warnings), F.lit(0))


def batch_estimate(estimates: DataFrame, batch: str, card_limit: Column) -> DataFrame:
    """Documents, chunks and the range of cards of each batch and level, within a limit (null: none)."""
    sums = estimates.groupBy(batch, "level").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.sum("card_min").alias("low"), F.sum("card_max").alias("high"))
    held = lambda c: F.least(F.col(c), card_limit)  # noqa: E731 - least passes over nulls
    return sums.select(batch, "level", "documents", "chunks", held("low").cast("long").alias("card_min"), held("high").cast("long").alias("card_max"))


def without_flagged(rows: DataFrame, key: str, flag: Column, invert: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that aren't flagged (with invert: those that are), and for each key how many went."""
    hit = F.coalesce(flag, F.lit(False))
    goes = ~hit if invert else hit
    return rows.filter(~goes), rows.groupBy(key).agg(F.count_if(goes).alias("removed"))


def padded(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows with the extra columns of their key, null where there are none."""
    return rows.join(extra, key, "left")


def first_rows(rows: DataFrame, order: str, most: int = 20) -> DataFrame:
    """The first rows in an order: what a style is read from."""
    return rows.orderBy(order).limit(most)


def in_file_order(files: list[DataFrame], section: str = "section_id") -> DataFrame:
    """Documents' rows one file after the other (file_ord), with section ids that no two files share."""
    out = None
    for n, df in enumerate(files):
        part = df.withColumn("file_ord", F.lit(n)).withColumn(section, F.substring(F.sha2(F.concat_ws("\x1f", F.lit(str(n)), F.col(section).cast("string")), 256), 1, 16))
        out = part if out is None else out.unionByName(part)
    return out
