"""Cards by what their points say: the mode that judges them, where they come from, and drafts with a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.text import casefolded
from fluvial.operators.answered_plans import TEMPLATES
from fluvial.staging import discard, join_skewed, materialize


def effective_modes(cards: DataFrame, points: DataFrame, mode: Column, modes: tuple[str, ...] = TEMPLATES, key: str = "point_id") -> DataFrame:
    """Add mode: the wanted one, unless that is `auto`; then the template of the card's point, or `concept` where no point or no known template is found.

    points: key and recommended_template, one row a point. Many cards may have one point.
    """
    rows = materialize(cards.withColumn("_wanted", mode), "moded_cards")
    found = join_skewed(rows, points.select(key, F.col("recommended_template").alias("_own")), [key], ["_wanted"] + [c for c in cards.columns if c != key], "left")
    own = F.when(F.col("_own").isin(*modes), F.col("_own")).otherwise("concept")
    return found.withColumn("mode", F.when(F.col("_wanted") == "auto", own).otherwise(F.col("_wanted"))).drop("_wanted", "_own").select(*cards.columns, "mode")


def point_spans(points: DataFrame, chunks: DataFrame, batch_id: str) -> DataFrame:
    """point_id, chunks, document_id, source_label and chunk_id of each point (point_id, chunk_ids).

    chunks: chunk_id, document_id, source_label. A point of one chunk that is there has its place; one of several has
    their document, if they share one, else (and without any) the batch as `Imported material`.
    """
    rows = points.select("point_id", F.posexplode_outer("chunk_ids").alias("pos", "chunk_id"))
    rows = materialize(rows, "point_chunks")
    found = join_skewed(rows, chunks.select("chunk_id", "document_id", "source_label", F.lit(True).alias("there")), ["chunk_id"], ["point_id"], "left")
    sums = found.groupBy("point_id").agg(F.count("there").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.min("document_id").alias("document_id"), F.min("source_label").alias("label"), F.max(F.when(F.col("there"), F.col("chunk_id"))).alias("chunk_id"))
    one = F.col("documents") == 1
    return sums.select("point_id", "chunks", F.when(one, F.col("document_id").cast("string")).otherwise(batch_id).alias("document_id"), F.when(one, F.col("label")).otherwise("Imported material").alias("source_label"), F.when(F.col("chunks") == 1, F.col("chunk_id")).alias("chunk_id"))


def located_drafts(cards: DataFrame, locations: DataFrame, key: str = "point_id") -> DataFrame:
    """Cards with a front, a back and an excerpt that aren't blank, with the location of their point, or null.

    locations: key and location, one row a point; cards: ord and the texts. draft counts all cards from 1, by ord, blank ones too.
    """
    from fluvial.staging import number_within

    numbered = materialize(number_within(cards.withColumn("_all", F.lit(0)), "_all", ["ord"], "_n").drop("_all"), "numbered_cards")
    said = [F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S") for c in ("front", "back", "source_excerpt")]
    found = join_skewed(numbered, locations.select(key, "location"), [key], ["ord"], "left").filter(said[0] & said[1] & said[2])
    return found.withColumn("draft", F.concat(F.lit("universal-"), (F.col("_n") + 1).cast("string"))).drop("_n")


def retained(cards: DataFrame, accepted: DataFrame, key: str = "candidate_id") -> DataFrame:
    """The cards of succeeded chunks whose id was accepted, and all cards of other chunks (state)."""
    ids = accepted.select(key).distinct().withColumn("_kept", F.lit(True))
    found = cards.join(ids, key, "left")
    return found.filter(F.coalesce("_kept", F.lit(False)) | ~F.coalesce(F.col("state") == "succeeded", F.lit(False))).select(*cards.columns)


def targets(options: DataFrame, kind: str) -> DataFrame:
    """Places to write to, numbered by name without case, then by id: kind, position, id, name. A small table of a collection's own."""
    from pyspark.sql import Window

    rows = materialize(options.select("id", "name"), "options")
    place = F.row_number().over(Window.orderBy(casefolded(F.col("name")), "id")) - 1
    out = materialize(rows.select(F.lit(kind).alias("kind"), place.alias("position"), "id", "name"), "targets")
    discard(rows)
    return out
