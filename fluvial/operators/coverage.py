"""What a plan and its cards cover, a plan in a model's order, batches that must fit their run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvial.functions.text import letters_only


def plan_points(points: DataFrame, chunks: DataFrame, run: str = "run_id") -> DataFrame:
    """Each point (run, point_id, point_ord, section, chunk_ids, title) with grounded and duplicate.

    Grounded: all its chunks are there, in its section, and one of their texts has its title. Duplicate: a point before has the title.
    """
    key = letters_only(F.col("title"))
    asked = points.withColumn("_key", key).select(run, "point_id", "section", "_key", F.explode_outer("chunk_ids").alias("chunk_id"))
    own = chunks.select(run, "chunk_id", F.col("section").alias("_section"), letters_only(F.col("text")).alias("_text"))
    found = asked.join(own, [run, "chunk_id"], "left")
    there = F.bool_and(F.coalesce(F.col("_section").eqNullSafe(F.col("section")) & F.col("_text").isNotNull(), F.lit(False)))
    said = F.bool_or(F.coalesce((F.col("_key") != "") & F.contains("_text", "_key"), F.lit(False)))
    judged = found.groupBy(run, "point_id").agg((there & said).alias("grounded"))
    first = points.withColumn("_key", key).groupBy(run, "_key").agg(F.min("point_ord").alias("_first"))
    rows = points.withColumn("_key", key).join(judged, [run, "point_id"]).join(first, [run, "_key"])
    return rows.withColumn("duplicate", F.col("point_ord") > F.col("_first")).drop("_key", "_first")


def plan_coverage(points: DataFrame, chunks: DataFrame, run: str = "run_id") -> DataFrame:
    """For each run: chunks and sections, how many of each a grounded point covers, and points that are duplicate or invalid."""
    judged = plan_points(points, chunks, run)
    hit = judged.filter("grounded").select(run, F.explode("chunk_ids").alias("chunk_id")).distinct().withColumn("_hit", F.lit(True))
    own = chunks.select(run, "chunk_id", "section").join(hit, [run, "chunk_id"], "left")
    sections = own.groupBy(run, "section").agg(F.count("*").alias("chunks"), F.count("_hit").alias("covered"))
    of_run = sections.groupBy(run).agg(F.sum("chunks").alias("chunks"), F.sum("covered").alias("covered_chunks"), F.count("*").alias("sections"), F.count_if(F.col("covered") > 0).alias("covered_sections"))
    bad = judged.groupBy(run).agg(F.count_if("duplicate").alias("duplicate_points"), F.count_if(~F.col("grounded")).alias("invalid_points"))
    rows = of_run.join(bad, run, "left").na.fill(0, ["duplicate_points", "invalid_points"])
    return rows.withColumn("is_grounded", F.col("invalid_points") == 0)


def misplaced_cards(cards: DataFrame, points: DataFrame) -> DataFrame:
    """Cards of a point that isn't there (unknown_point) or in another section than their point (section_mismatch)."""
    rows = cards.join(points.select("point_id", F.col("section").alias("_section")), "point_id", "left")
    error = F.when(F.col("_section").isNull(), "unknown_point").when(F.col("_section") != F.col("section"), "section_mismatch")
    return rows.withColumn("error", error).filter("error is not null").drop("_section")


def generation_coverage(points: DataFrame, cards: DataFrame, run: str = "run_id", max_cards: int = 96) -> DataFrame:
    """For each run: points of high priority without a card, sections without one and with far more than most, points with several, overflow, and whether a supplement is due."""
    per_point = points.join(cards.groupBy("point_id").agg(F.count("*").alias("_n")), "point_id", "left").na.fill(0, ["_n"])
    sections = per_point.groupBy(run, "section").agg(F.sum("_n").alias("_n"), F.count_if((F.col("priority") == "high") & (F.col("_n") == 0)).alias("missing"), F.count_if(F.col("_n") > 1).alias("several"))
    average = sections.groupBy(run).agg((F.sum("_n") / F.count("*")).alias("_average"))
    sections = sections.join(average, run)
    rows = sections.groupBy(run).agg(
        F.sum("_n").alias("cards"), F.sum("missing").alias("missing_high"), F.count_if(F.col("_n") == 0).alias("uncovered_sections"),
        F.count_if(F.col("_n") > F.greatest(F.lit(2), 2 * F.col("_average"))).alias("overcovered_sections"), F.sum("several").alias("points_with_several"),
    )
    rows = rows.withColumn("overflow", F.greatest(F.lit(0), F.col("cards") - max_cards))
    return rows.withColumn("supplement", (F.col("missing_high") > 0) & (F.col("cards") < max_cards))


def supplement_points(points: DataFrame, cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points of high priority without a card of which a chunk succeeded."""
    missing = points.filter("priority = 'high'").join(cards.select("point_id").distinct(), "point_id", "left_anti")
    done = chunks.filter("state = 'succeeded'").select("chunk_id")
    ids = missing.select("point_id", F.explode("chunk_ids").alias("chunk_id")).join(done, "chunk_id", "left_semi").select("point_id").distinct()
    return missing.join(ids, "point_id", "left_semi")


def reorder(points: DataFrame, answers: DataFrame, run: str = "run_id") -> DataFrame:
    """Add new_ord: points in the order of the ids that a model gave (run, point_ids), the others after them as they stood.

    An answer that is empty, repeats an id or names one that the run has not is not followed at all. Points hold `followed`.
    """
    given = answers.select(run, F.posexplode("point_ids").alias("_rank", "point_id"))
    known = given.join(points.select(run, "point_id", F.lit(True).alias("_known")), [run, "point_id"], "left")
    right = known.groupBy(run).agg(((F.count("_known") == F.count("*")) & (F.count_distinct("point_id") == F.count("*"))).alias("followed"))
    rows = points.join(right, run, "left").withColumn("followed", F.coalesce("followed", F.lit(False)))
    ranks = given.groupBy(run, "point_id").agg(F.min("_rank").alias("_rank"))
    rows = rows.join(ranks, [run, "point_id"], "left").withColumn("_rank", F.when(F.col("followed"), F.col("_rank")))
    order = Window.partitionBy(run).orderBy(F.col("_rank").asc_nulls_last(), "point_ord")
    return rows.withColumn("new_ord", (F.row_number().over(order) - 1).cast("int")).drop("_rank")


def partition_errors(batches: DataFrame, chunks: DataFrame, calls: DataFrame, run: str = "run_id") -> DataFrame:
    """Each run's first fault of its batches (batch, place, chunk_id): no_batches, too_many_batches (more than remaining calls), not_in_order; null if they part its chunks in order."""
    w = Window.partitionBy(run).orderBy("batch", "place")
    given = batches.withColumn("_n", F.row_number().over(w)).select(run, "batch", "_n", "chunk_id")
    own = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy("chunk_ord"))).select(run, "_n", F.col("chunk_id").alias("_own"))
    both = own.join(given, [run, "_n"], "full").groupBy(run).agg(F.count_distinct("batch").alias("batches"), F.bool_and(F.col("chunk_id").eqNullSafe(F.col("_own"))).alias("_same"))
    rows = both.join(calls.select(run, "remaining_calls"), run, "left")
    error = F.when(F.col("batches") == 0, "no_batches").when(F.col("batches") > F.coalesce("remaining_calls", F.lit(0)), "too_many_batches").when(~F.col("_same"), "not_in_order")
    return rows.select(run, "batches", error.alias("error"))
