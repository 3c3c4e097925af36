"""A run's chunks, reviews and versions after answers have come: merges, verdicts, repairs, free slots, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# So many cards a run may have, by what was asked for; so many repairs a level makes.
CARD_LIMITS = {"auto": 5, "fewer": 3, "balanced": 5, "more": 8}
REPAIRS = {"fast": 0, "standard": 1}
ERROR_CODE = r"^[a-z][a-z0-9_]{0,119}$"


def card_limit(asked: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in CARD_LIMITS.items() for x in kv)), F.coalesce(asked, F.lit("auto")))


def merge_answers(chunks: DataFrame, answers: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Pending chunks with the state, reason and cards that their answer (error_code, cards, valid) gives them; chunks of other states stay.

    A chunk without an answer has generation_result_missing; an answer with an error keeps its code, if it is one, and one
    that isn't valid has generation_output_invalid.
    """
    given = answers.select(key, F.struct("error_code", "cards", "valid").alias("_a"))
    rows = chunks.join(given, key, "left")
    code = F.col("_a.error_code")
    failed = F.when(F.col("_a").isNull(), "generation_result_missing").when(code.isNotNull(), F.when(code.rlike(ERROR_CODE), code).otherwise("generation_output_invalid")).when(~F.coalesce("_a.valid", F.lit(False)), "generation_output_invalid")
    pending = F.col("state") == "pending"
    rows = rows.withColumn("reason", F.when(pending, failed))
    return rows.withColumn("cards", F.when(pending & F.col("reason").isNull(), F.col("_a.cards")).otherwise(0)).withColumn("state", F.when(pending, F.when(F.col("reason").isNull(), "succeeded").otherwise("failed")).otherwise(F.col("state"))).drop("_a")


def verdicts(cards: DataFrame, output: DataFrame, run: str = "run_id", key: str = "candidate_id") -> DataFrame:
    """Each card (run, ord) with the verdict of its run's critic and an error.

    output: run, shape (`one`: a verdict for all; `by_id`; `list`: in the cards' order), id, place, verdict. A list of another length than the
    run's cards is an error, critic_result_count, and no verdict counts.
    """
    rows = cards.withColumn("_place", F.row_number().over(Window.partitionBy(run).orderBy("ord")) - 1)
    sizes = rows.groupBy(run).agg(F.count("*").alias("_cards"))
    shapes = output.groupBy(run).agg(F.min("shape").alias("_shape"), F.count("*").alias("_given"), F.min(F.when(F.col("shape") == "one", F.col("verdict"))).alias("_all"))
    rows = rows.join(sizes, run).join(shapes, run, "left")
    by_id = output.filter("shape = 'by_id'").select(run, F.col("id").alias(key), F.col("verdict").alias("_by_id"))
    by_place = output.filter("shape = 'list'").select(run, F.col("place").alias("_place"), F.col("verdict").alias("_by_place"))
    rows = rows.join(by_id, [run, key], "left").join(by_place, [run, "_place"], "left")
    error = F.when((F.col("_shape") == "list") & (F.col("_cards") != F.col("_given")), "critic_result_count")
    verdict = F.when(F.col("_shape") == "one", F.col("_all")).when(F.col("_shape") == "by_id", F.col("_by_id")).when(error.isNull(), F.col("_by_place"))
    return rows.withColumns({"verdict": verdict, "error": error}).drop("_place", "_cards", "_shape", "_given", "_all", "_by_id", "_by_place")


def repairs(cards: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Cards (run, point_id, ord, action) of action `repair` with `repaired`: a fast run repairs none, a standard one its first, a deep one the first of each point, as its calls (remaining_calls) last."""
    rows = cards.filter("action = 'repair'").join(runs.select(run, "level", "remaining_calls"), run)
    first = F.row_number().over(Window.partitionBy(run, "point_id").orderBy("ord")) == 1
    rows = rows.withColumn("_first", first)
    turn = F.sum(F.col("_first").cast("int")).over(Window.partitionBy(run).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    most = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in REPAIRS.items() for x in kv)), F.col("level")), F.col("remaining_calls"))
    return rows.withColumn("repaired", F.col("_first") & (turn <= F.least(most, F.col("remaining_calls")))).drop("_first", "level", "remaining_calls")


def fill_slots(additions: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Additions (run, ord, action) that pass and find one of the run's free slots (card_limit - cards), in order."""
    rows = additions.filter("action in ('pass', 'flag')").join(runs.select(run, F.greatest(F.lit(0), F.col("card_limit") - F.col("cards")).alias("_free")), run)
    turn = F.row_number().over(Window.partitionBy(run).orderBy("ord"))
    return rows.withColumn("_turn", turn).filter("_turn <= _free").drop("_turn", "_free")


def review_versions(edits: DataFrame, key: str = "card_id") -> DataFrame:
    """The last version of each card from its edits (ord, kind, front, back): revision (edits and restores so far), text and decision.

    kind: `create` sets the text, `edit` replaces it, `restore` brings the first back (both reset the decision to pending), `keep` and `discard` decide.
    """
    text = F.struct("front", "back")
    changed = F.col("kind").isin("edit", "restore")
    order = F.struct("ord")
    rows = edits.groupBy(key).agg(
        F.count_if(changed).alias("revision"),
        F.min_by(F.when(F.col("kind") == "create", text), F.when(F.col("kind") == "create", F.col("ord"))).alias("_created"),
        F.max_by(F.struct("kind", text.alias("text")), F.when(F.col("kind").isin("create", "edit", "restore"), F.col("ord"))).alias("_last"),
        F.max_by(F.col("kind"), order).alias("_decision"),
    )
    now = F.when(F.col("_last.kind") == "restore", F.col("_created")).otherwise(F.col("_last.text"))
    decision = F.when(F.col("_decision") == "keep", "kept").when(F.col("_decision") == "discard", "discarded").otherwise("pending")
    return rows.select(key, "revision", now["front"].alias("front"), now["back"].alias("back"), decision.alias("decision"))


def write_readiness(sessions: DataFrame) -> DataFrame:
    """Add ready: generation and review complete, a card kept, and the duplicate check as new as candidates, target and mapping."""
    current = (F.col("checked_candidate_revision") == F.col("candidate_revision")) & (F.col("checked_target_revision") == F.col("target_revision")) & (F.col("checked_mapping_revision") == F.col("mapping_revision"))
    ready = (F.col("generation") == "complete") & (F.col("review") == "complete") & (F.col("kept") > 0) & (F.col("write") == "current") & current & ~F.col("closed")
    return sessions.withColumn("ready", F.coalesce(ready, F.lit(False)))
