"""Selected points, candidates and their gates, reviews, what may be written and what was. Ids never stand in order: rows meet by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decisions of a reviewer, and what each state of a write leads to.
DECISIONS = ("pending", "approved", "rejected", "needs_edit")
PLAN_STATUS = {"eligible": "ready_preview", "blocked": "blocked", "needs_review": "needs_review", "unknown": "unknown"}
FINAL_STATUS = {"ready_preview": "ready_for_future_confirmation", "blocked": "blocked", "needs_review": "needs_review", "unknown": "unknown"}
MISSING = ("no_candidates", "review_incomplete", "deck_missing", "note_type_missing", "mapping_incomplete", "duplicate_check_incomplete")


def _first(**cases: Column) -> Column:
    """An array of the names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in cases.items())))


def _mapped(table: dict[str, str], value: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), value)


def unknown_ids(selected: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Selected ids that no row has: an error, if there are any."""
    return selected.select(key).distinct().join(known.select(key), key, "left_anti")


def select_points(points: DataFrame, selected: DataFrame, key: str = "point_id") -> DataFrame:
    """The points of the selected ids, once each; `unknown_ids` tells those that no point has."""
    return points.join(selected.select(key).distinct(), key, "left_semi")


def candidates(selections: DataFrame) -> DataFrame:
    """A candidate for each selection whose decision is `selected`: front, back, extra from title, explanation, evidence, source."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return selections.filter("decision = 'selected'").select(
        F.concat(F.lit("card_"), F.col("selection_id").cast("string")).alias("candidate_id"), "selection_id", F.lit("basic").alias("card_type"),
        F.concat(F.lit("What is "), text("title"), F.lit("?")).alias("front"), text("explanation").alias("back"),
        F.concat(F.lit("Evidence: "), text("evidence"), F.lit("\nSource: "), text("source")).alias("extra"),
    )


def with_states(rows: DataFrame, quality: DataFrame, reviews: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Add quality_status, review_status, approval_allowed, write_allowed and reasons.

    quality: errors and warnings (counts) by key, reviews: decision by key; a candidate may lack either.
    """
    found = rows.join(quality.select(key, "errors", "warnings"), key, "left").join(reviews.select(key, "decision"), key, "left")
    status = F.when(F.col("errors").isNull(), "unchecked").when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed")
    found = found.withColumns({"quality_status": status, "review_status": F.coalesce("decision", F.lit("unreviewed"))}).drop("errors", "warnings", "decision")
    allowed = F.col("quality_status").isin("passed", "warning")
    q, r = F.col("quality_status"), F.col("review_status")
    reasons = _first(quality_unchecked=q == "unchecked", quality_failed=q == "failed", review_missing=r == "unreviewed", review_not_approved=~r.isin("unreviewed", "approved"))
    return found.withColumns({"approval_allowed": allowed, "write_allowed": allowed & (r == "approved"), "reasons": reasons})


def allowed_decisions(approval_allowed: Column) -> Column:
    return F.filter(F.array(*map(F.lit, DECISIONS)), lambda d: (d != "approved") | F.coalesce(approval_allowed, F.lit(False)))


def eligibility(rows: DataFrame, valid: Column) -> DataFrame:
    """Add eligibility_status, blocking_reasons, plan_status and final_status from quality_status, review_status and local validity."""
    q, r = F.col("quality_status"), F.col("review_status")
    approved = F.when(valid, "eligible").otherwise("blocked")
    status = F.when(r == "approved", approved).when(r == "pending", "needs_review").when(r.isin("rejected", "needs_edit"), "blocked").otherwise("unknown")
    reasons = _first(quality_failed=q == "failed", quality_unchecked=q == "unchecked", local_review_invalid=(r == "approved") & ~valid, review_pending=r == "pending", review_rejected=r == "rejected", review_needs_edit=r == "needs_edit")
    rows = rows.withColumns({"eligibility_status": status, "blocking_reasons": F.when(status.isin("eligible", "unknown"), F.array().cast("array<string>")).otherwise(reasons)})
    rows = rows.withColumn("plan_status", _mapped(PLAN_STATUS, F.col("eligibility_status")))
    return rows.withColumn("final_status", _mapped(FINAL_STATUS, F.col("plan_status")))


def reviews(candidate_rows: DataFrame, results: DataFrame, key: str = "candidate_id") -> DataFrame:
    """A review row for each candidate and its gate result (passed, decision); what doesn't fit is an error: no_result, no_candidate, bad_decision, failed_but_approved."""
    found = candidate_rows.withColumn("_own", F.lit(True)).join(results.withColumn("_given", F.lit(True)), key, "full")
    decision = F.coalesce("decision", F.lit("pending"))
    error = F.when(F.col("_given").isNull(), "no_result").when(F.col("_own").isNull(), "no_candidate")
    error = error.when(~decision.isin(*DECISIONS), "bad_decision").when((decision == "approved") & ~F.col("passed"), "failed_but_approved")
    return found.withColumns({"decision": decision, "error": error}).drop("_own", "_given")


def discard_blocking(rows: DataFrame) -> DataFrame:
    """Blocked cards are discarded, whatever was decided."""
    return rows.withColumn("decision", F.when(F.col("status") == "blocked", "discarded").otherwise(F.col("decision")))


def keep_clean(rows: DataFrame) -> DataFrame:
    """Ready cards that are pending are kept."""
    return rows.withColumn("decision", F.when((F.col("decision") == "pending") & (F.col("status") == "ready"), "kept").otherwise(F.col("decision")))


def review_stats(rows: DataFrame, key: str) -> DataFrame:
    """Cards by decision and by status for each key."""
    counts = {"total": F.count("*")} | {d: F.count_if(F.col("decision") == d) for d in ("pending", "kept", "discarded")} | {"warning": F.count_if(F.col("status") == "review"), "blocking": F.count_if(F.col("status") == "blocked")}
    return rows.groupBy(key).agg(*(c.alias(n) for n, c in counts.items()))


def run_summary(key: str, **tables: DataFrame) -> DataFrame:
    """Counts of a run's steps by key, in one aggregation over all tables: chunks, points, selections, candidates, quality (passed), reviews (decision)."""
    none = F.lit(None).cast("string")
    what = {"selections": F.col("decision"), "reviews": F.col("decision"), "quality": F.when(F.col("passed"), "passed").otherwise("failed")}
    rows = None
    for name, df in tables.items():
        part = df.select(key, F.lit(name).alias("step"), what.get(name, none).alias("state") if name in what else none.alias("state"))
        rows = part if rows is None else rows.unionByName(part)
    n = lambda step, state=None: F.count_if((F.col("step") == step) & (F.lit(True) if state is None else F.col("state") == state))
    counts = {f"{s}_count": n(s) for s in ("chunks", "points", "selections")} | {f"{d}_count": n("selections", d) for d in ("selected", "rejected", "deferred")}
    counts |= {"candidates_count": n("candidates"), "quality_passed_count": n("quality", "passed"), "quality_failed_count": n("quality", "failed"), "reviews_count": n("reviews")}
    counts |= {f"{d}_review_count": n("reviews", d) for d in DECISIONS}
    return rows.groupBy(key).agg(*(c.alias(x) for x, c in counts.items()))


def note_outcomes(cards: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Add state and error to cards that are to become notes: failed with empty_field or duplicate_note, else created.

    `existing`: keys of notes that are there. A write appends the created rows; the outcome of each row is its own.
    """
    blank = (F.trim(F.coalesce("front", F.lit(""))) == "") | (F.trim(F.coalesce("back", F.lit(""))) == "")
    there = existing.select(key).distinct().withColumn("_there", F.lit(True))
    rows = cards.join(there, key, "left")
    error = F.when(blank, "empty_field").when(F.col("_there"), "duplicate_note")
    return rows.withColumns({"error": error, "state": F.when(error.isNull(), "created").otherwise("failed")}).drop("_there")


def write_batches(outcomes: DataFrame, batch: str, skipped: Column) -> DataFrame:
    """One audit row a batch: requested, created, failed, skipped, first and last created note, state (success, partial or failed)."""
    created = F.col("state") == "created"
    rows = outcomes.groupBy(batch).agg(F.count_if(~skipped).alias("requested"), F.count_if(created & ~skipped).alias("created"), F.count_if(~created & ~skipped).alias("failed"), F.count_if(skipped).alias("skipped"), F.min(F.when(created & ~skipped, F.col("note_id"))).alias("first_note"), F.max(F.when(created & ~skipped, F.col("note_id"))).alias("last_note"))
    state = F.when((F.col("created") > 0) & (F.col("failed") > 0), "partial").when(F.col("created") > 0, "success").otherwise("failed")
    return rows.withColumn("state", state)


def confirmation(sessions: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """What each session still lacks before a write, in order, and its possible duplicates.

    sessions: deck, note_type, front_field, back_field, mapping_current, duplicates_current; cards: decision and duplicate_status (null: not checked).
    """
    counts = cards.groupBy(key).agg(F.count("*").alias("cards"), F.count("decision").alias("decided"), F.count("duplicate_status").alias("checked"), F.count_if(F.col("duplicate_status") == "possible_duplicate").alias("possible_duplicates"))
    rows = sessions.join(counts, key, "left").na.fill(0, ["cards", "decided", "checked", "possible_duplicates"])
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    conditions = (F.col("cards") == 0, (F.col("cards") > 0) & (F.col("decided") < F.col("cards")), blank("deck"), blank("note_type"), ~F.col("mapping_current") | blank("front_field") | blank("back_field"), ~(F.col("duplicates_current") & (F.col("cards") > 0) & (F.col("checked") == F.col("cards"))))
    missing = _first(**dict(zip(MISSING, conditions, strict=True)))
    return rows.select(key, "cards", missing.alias("missing"), "possible_duplicates", (F.size(missing) == 0).alias("ready"))


def selection_preview(points: DataFrame, selected: DataFrame, key: str = "point_id", most: int = 140) -> DataFrame:
    """key, selected and a preview of the explanation of each point."""
    from fluvial.functions.labels import preview

    ids = selected.select(key).distinct().withColumn("_there", F.lit(True))
    return points.join(ids, key, "left").select(key, F.col("_there").isNotNull().alias("selected"), preview(F.col("explanation"), most).alias("preview"))
