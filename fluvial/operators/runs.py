"""Runs as event logs: stages, calls within a budget, retries, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.scans import along
from fluvial.staging import discard, join_skewed, materialize, number_within

# The stages that may follow each one, besides those that end a run; and what each level may call, how often.
NEXT = {"analyzing": ("planning",), "planning": ("generating",), "generating": ("reviewing",), "reviewing": ("repairing", "checking_coverage"), "repairing": ("reviewing", "checking_coverage"), "checking_coverage": ("deduplicating",), "deduplicating": ("completed",)}
ENDS = ("failed", "superseded")
STAGES = (*NEXT, "completed", *ENDS)
CALLS = {"fast": (3, ("generate",)), "standard": (8, ("planner", "generate", "repair")), "deep": (12, ("planner", "generate", "critic", "repair", "supplement"))}


def _map(table: dict) -> Column:
    return F.create_map(*(x if isinstance(x, Column) else F.lit(x) for kv in table.items() for x in kv))


def stages(events: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, stage, accepted, refused) after all events (ord, level, stage) of each run; an illegal change is refused and changes nothing.

    A run starts in `analyzing`. An event is a map from stage to stage, and so are several in a row: each 1024 events of a run
    become one map, each 1024 of these again one, so a run with a third of all events is no one task's or array's.
    """
    rows = number_within(events.select(key, "ord", "level", "stage"), key, ["ord"], "_n")
    steps = _map({k: F.array(*map(F.lit, v + ENDS)) for k, v in NEXT.items()})

    def step(acc: Column, e: Column) -> Column:
        legal = F.coalesce(F.array_contains(F.element_at(steps, acc["stage"]), e["stage"]), F.lit(False)) & ~F.coalesce((e["level"] == "fast") & (e["stage"] == "repairing"), F.lit(False))
        return F.struct(F.when(legal, e["stage"]).otherwise(acc["stage"]).alias("stage"), (acc["accepted"] + legal.cast("int")).alias("accepted"), (acc["refused"] + (~legal).cast("int")).alias("refused"))

    def after(stage: Column) -> Column:
        return F.struct(stage.alias("stage"), F.lit(0).alias("accepted"), F.lit(0).alias("refused"))

    def onward(acc: Column, m: Column) -> Column:
        there = F.element_at(m["map"], F.array_position(names, acc["stage"]).cast("int"))
        return F.struct(there["stage"].alias("stage"), (acc["accepted"] + there["accepted"]).alias("accepted"), (acc["refused"] + there["refused"]).alias("refused"))

    names = F.array(*map(F.lit, STAGES))
    log = F.array_sort(F.collect_list(F.struct("_n", "level", "stage")))
    maps = rows.groupBy(key, F.shiftright("_n", 10).alias("_at")).agg(log.alias("log"))
    maps = materialize(maps.select(key, "_at", F.transform(names, lambda s: F.aggregate("log", after(s), step)).alias("map")), "stage_maps")
    in_order = F.array_sort(F.collect_list(F.struct("_at", "map"))).alias("maps")
    for last in (False, True):
        grouped = maps.groupBy(key).agg(in_order) if last else maps.groupBy(key, F.shiftright("_at", 10).alias("_to")).agg(in_order)
        if last:
            return grouped.withColumn("_end", F.aggregate("maps", after(F.lit(STAGES[0])), onward)).select(key, "_end.*")
        maps = grouped.select(key, F.col("_to").alias("_at"), F.transform(names, lambda s: F.aggregate("maps", after(s), onward)).alias("map"))
    raise AssertionError


def completion(chunks: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, succeeded, failed, open, status): `running` while a chunk (state) is open, `partial` if one failed, else `completed`."""
    n = {s: F.count_if(F.col("state").isin(*of)) for s, of in {"succeeded": ("succeeded",), "failed": ("failed",), "open": ("pending", "running")}.items()}
    counts = chunks.groupBy(key).agg(*(c.alias(s) for s, c in n.items()))
    return counts.withColumn("status", F.when(F.col("open") > 0, "running").when(F.col("failed") > 0, "partial").otherwise("completed"))


def reserve(calls: DataFrame, key: str = "run_id") -> DataFrame:
    """Add call_number (null where refused) and error to calls (ord, level, purpose): purposes of the level alone count, up to its limit."""
    allowed = F.array_contains(F.element_at(_map({k: F.array(*map(F.lit, v)) for k, (_, v) in CALLS.items()}), F.col("level")), F.col("purpose"))
    limit = F.element_at(_map({k: n for k, (n, _) in CALLS.items()}), F.col("level"))
    rows = calls.withColumn("_may", F.coalesce(allowed, F.lit(False)))
    number = F.sum(F.col("_may").cast("int")).over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_n", number)
    error = F.when(~F.col("_may"), "call_not_allowed").when(F.col("_n") > limit, "call_budget_exhausted")
    return rows.withColumn("error", error).withColumn("call_number", F.when(F.col("error").isNull(), F.col("_n"))).drop("_may", "_n")


def to_retry(chunks: DataFrame, retries: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Failed chunks that were never scheduled again."""
    return chunks.filter("state = 'failed'").join(retries.select(key).distinct(), key, "left_anti")


def retry_failed(chunks: DataFrame, limits: DataFrame, key: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """(attempts, runs) of one retry of all failed chunks that were never retried.

    chunks: key, ord (distinct longs), state, scheduled, and what the retry gave: cards and error; limits: key, card_limit,
    cards (had so far) and calls_left. attempts has key, ord, state, error, called and accepted for each chunk that is
    tried; runs has key, error, calls and accepted.

    A run is refused as a whole: retry_already_scheduled, no_failed_chunks or retry_call_budget_insufficient. Else its chunks
    are tried in order. What came before fills the slots: once none is left, chunks fail with card_limit_reached, without a
    call; cards beyond the last slot are cut off. So what a chunk adds follows from the running total of cards.
    """
    own = materialize(chunks.select(key, F.struct(key).alias("_key"), "ord", "state", F.coalesce("scheduled", F.lit(False)).alias("scheduled"), F.when(F.col("error").isNull(), F.coalesce("cards", F.lit(0))).otherwise(0).alias("cards"), "error"), "retry_chunks")
    failed = F.col("state") == "failed"
    counts = own.groupBy("_key").agg(F.count_if(failed).alias("failed"), F.count_if(failed & ~F.col("scheduled")).alias("open"))
    runs = limits.select(F.struct(key).alias("_key"), key, "card_limit", F.col("cards").alias("had"), "calls_left").join(counts, "_key", "left").na.fill(0, ["failed", "open"])
    verdict = F.when((F.col("open") == 0) & (F.col("failed") > 0), "retry_already_scheduled").when(F.col("open") == 0, "no_failed_chunks").when(F.col("calls_left") < F.col("open"), "retry_call_budget_insufficient")
    runs = materialize(runs.withColumn("error", verdict).withColumn("slots", F.greatest(F.lit(0), F.col("card_limit") - F.col("had"))), "retry_runs")
    open_ = materialize(own.filter(failed & ~F.col("scheduled")).select("_key", "ord", "cards", "error"), "retry_open")
    tried = materialize(along(open_, ["_key"], "ord", sums={"until": F.col("cards")}), "retry_totals")
    good = runs.filter("error is null").select("_key", "slots")
    tried = join_skewed(tried, good, ["_key"], ["ord"])
    before = F.least("slots", F.col("until") - F.col("cards"))
    called = before < F.col("slots")
    error = F.when(~called, "card_limit_reached").otherwise(F.col("error"))
    attempts = tried.select(F.col("_key")[key].alias(key), "ord", F.when(error.isNull(), "succeeded").otherwise("failed").alias("state"), error.alias("error"), called.alias("called"), F.when(called, F.least("slots", "until") - before).otherwise(0).cast("long").alias("accepted"))
    attempts = materialize(attempts, "attempts")
    sums = attempts.groupBy(F.struct(key).alias("_key")).agg(F.count_if("called").alias("calls"), F.sum("accepted").alias("accepted"))
    done = runs.join(sums, "_key", "left").select(key, "error", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "accepted")))
    discard(own, open_)
    return attempts, done


def revisions(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Add revision: how often the value changed up to each row, in order; the first row has 1, nulls are a value."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    return rows.withColumn("_changed", changed).withColumn("revision", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def first_of_each(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def outcomes(expected: DataFrame, given: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Every expected key with its error: the given one, or generation_result_missing where nothing came back."""
    found = given.select(key, "error", F.lit(True).alias("_there"))
    return expected.join(found, key, "left").withColumn("error", F.when(F.col("_there").isNull(), "generation_result_missing").otherwise(F.col("error"))).drop("_there")


def replaced(rows: DataFrame, repaired: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of their repaired version, where there is one."""
    columns = [c for c in repaired.columns if c != key]
    new = repaired.select(key, F.struct(*columns).alias("_new"))
    return rows.join(new, key, "left").withColumns({c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in columns}).drop("_new")
