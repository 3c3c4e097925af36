"""Stages that somebody else provides: functions from a DataFrame of requests to one of answers.

A stage may be a model call by rows in tasks, a lookup or a mock. Requests are stored before it is asked, with ids that follow
from its name, the round and the row, and its answers are stored before they are judged; so a lost executor neither asks a
request of a stored round again nor changes what was answered. An answer counts if its request was asked and has no other
answer. What has none is asked once more if the stage may be retried; what still has none has failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.operators import critic
from fluvial.operators import quality as Q
from fluvial.staging import discard, materialize

Stage = Callable[[DataFrame], DataFrame]

#: Outcomes of a request.
ANSWERED, FAILED, SEVERAL = "answered", "callback_failed", "several_answers"


def ask(stage: Stage, name: str, rows: DataFrame, key: str, answers: str, retries: int = 0) -> DataFrame:
    """rows (one a key) with request_id, attempts, outcome and answer, a struct of the columns that `answers` (DDL) names.

    The stage gets rows with request_id and gives request_id and those columns. A stage that raises has answered nothing in
    that round; errors of single rows are rows that it leaves out.
    """
    spark = rows.sparkSession
    fields = [f.strip().split(" ")[0] for f in answers.split(",")]
    open_, done = rows, None
    for attempt in range(1, retries + 2):
        named = F.concat_ws("\x1f", F.lit(name), F.lit(str(attempt)), F.col(key).cast("string"))
        requests = materialize(open_.withColumn("request_id", F.substring(F.sha2(named.cast("binary"), 256), 1, 32)), "requests")
        try:
            given = materialize(stage(requests).select("request_id", F.struct(*fields).cast(f"struct<{', '.join(a.strip().replace(' ', ':', 1) for a in answers.split(','))}>").alias("answer")), "answers")
        except Exception:  # whatever the stage raises is its failure, not the run's
            given = materialize(spark.createDataFrame([], f"request_id string, answer struct<{', '.join(a.strip().replace(' ', ':', 1) for a in answers.split(','))}>"), "answers")
        one = given.groupBy("request_id").agg(F.count("*").alias("_n"), F.first("answer").alias("answer"))
        outcome = F.when(F.col("_n") == 1, ANSWERED).when(F.col("_n") > 1, SEVERAL).otherwise(FAILED)
        found = requests.join(one, "request_id", "left").withColumns({"outcome": outcome, "attempts": F.lit(attempt)})
        found = materialize(found.withColumn("answer", F.when(F.col("outcome") == ANSWERED, F.col("answer"))).drop("_n"), "round")
        discard(requests, given)
        last = attempt > retries
        settled = found if last else found.filter(F.col("outcome") != FAILED)
        done = settled if done is None else done.unionByName(settled)
        open_ = found.filter(F.col("outcome") == FAILED).select(*rows.columns)
        if not last and open_.isEmpty():
            break
    return done


def repair_once(cards: DataFrame, stage: Stage, source: Column, mode: Column, key: str = "card_id") -> DataFrame:
    """key, front, back, action, reason_codes of cards (key, front, back and what source and mode name) after one repair each.

    The stage is asked once for each card and gives its key, front and back. No answer is a reject with
    repair_callback_failed; another key, several answers or a side that is null are one with repair_output_invalid; the card stays as
    it was then. A repaired card is judged again by itself, as one that passed and may not be repaired a second time.
    """
    kind = cards.schema[key].dataType.simpleString()
    asked = ask(stage, "repair", cards, key, f"{key} {kind}, front string, back string")
    valid = (F.col("outcome") == ANSWERED) & F.col("answer")[key].eqNullSafe(F.col(key)) & F.col("answer.front").isNotNull() & F.col("answer.back").isNotNull()
    asked = materialize(asked.withColumn("_valid", F.coalesce(valid, F.lit(False))), "repairs")
    new = asked.filter("_valid").withColumns({"front": F.col("answer.front"), "back": F.col("answer.back")}).drop("answer", "outcome", "attempts", "request_id", "_valid")
    judged = critic.decide(Q.evaluate(new, source, mode), source, F.lit("pass"), F.lit(None).cast("array<string>"), F.lit(True))
    code = F.when(F.col("outcome") == FAILED, "repair_callback_failed").otherwise("repair_output_invalid")
    bad = asked.filter("not _valid").select(key, "front", "back", F.lit("reject").alias("action"), F.array(code).alias("reason_codes"))
    return judged.select(key, "front", "back", "action", "reason_codes").unionByName(bad)
