"""Stages that fail, answer twice or for others, and what a repair may change."""

from pyspark.sql import functions as F

from fluvial.operators import stages


def asked(spark, stage, retries=0):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "k int, t string")
    return {r.k: (r.outcome, r.attempts, r.answer and r.answer.v) for r in stages.ask(stage, "s", rows, "k", "v string", retries).collect()}


def test_answers(spark):
    assert asked(spark, lambda r: r.select("request_id", F.upper("t").alias("v"))) == {i: ("answered", 1, f"R{i}") for i in range(5)}

    def odd(requests):
        own = requests.filter("k <> 1").select("request_id", F.col("t").alias("v"))
        return own.unionAll(requests.filter("k = 2").select("request_id", F.lit("again"))).unionAll(own.limit(1).select(F.lit("nobody's"), "v"))

    assert asked(spark, odd) == {0: ("answered", 1, "r0"), 1: ("callback_failed", 1, None), 2: ("several_answers", 1, None), 3: ("answered", 1, "r3"), 4: ("answered", 1, "r4")}


def test_a_stage_that_raises_is_asked_again_with_new_ids(spark):
    seen = []

    def first_fails(requests):
        seen.append({r.request_id for r in requests.collect()})
        if len(seen) == 1:
            raise RuntimeError("down")
        return requests.filter("k < 3").select("request_id", F.col("t").alias("v"))

    got = asked(spark, first_fails, 1)
    assert got == {i: ("answered", 2, f"r{i}") if i < 3 else ("callback_failed", 2, None) for i in range(5)}
    assert len(seen) == 2 and not seen[0] & seen[1]

    def fails_in_a_task(requests):
        return requests.select("request_id", F.raise_error(F.lit("x")).cast("string").alias("v"))

    assert set(asked(spark, fails_in_a_task).values()) == {("callback_failed", 1, None)}


def test_repair(spark):
    cards = [(1, "What is a cell?", "Nothing of it"), (2, "What is a cell?", "Nothing of it"), (3, "What is a cell?", "x"), (4, "What is a cell?", "y"), (5, "What is a cell?", "z")]
    rows = spark.createDataFrame([(*c, "a small unit of life") for c in cards], "card_id int, front string, back string, source string")

    def mend(requests):
        k = F.col("card_id")
        return requests.filter("card_id <> 4").select("request_id", F.when(k == 3, 9).otherwise(k).alias("card_id"), "front", F.when(k == 1, "A small unit of life").when(k == 5, None).otherwise(F.col("back")).alias("back"))

    got = {r.card_id: (r.back, r.action, r.reason_codes) for r in stages.repair_once(rows, mend, F.col("source"), F.lit("concept")).collect()}
    assert got[1] == ("A small unit of life", "pass", []) and got[2][1:] == ("reject", ["source_not_grounded", "repair_failed_local_validation"])
    assert got[3] == ("x", "reject", ["repair_output_invalid"]) and got[4] == ("y", "reject", ["repair_callback_failed"]) and got[5] == ("z", "reject", ["repair_output_invalid"])
