"""Queries of stages that are plugged in, here mocks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.operators import cards as C
from fluvial.operators import critic, stages
from fluvial.operators import quality as Q
from fluvial.plans import documents
from fluvial.plans import queries as base


def _mock(requests: DataFrame) -> DataFrame:
    """By the conversation: no answer, another card's id, the front as back, the card as it is."""
    n = F.col("section") % 4
    rows = requests.filter(n != 0)
    return rows.select("request_id", F.when(n == 1, F.col("card_id") + 1).otherwise(F.col("card_id")).alias("card_id"), "front", F.when(n == 2, F.col("front")).otherwise(F.col("back")).alias("back"))


def repaired_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cards that the critic sends to repair, after it."""
    cards = C.numbered(base._cards(spark, sf_dir), "card_id")
    none = F.lit(None).cast("array<string>")
    first = critic.decide(Q.evaluate(cards, F.col("front"), F.lit("concept")), F.col("front"), F.lit(None).cast("string"), none, F.lit(False))
    out = stages.repair_once(first.filter("action = 'repair'").select("card_id", "section", "front", "back"), _mock, F.col("front"), F.lit("concept"))
    return out.withColumn("reason_codes", F.array_join("reason_codes", ","))


def asked_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations asked of a stage that answers some the second time alone, some twice at once and some never."""
    rows = base._table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    rounds = []

    def count(requests: DataFrame) -> DataFrame:
        rounds.append(1)
        n = F.col("conv_id") % 5
        known = requests.filter((n != 3) & ((n != 1) | F.lit(len(rounds) > 1)))
        return known.unionAll(known.filter(n == 2)).select("request_id", (F.col("turns") * 2).alias("doubled"))

    found = stages.ask(count, "count", rows, "conv_id", "doubled long", retries=1)
    return found.select("conv_id", "attempts", "outcome", F.col("answer.doubled").alias("doubled"))


def _judged(cards: str) -> str:
    """SQL: card_id, front, back, section and local, the reasons that block a card of `cards`."""
    words = documents._WORDS
    return f"""(SELECT g.*, list_filter(string_split(rule_ids, ','), lambda r: r IN ('empty_front', 'empty_back', 'unsupported_cloze', 'cloze_syntax_invalid')) || CASE WHEN loose OR list_contains(string_split(rule_ids, ','), 'source_not_grounded_simple') THEN ['source_not_grounded'] ELSE [] END AS local
FROM (SELECT *, (len(own) = 0 OR len(list_intersect(own, src)) / len(own) < 0.6) AND back <> '' AND front <> '' AS loose FROM (SELECT card_id, section, back, front, list_filter({words.format("back")}, lambda x: NOT list_contains(['and', 'are', 'but', 'for', 'from', 'has', 'have', 'into', 'not', 'that', 'the', 'this', 'was', 'what', 'when', 'where', 'which', 'with'], x)) AS own, {words.format("front")} AS src FROM {cards})) g
JOIN ({base._quality_sql(f"SELECT card_id, front, back, 'concept' AS mode, front AS source FROM {cards}")}) q USING (card_id))"""


_FIRST = f"(WITH {base._CARDS_SQL} SELECT card_id, section, front, back FROM {_judged('cards')} WHERE len(local) > 0)"
QUERIES = {f.__name__: f for f in (repaired_once, asked_twice)}
ORACLES = {
    "repaired_once": f"""WITH f AS {_FIRST}, n AS (SELECT card_id, section, front, CASE WHEN section % 4 = 2 THEN front ELSE back END AS back FROM {_FIRST} WHERE section % 4 > 1)
SELECT card_id, front, back, 'reject' AS action, CASE section % 4 WHEN 0 THEN 'repair_callback_failed' ELSE 'repair_output_invalid' END AS reason_codes FROM f WHERE section % 4 < 2
UNION ALL SELECT card_id, front, back, CASE WHEN len(local) > 0 THEN 'reject' ELSE 'pass' END, array_to_string(CASE WHEN len(local) > 0 THEN local || ['repair_failed_local_validation'] ELSE [] END, ',') FROM {_judged(f"(SELECT card_id, section, front, CASE WHEN section % 4 = 2 THEN front ELSE back END AS back FROM {_FIRST} WHERE section % 4 > 1)")}""",
    "asked_twice": """SELECT conv_id, CASE WHEN conv_id % 5 IN (1, 3) THEN 2 ELSE 1 END AS attempts, CASE conv_id % 5 WHEN 2 THEN 'several_answers' WHEN 3 THEN 'callback_failed' ELSE 'answered' END AS outcome, CASE WHEN conv_id % 5 NOT IN (2, 3) THEN count(*) * 2 END AS doubled FROM conversations GROUP BY conv_id""",
}
