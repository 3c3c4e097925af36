"""Queries of cards that share sources of several kinds, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.operators import cards as C
from fluvial.plans import queries as base


def _sources() -> Column:
    """A card's chunk, point and lists of chunks, by its conversation; one id is not a safe one."""
    s = F.col("section")
    named = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    return C.source_ids(named("c-", s), named("p-", s % 5), F.lit("no id"), lists=(F.array(named("k-", F.floor(s / 2)), named("k-", F.floor(s / 2) + 1)),))


def shared_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered(C.similar_pairs(base._changed(spark, sf_dir), 0.5, sources=_sources()), "first_id", "second_id")


def source_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.numbered(C.deduplicate(base._changed(spark, sf_dir), sources=_sources()), "card_id", "matched_id")


QUERIES = {f.__name__: f for f in (shared_source_pairs, source_decisions)}
ORACLES = {
    "shared_source_pairs": f"""WITH {base._CARDS_SQL}, o AS (SELECT card_id, section, front, back FROM cards UNION ALL SELECT card_id + 1, section, front, back || ' again' FROM cards),
t AS (SELECT card_id, ['c-' || section, 'p-' || (section % 5), 'k-' || (section // 2), 'k-' || (section // 2 + 1)] AS ids, list_distinct(regexp_extract_all(lower(front || chr(10) || back), '[a-z0-9_]{{2,}}')) AS t FROM o),
p AS (SELECT a.card_id AS first_id, b.card_id AS second_id, len(list_intersect(a.t, b.t)) AS k, len(a.t) + len(b.t) AS n FROM t a JOIN t b ON a.card_id < b.card_id AND list_has_any(a.ids, b.ids))
SELECT first_id, second_id, round(k / (n - k), 3) AS similarity FROM p WHERE n > k AND k / (n - k) >= 0.5""",
}
