"""Queries that run streams over files to their end, and the same as one fold in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvial.plans import queries as base
from fluvial.sinks import BatchStore
from fluvial.staging import new_path
from fluvial.streaming import queues


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands: a user is a queue, the number of an event says what to do."""
    n = F.col("event_id")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    rows = base._table(spark, sf_dir, "events").select(F.col("user_id").alias("queue"), n)
    seq = F.row_number().over(Window.partitionBy("queue").orderBy("event_id")) - 1
    columns = {"seq": seq.cast("long"), "kind": pick(_KINDS, F.floor(n / 3)), "size": (n % 17) * (1 << 20), "at": (n % 4).cast("int"), "to": (F.floor(n / 5) % 3).cast("int"), "item": (n % 6 + 1).cast("int"), "request": (F.floor(n / 7) % 5 + 1).cast("int"), "outcome": pick(_OUTCOMES, n)}
    return rows.select("queue", *(c.alias(k) for k, c in columns.items()))


_KINDS = ("add", "begin", "add", "complete", "move", "begin", "complete", "add", "remove", "complete", "retry", "add", "complete")
_OUTCOMES = ("success", "failure", "warning")


def _followed(spark: SparkSession, sf_dir: str) -> BatchStore:
    """Commands dealt over files in no order, so most come before their turn somewhere, taken in three files at a time."""
    files = new_path(spark, "commands")
    _commands(spark, sf_dir).repartition(8, F.xxhash64("queue", "seq")).write.parquet(files)
    store = queues.queue_store(spark, new_path(spark, "queues"))
    queues.follow_commands(spark, files, store, new_path(spark, "queue_checkpoint"), 3)
    return store


def import_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each queue's commands, refused and stale ones, and bytes at the end of the stream."""
    rows = queues.latest_queues(_followed(spark, sf_dir))
    total = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + x["size"])
    return rows.select("queue", (F.col("seq") + 1).alias("commands"), "held", "refused", "stale", total.alias("bytes"))


def import_queue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.queue_files(queues.latest_queues(_followed(spark, sf_dir)))


_SQL = f"""WITH RECURSIVE c AS (
  SELECT user_id AS queue, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, {list(_KINDS)}[(event_id // 3) % {len(_KINDS)} + 1] AS kind, (event_id % 17) * 1048576 AS size, event_id % 4 + 1 AS pos, (event_id // 5) % 3 + 1 AS dest,
    event_id % 6 + 1 AS item, (event_id // 7) % 5 + 1 AS request, {list(_OUTCOMES)}[event_id % 3 + 1] AS outcome FROM events
), q AS (
  SELECT DISTINCT queue, 0::BIGINT AS seq, CAST([] AS STRUCT(item BIGINT, size BIGINT, status VARCHAR, request BIGINT)[]) AS items, 1::BIGINT AS ni, 1::BIGINT AS nr, 0::BIGINT AS refused, 0::BIGINT AS stale FROM c
  UNION ALL
  SELECT queue, seq, CASE
      WHEN kind = 'add' AND ok THEN list_append(items, {{item: ni, size: size, status: 'queued', request: NULL::BIGINT}})
      WHEN kind = 'remove' AND ok THEN items[1:pos - 1] || items[pos + 1:]
      WHEN kind = 'move' AND ok THEN rest[1:dest - 1] || [items[pos]] || rest[dest:]
      WHEN kind = 'begin' AND ok THEN items[1:pos - 1] || [{{item: items[pos].item, size: items[pos].size, status: 'importing', request: nr}}] || items[pos + 1:]
      WHEN kind = 'complete' THEN list_transform(items, lambda x: CASE WHEN x.item = item AND x.status = 'importing' AND x.request = request THEN {{item: x.item, size: x.size, status: outcome, request: x.request}} ELSE x END)
      WHEN kind = 'retry' THEN list_transform(items, lambda x, k: CASE WHEN x.status = 'failure' THEN {{item: x.item, size: x.size, status: 'importing', request: nr + len(list_filter(items[1:k - 1], lambda y: y.status = 'failure'))}} ELSE x END)
      ELSE items END,
    CASE WHEN kind = 'add' AND ok THEN ni + 1 ELSE ni END, CASE WHEN kind = 'begin' AND ok THEN nr + 1 WHEN kind = 'retry' THEN nr + len(list_filter(items, lambda x: x.status = 'failure')) ELSE nr END,
    refused + CASE WHEN ok THEN 0 ELSE 1 END, stale + CASE WHEN kind = 'complete' AND len(list_filter(items, lambda x: x.item = item AND x.status = 'importing' AND x.request = request)) = 0 THEN 1 ELSE 0 END
  FROM (SELECT q.queue, c.seq, q.items, q.ni, q.nr, q.refused, q.stale, c.kind, c.size, c.pos, c.dest, c.item, c.request, c.outcome, items[1:pos - 1] || items[pos + 1:] AS rest, CASE kind
      WHEN 'add' THEN len(items) < 20 AND coalesce(list_sum(list_transform(items, lambda x: x.size)), 0) + c.size <= 26214400
      WHEN 'remove' THEN pos <= len(items) WHEN 'move' THEN pos <= len(items) AND dest <= len(items) WHEN 'begin' THEN pos <= len(items) AND items[pos].status IN ('queued', 'failure') ELSE TRUE END AS ok
    FROM q JOIN c ON c.queue = q.queue AND c.seq = q.seq + 1)
), l AS (SELECT * FROM q QUALIFY seq = max(seq) OVER (PARTITION BY queue))"""

QUERIES = {f.__name__: f for f in (import_queues, import_queue_files)}
ORACLES = {
    "import_queues": f"{_SQL} SELECT queue, seq AS commands, 0 AS held, CAST(refused AS INTEGER) AS refused, CAST(stale AS INTEGER) AS stale, CAST(coalesce(list_sum(list_transform(items, lambda x: x.size)), 0) AS BIGINT) AS bytes FROM l",
    "import_queue_files": f"{_SQL} SELECT queue, CAST(k - 1 AS INTEGER) AS position, CAST(items[k].item AS INTEGER) AS item, items[k].size AS size, items[k].status AS status, CAST(items[k].request AS INTEGER) AS request FROM (SELECT *, unnest(range(1, len(items) + 1)) AS k FROM l)",
}
