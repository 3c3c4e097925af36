"""Conversations damaged by a fixed rule, their faults counted, and each repaired at the least cost (see transducers.py).

Rows are sorted once by ranges of (conversation, turn), so one conversation may span tasks, and cut into segments of
SEGMENT rows at most. A segment's word gives its weights between the grammar's states by itself; a conversation's few
numbers a segment are then chained, and the chosen labels go back to its segments. What a single result must hold in whole
meets in one task: the audit, a letter an edit, and the running digest of the repaired rows, which takes large
conversations as parts of PART bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.llm import transducers as fst
from fluvial.staging import bounded_batches, discard, materialize

#: Rows of a segment at most: 2 to this power.
SEGMENT_BITS = 10
#: Bytes of a part of a large conversation's repaired rows.
PART = 1 << 20
_BLANK = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def _id(conv: Column) -> Column:
    """A conversation's id as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text of conv_id, turn, role and text after damage; nulls of role and text are a space each.

    crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 repeats it, 4 gives it the role user.
    """
    spelt = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.select(_id(F.col("conv_id")).alias("conv"), "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(spelt.cast("binary")) % 20).cast("int").alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("k <> 0").select("conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "k")
    return rows.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k", "copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Damaged rows as a stored table with `at`, which counts up by conversation, turn (nulls first) and digest, and digest, a key of role and text."""
    text = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.withColumn("digest", F.unhex(F.sha2(text.cast("binary"), 256))).withColumn("_row", F.monotonically_increasing_id())  # equal rows are dealt out too
    by = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "digest", "_row")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_row")
    return materialize(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("segment", F.shiftright("at", SEGMENT_BITS)), "ordered_rows")


def _words(ordered: DataFrame) -> DataFrame:
    """conv, segment and word of each segment, a letter a row; a group has as many rows as a segment at most."""
    firsts = ordered.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    rows = ordered.select("at", "conv", "segment", F.substring("role", 1, 1).alias("initial"), F.col("text").rlike(_BLANK).alias("said"), F.col("text").rlike(_ENDED).alias("ended"))
    of_role = F.when(F.col("initial").isin(*fst.INITIALS[:3]), F.col("initial")).otherwise(fst.INITIALS[3])
    fault = F.when(~F.col("said"), F.lit(fst.LETTERS["blank"])).when(F.col("first").isNull(), F.lit(fst.LETTERS["duplicate"]))
    letters = fault.when(~F.col("ended"), F.lit(fst.LETTERS["truncated"])).otherwise(F.lit(fst.LETTERS["sound"]))
    at = sum((F.when(of_role == x, i + 1).otherwise(0) for i, x in enumerate(fst.INITIALS)), F.lit(0))
    letter = F.substr(letters, at, F.lit(1))
    rows = rows.join(firsts, "at", "left").select("conv", "segment", F.struct("at", letter.alias("x")).alias("s"))
    words = rows.groupBy("conv", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.x), "").alias("word"))
    return words


@lru_cache(1 << 14)
def _weights(word: str) -> tuple[list, list, list]:
    """Costs, ranks by labels, and labels of a segment's weights; null where there is no path."""
    found = fst.segment_weights(word)
    ranks = {labels: k for k, labels in enumerate(sorted({w[1] for w in found if w}))}
    return [w and w[0] for w in found], [w and ranks[w[1]] for w in found], [w and w[1] for w in found]


def _paths(words: DataFrame) -> DataFrame:
    """The words with costs, ranks and labels between the grammar's states, and illegal, the adjacent rows that don't follow the grammar."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_weights(w) for w in batch["word"].to_pylist()]
            costs, ranks, labels = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.string()))], [*batch.schema.names, "costs", "ranks", "labels"])

    return materialize(words.mapInArrow(weigh, "conv string, segment long, word string, costs array<long>, ranks array<int>, labels array<string>"), "paths")


def _count(word: str, fault: str) -> int:
    return sum(word.count(x) for x in fst.LETTERS[fault])


def _chains(paths: DataFrame) -> DataFrame:
    """For each segment: entry and exit (states of the grammar), last, alone; on a conversation's first segment also its cost and counts of faults."""
    names = ["conv", "segment", "entry", "exit", "last", "alone", "cost", "blank", "duplicate", "truncated", "illegal"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5]
    schema = "conv string, segment long, entry int, exit int, last boolean, alone boolean, cost long, blank long, duplicate long, truncated long, illegal long"

    def chain(conv: str, rows: list[tuple]) -> Iterator[tuple]:
        cost, ways = fst.best_chain([(r[2], r[3]) for r in rows])
        totals: list[int | None] = [cost, *(sum(r[4][k] for r in rows) for k in range(4))]
        totals[4] += sum((a[5] + b[4][4]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        for k, (row, (g, h)) in enumerate(zip(rows, ways, strict=True)):
            yield (conv, row[1], g, h, k == len(rows) - 1, len(rows) == 1, *(totals if k == 0 else [None] * 5))

    def counts(word: str) -> tuple:
        said = [fst.initial(x) for x in word]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        return _count(word, "blank"), _count(word, "duplicate"), _count(word, "truncated"), illegal, said[0], said[-1]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for conv, segment, costs, ranks, word in zip(*(batch[c].to_pylist() for c in ("conv", "segment", "costs", "ranks", "word")), strict=True):
                if held and held[0][0] != conv:
                    out += chain(held[0][0], held)
                    held = []
                said = counts(word)
                held.append((conv, segment, costs, ranks, said[:5], said[5]))
            yield _record(out)
        if held:
            yield _record(list(chain(held[0][0], held)))

    def _record(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    dealt = paths.select("conv", "segment", "costs", "ranks", "word").repartition("conv").sortWithinPartitions("conv", "segment")
    return materialize(dealt.mapInArrow(fold, schema), "chains")


def _plans(paths: DataFrame, chains: DataFrame) -> DataFrame:
    """conv, segment, alone, audit and edits of each segment."""
    place = F.col("entry") * len(fst.STATES) + F.col("exit") + 1
    tails = F.array(*(F.lit(labels) for _, labels in fst.TAILS))
    audit = F.concat(F.element_at("labels", place), F.when(F.col("last"), F.element_at(tails, F.col("exit") + 1)).otherwise(""))
    chosen = paths.select("conv", "segment", "word", "labels").join(chains.select("conv", "segment", "entry", "exit", "last", "alone"), ["conv", "segment"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fst.edits(*x) for x in zip(*(batch[c].to_pylist() for c in ("word", "audit", "entry")), strict=True)]
            yield pa.record_batch([batch["conv"], batch["segment"], batch["alone"], batch["audit"], pa.array(found, pa.list_(pa.string()))], ["conv", "segment", "alone", "audit", "edits"])

    chosen = chosen.select("conv", "segment", "alone", "word", audit.alias("audit"), "entry")
    return materialize(chosen.mapInArrow(spell, "conv string, segment long, alone boolean, audit string, edits array<string>"), "plans")


def _lines(edit: str, role: str | None, text: str | None) -> list[str]:
    """What a row's edit writes; without a row, what is inserted behind the last one."""
    inserted, action = (edit, "") if role is None else (edit[:-1], edit[-1])
    out = [f"{fst.ROLES[x]}:" for x in inserted]
    if action == "k":
        out.append(f"{role}:{text}")
    elif action in fst.ROLES:
        out.append(f"{fst.ROLES[action]}:{text}")
    return out


def repaired_parts(ordered: DataFrame, plans: DataFrame) -> DataFrame:
    """conv, segment, part and the repaired rows of each segment: their SHA-256 if the segment is the whole conversation, else parts of the text, each row behind a newline."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: list[str] = []
        key, alone, k, part, size = None, True, 0, 0, 0
        pieces: list[bytes] = []
        digest, empty = hashlib.sha256(), True

        def out(last: bool) -> Iterator[tuple]:
            nonlocal part, size, digest, empty
            data = b"".join(pieces)
            pieces.clear()
            size = 0
            if not alone:
                if data:
                    yield *key, part, None, data
                    part += 1
                return
            if data:
                digest.update(data[1:] if empty else data)
                empty = False
            if last:
                yield *key, 0, digest.hexdigest(), None
                digest, empty = hashlib.sha256(), True

        def put(lines: list[str]) -> Iterator[tuple]:
            nonlocal size
            for line in lines:
                pieces.append(b"\n" + line.encode())
                size += len(pieces[-1])
            if size >= PART:
                yield from out(False)

        def finish() -> Iterator[tuple]:
            if key is not None:
                for row in plan[k:]:
                    yield from put(_lines(row, None, None))
                yield from out(True)

        def record(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv", "segment", "part", "sha", "data"])

        for batch in batches:
            rows = []
            for conv, segment, at, role, text, edits, own in zip(*(batch[c].to_pylist() for c in ("conv", "segment", "at", "role", "text", "edits", "alone")), strict=True):
                if at == -1:
                    rows += finish()
                    key, plan, alone, k, part = (conv, segment), edits, own, 0, 0
                else:
                    rows += put(_lines(plan[k], role, text))
                    k += 1
            yield record(rows)
        yield record(list(finish()))

    none = F.lit(None)
    first = plans.select("conv", "segment", F.lit(-1).cast("long").alias("at"), none.cast("string").alias("role"), none.cast("string").alias("text"), "edits", "alone")
    rest = ordered.select("conv", "segment", "at", "role", "text", none.cast("array<string>").alias("edits"), none.cast("boolean").alias("alone"))
    dealt = first.unionByName(rest).repartition("conv", "segment").sortWithinPartitions("conv", "segment", "at")
    return materialize(dealt.mapInArrow(write, "conv string, segment long, part int, sha string, data binary"), "repaired")


def _digests(parts: DataFrame) -> DataFrame:
    """conv and repaired_sha256 of the conversations that have rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running, empty = None, hashlib.sha256(), True
        for batch in batches:
            convs, shas = [], []
            for conv, data in zip(batch["conv"].to_pylist(), batch["data"], strict=True):
                if conv != key:
                    if key is not None:
                        convs.append(key)
                        shas.append(running.hexdigest())
                    key, running, empty = conv, hashlib.sha256(), True
                data = memoryview(data.as_buffer())
                running.update(data[1:] if empty else data)
                empty = False
            yield pa.record_batch([pa.array(convs, pa.string()), pa.array(shas, pa.string())], ["conv", "repaired_sha256"])
        if key is not None:
            yield pa.record_batch([pa.array([key]), pa.array([running.hexdigest()])], ["conv", "repaired_sha256"])

    whole = parts.filter("data is null").select("conv", F.col("sha").alias("repaired_sha256"))
    large = parts.filter("data is not null").select("conv", "segment", "part", "data").repartition("conv").sortWithinPartitions("conv", "segment", "part")
    return whole.unionByName(large.select("conv", "data").mapInArrow(digest, "conv string, repaired_sha256 string"))


def repair_conversations(table: DataFrame) -> DataFrame:
    """One row per conv_id of the table: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (see `damaged`) and taken by turn, null turns first; rows of one turn by the SHA-256 of role
    and text, so repeated ones are adjacent. A null role or text is one space, a null conv_id a conversation like another.
    A role without any letter has no initial that the grammar takes. Texts and conversations of any length are read whole.
    A conversation without rows after damage has zeros, an empty audit and the digest of an empty string. Gaps beyond a
    long are given as the greatest long. An empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(table.sparkSession)
    table = table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = _ordered(damaged(table))
    wide = F.col("turn").cast("decimal(20,0)")
    gaps = ordered.groupBy("conv").agg(F.least(F.coalesce(F.max(wide) - F.min(wide) + 1 - F.count_distinct("turn"), F.lit(0)), F.lit(2**63 - 1)).cast("long").alias("gaps"))
    paths = _paths(_words(ordered))
    chains = _chains(paths)
    plans = _plans(paths, chains)
    audits = plans.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda s: s.audit), "").alias("audit"))
    parts = repaired_parts(ordered, plans)
    found = chains.filter("cost is not null").select("conv", "cost", "blank", "duplicate", "truncated", "illegal")
    ids = table.select("conv_id").distinct().withColumn("conv", _id(F.col("conv_id")))
    full = ids.join(gaps, "conv", "left").join(found, "conv", "left").join(audits, "conv", "left").join(_digests(parts), "conv", "left")
    counts = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    out = materialize(full.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")), "repairs")
    discard(ordered, paths, chains, plans, parts)
    return out


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)
), original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS spelt FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(spelt, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c // 256, t[CAST(xor(c, x) % 256 AS BIGINT) + 1])), 4294967295) % 20 AS k FROM original, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) c(copy)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS i FROM damaged
), rated AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered
), costs AS (
  SELECT conv_id, i, n, x, CASE WHEN fault IN ('b', 'd') THEN 1000000000000 ELSE 0 END AS stay, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS more FROM rated
), back AS (
  SELECT DISTINCT conv_id, n AS i, {c: 0, l: ''} AS b, {c: 4, l: 'II'} AS s, {c: 2, l: 'I'} AS u, {c: 0, l: ''} AS a FROM rated
  UNION ALL
  SELECT conv_id, i, least(b, {c: u.c + 2, l: 'I' || u.l}, {c: a.c + 4, l: 'II' || a.l}), least(s, {c: u.c + 2, l: 'I' || u.l}, {c: a.c + 4, l: 'II' || a.l}), least(u, {c: a.c + 2, l: 'I' || a.l}), least(a, {c: u.c + 2, l: 'I' || u.l})
  FROM (
    SELECT v.conv_id, v.i - 1 AS i,
      least({c: b.c + 3, l: 'D' || b.l}, {c: stay + more + 2 + u.c, l: 'R' || u.l}, CASE x WHEN 's' THEN {c: stay + more + s.c, l: 'K' || s.l} WHEN 'u' THEN {c: stay + more + u.c, l: 'K' || u.l} END) AS b,
      least({c: s.c + 3, l: 'D' || s.l}, {c: stay + more + 2 + u.c, l: 'R' || u.l}, CASE x WHEN 'u' THEN {c: stay + more + u.c, l: 'K' || u.l} END) AS s,
      least({c: u.c + 3, l: 'D' || u.l}, {c: stay + more + 2 + a.c, l: 'R' || a.l}, CASE x WHEN 'a' THEN {c: stay + more + a.c, l: 'K' || a.l} END) AS u,
      least({c: a.c + 3, l: 'D' || a.l}, {c: stay + more + 2 + u.c, l: 'R' || u.l}, CASE x WHEN 'u' THEN {c: stay + more + u.c, l: 'K' || u.l} END) AS a
    FROM back v JOIN costs r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i WHERE v.i > 0)
), best AS (SELECT conv_id, b.c AS cost, b.l AS audit FROM back WHERE i = 0
), forth AS (
  SELECT conv_id, audit, 0 AS k, 0 AS i, 'b' AS g, CAST([] AS VARCHAR[]) AS lines FROM best
  UNION ALL
  SELECT f.conv_id, audit, k + 1, CASE e WHEN 'I' THEN f.i ELSE f.i + 1 END, CASE e WHEN 'D' THEN g WHEN 'K' THEN CASE x WHEN 's' THEN 's' WHEN 'u' THEN 'u' ELSE 'a' END ELSE CASE g WHEN 'u' THEN 'a' ELSE 'u' END END,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE g WHEN 'u' THEN 'assistant:' ELSE 'user:' END || CASE e WHEN 'R' THEN text ELSE '' END) END
  FROM (SELECT *, substr(audit, k + 1, 1) AS e FROM forth WHERE k < length(audit)) f LEFT JOIN rated r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1
), repaired AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS h FROM forth WHERE k = length(audit)
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM rated GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
