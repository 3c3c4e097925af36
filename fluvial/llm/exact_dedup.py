"""Exact deduplication by salted digest groups, with DataFrame functions only.

1. A slim table has every row's digest and a row number; grouping it by digest finds the hot ones, those that hold more
   than their part of all rows (staging.hot_groups). Salts are for these alone: any other digest has one salt.
2. Texts are grouped by (digest, salt, full text): each task first deduplicates its own rows, and only then are
   texts shuffled, once. A hot digest's rows are spread over salts; any other is settled here.
3. The winners of a hot digest's salts are grouped by (digest, full text).
Every grouping compares full texts, so a digest with two texts would show as two groups; its rows then get their
group by digest and text, all others by digest alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.staging import discard, hot_groups, join_skewed, materialize, pick

WHITESPACE = r"[\x20\x09-\x0D]+"
SALTS = 32


def normalized(text: Column) -> Column:
    """Each run of ASCII white space becomes a space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; keep_id is the least doc_id of a group (null only if all are
    null). Exactly one row of a group is kept: the one with keep_id, and of rows that repeat that doc_id, any one.
    A null or empty text is a text like another; texts of any length are compared whole. An empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("_text"))
    source = source.withColumn("sha", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    slim = materialize(source.select("doc_id", "sha", F.monotonically_increasing_id().alias("_row")), "digests")
    floor = max(slim.count() // hot_groups(docs.sparkSession), 1000)
    hot = materialize(slim.groupBy("sha").count().filter(F.col("count") > floor).select("sha"), "hot")

    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    salted = source.join(F.broadcast(hot.withColumn("_hot", F.lit(1))), "sha", "left").withColumn("_salt", salt)
    local = salted.groupBy("sha", "_salt", "_text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    local = materialize(local.withColumn("_text", F.when(F.col("_salt").isNotNull(), F.col("_text"))), "salt_winners")
    merged = local.filter("_salt is not null").groupBy("sha", "_text").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = materialize(local.filter("_salt is null").select("sha", "keep_id", "group_size").unionByName(merged.select("sha", "keep_id", "group_size")), "groups")

    clashing = groups.groupBy("sha").count().filter("count > 1").select("sha")
    if not clashing.isEmpty():  # two texts with one SHA-256: their rows are grouped by text itself
        return _by_text(source)
    return _mark(slim, groups)


def _mark(slim: DataFrame, groups: DataFrame) -> DataFrame:
    """Give each row its group, whatever share of the rows a group holds, and mark one row of each."""
    full = materialize(join_skewed(slim, groups, ["sha"], ["_row"]), "grouped")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = full.filter(own).groupBy("sha").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_first"))
    out = full.join(first, "_row", "left")
    return out.select("doc_id", "keep_id", "group_size", F.col("_first").isNotNull().alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _by_text(source: DataFrame) -> DataFrame:
    """The same result with full texts as keys throughout."""
    group = Window.partitionBy("sha", "_text")
    turn = F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last()))
    return source.select(
        "doc_id",
        F.min("doc_id").over(group).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        (turn == 1).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns, whatever their names.

    Rows go by doc_id alone, and texts stay where they are if the dropped ids are few enough to broadcast. An id that
    has kept and dropped rows (it repeats, or is null) is settled by digest; of its equal rows one stays. Null and empty
    texts are texts like others. An empty table gives an empty result.
    """
    key = F.struct(F.col("doc_id").cast("long").alias("id")).alias("key")  # a null id is an id
    marks = materialize(exact_groups(docs).select(key, "kept", F.unhex("text_sha256").alias("sha")), "marks")
    dropped = materialize(marks.filter(~F.col("kept")).select("key").distinct(), "dropped")
    both = materialize(marks.filter("kept").join(dropped, "key", "left_semi").select("key", "sha"), "both")
    discard(marks)
    rows = docs.select(key, F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    out = pick(rows, dropped, "key", "left_anti").select("row.*")
    if both.isEmpty():
        return out
    ids = materialize(both.select("key").distinct(), "ids")
    again = pick(rows, ids, "key").withColumn("sha", F.unhex(F.sha2(normalized(F.col("row.text")).cast("binary"), 256)))
    again = again.join(both, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"])
    return out.unionByName(again.select("row.*"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
