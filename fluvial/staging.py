"""Tables that jobs write for their own later steps, and joins that survive hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: What was shuffled of a table may be broadcast up to so many bytes; its rows take a few times as many.
BROADCAST_BYTES = 1 << 20


def joins_by_rows(spark: SparkSession) -> None:
    """From now on this session's joins are not planned by the bytes of files, only by hints and by few bytes that were shuffled.

    A stored table of ids may be hundreds of times larger in rows than in its compressed files, and what was shuffled of it
    is compressed, too, so Spark would take it for one to broadcast and fill the driver.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    given = spark.conf.get(measured, None) or spark.conf.get(planned)
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)(?:i?b)?", given.strip().lower()).groups()
    spark.conf.set(measured, str(min(BROADCAST_BYTES, int(number) << 10 * " kmgtp".index(unit or " "))))
    spark.conf.set(planned, "-1")


#: Hot keys hold over 1/hot_groups of all rows each: so many at least, and at most.
HOT_GROUPS, MOST_GROUPS = 256, 65_536


def hot_groups(spark: SparkSession) -> int:
    """A key is hot if it holds over this part of all rows; the part follows the number of tasks that share a shuffle's rows."""
    return min(MOST_GROUPS, max(HOT_GROUPS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error, as no folder is surely shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="fluvial-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/fluvial/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here, and a lost executor costs no earlier work."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        path = df.inputFiles()[0].rpartition("/")[0] if df.inputFiles() else None
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch that goes to or comes from Python.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches are limited by bytes, as texts and arrays differ in size by a thousand times."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: No key of fewer rows is hot: they are no load for a task.
LEAST_HOT = 4_096


def hot_keys(rows: DataFrame, key: list[str]) -> DataFrame | None:
    """key and _salts of the hot keys of a stored table: into so many parts a key's rows must be dealt. None if the table is too small to have any."""
    n = rows.count()
    if n <= LEAST_HOT:
        return None
    floor = max(n // hot_groups(rows.sparkSession), LEAST_HOT)
    return rows.groupBy(*key).count().filter(F.col("count") > floor).select(*key, F.ceil(F.col("count") / floor).cast("int").alias("_salts"))


def join_skewed(rows: DataFrame, table: DataFrame, key: list[str], by: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined (inner or left) with a table of one row a key, whatever share of the rows a key holds.

    A hot key's rows are dealt over salts by a hash of the columns `by`, and its one row of the table is repeated for
    each salt, so no task gets more than the share that makes a key hot. Only the hot keys themselves are broadcast,
    MOST_GROUPS at most. rows should be a stored table, as it is read twice, or `hot` given. Null keys find nothing.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if hot is None:
        return rows.join(table, key, how)
    turn = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*by), F.col("_salts")).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", turn).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    repeated = table.join(F.broadcast(hot), key, "left").withColumn("_salt", copies).drop("_salts")
    return dealt.join(repeated, [*key, "_salt"], how).drop("_salt")


#: So many keys may be broadcast to pick rows by; 8 bytes each.
BROADCAST_KEYS = 2_000_000


def pick(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """rows with (left_semi) or without (left_anti) a key in `keys`, a stored table of distinct values.

    Keys are counted: up to BROADCAST_KEYS are broadcast and rows stay where they are, beyond that both are shuffled.
    """
    if keys.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), key, how)
    found = join_skewed(rows, keys.withColumn("_there", F.lit(True)), [key], [c for c in rows.columns if c != key], "left")
    return found.filter(F.col("_there").isNotNull() if how == "left_semi" else F.col("_there").isNull()).select(*rows.columns)


def number_within(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add `name` (long): each key's rows counted from 0 without gaps, by the columns `order`, nulls first.

    Rows are dealt out by ranges of (key, order, a row number), so neither a large key nor a repeated order fills one
    task; each range then adds the count of its key's rows in the ranges before it. There are at most as many such
    counts as ranges and keys together; they are broadcast if they are few.
    """
    spark = rows.sparkSession
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    by = [F.col(c).asc_nulls_first() for c in (key, *order, "_row")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    dealt = dealt.drop("_row").withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33))
    dealt = materialize(dealt.withColumn("_key", F.struct(key)), "ranges")  # equal even if it is null
    counts = dealt.groupBy("_part", "_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_key", "_first", "_base"), "counts")
    out = dealt.join(F.broadcast(counts) if counts.count() <= BROADCAST_KEYS else counts, ["_part", "_key"])
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_base")).drop("_part", "_at", "_first", "_base", "_key")
