"""Running values along the rows of a key, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.staging import joins_by_rows

#: A bucket covers 2 to this power of places.
BUCKET_BITS = 10


def along(rows: DataFrame, key: list[str], at: str, sums: dict[str, Column] | None = None, before: dict[str, Column] | None = None, latest: dict[str, Column] | None = None, least: dict[str, Column] | None = None) -> DataFrame:
    """rows with more columns: for each name in `sums` the total up to and with the row (long), in `before` the value of the
    row before (null in the first), in `latest` the last value that isn't null and in `least` the least one, both up to and
    with the row.

    A key's rows come by `at`, distinct longs that aren't negative. Windows reach over buckets of 1024 places; what is
    before a bucket comes from a row per bucket, and only these are sorted by key. So a key with a third of all rows is dealt
    out. rows should be a stored table, as it is read twice; key columns must not be null (a struct of nulls isn't).
    """
    joins_by_rows(rows.sparkSession)
    sums, before, latest, least = sums or {}, before or {}, latest or {}, least or {}
    by = [*key, "_bucket"]
    rows = rows.withColumn("_bucket", F.shiftright(F.col(at).cast("long"), BUCKET_BITS))
    totals = rows.groupBy(*by).agg(
        F.count("*").alias("_rows"),
        *(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()),
        *(F.max_by(F.struct(c.alias("v")), at).alias(f"_before_{n}") for n, c in before.items()),
        *(F.max_by(c, F.when(c.isNotNull(), F.col(at))).alias(f"_latest_{n}") for n, c in latest.items()),
        *(F.min(c).alias(f"_least_{n}") for n, c in least.items()),
    )
    buckets = Window.partitionBy(*key).orderBy("_bucket")
    past = buckets.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        *(F.coalesce(F.sum(f"_sum_{n}").over(past), F.lit(0)).alias(f"_sum_{n}") for n in sums),
        *(F.lag(f"_before_{n}").over(buckets).alias(f"_before_{n}") for n in before),
        *(F.last(f"_latest_{n}", ignorenulls=True).over(past).alias(f"_latest_{n}") for n in latest),
        *(F.min(f"_least_{n}").over(past).alias(f"_least_{n}") for n in least),
    )
    inside = Window.partitionBy(*by).orderBy(at)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(offsets, by)
    return joined.select(
        *(F.col(c) for c in rows.columns if c != "_bucket"),
        *((F.coalesce(F.sum(c).over(so_far), F.lit(0)) + F.col(f"_sum_{n}")).cast("long").alias(n) for n, c in sums.items()),
        *(F.coalesce(F.lag(F.struct(c.alias("v"))).over(inside), F.col(f"_before_{n}"))["v"].alias(n) for n, c in before.items()),
        *(F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"_latest_{n}")).alias(n) for n, c in latest.items()),
        *(F.least(F.min(c).over(so_far), F.col(f"_least_{n}")).alias(n) for n, c in least.items()),
    )


def last_within(rows: DataFrame, key: list[str], end: Column, reach: Column, most: int, item: str) -> DataFrame:
    """rows with `_last`: the item of the key's row with the greatest `end` that is at most the row's `reach`, null if there is none.

    No row reaches further than `most` beyond its nearest such end (else it finds null), so ends are dealt out by buckets of
    16 * most and repeated only next to a bucket's edge: a search in sorted order without a join of ranges. Of equal ends the
    greatest item counts.
    """
    width = 16 * most
    spread = F.floor(end / width)
    near_edge = F.when(end - spread * width >= width - most, F.array(spread, spread + 1)).otherwise(F.array(spread))
    ends = rows.select(*key, F.explode(near_edge).alias("_bucket"), end.alias("_value"), F.lit(0).alias("_asks"), F.col(item).alias("_item"), F.lit(None).cast(f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in rows.schema if f.name not in key)}>").alias("_row"))
    own = F.struct(*(c for c in rows.columns if c not in key))
    asks = rows.select(*key, F.floor(reach / width).alias("_bucket"), reach.alias("_value"), F.lit(1).alias("_asks"), F.lit(None).cast(rows.schema[item].dataType).alias("_item"), own.alias("_row"))
    order = Window.partitionBy(*key, "_bucket").orderBy("_value", "_asks", "_item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ends.unionByName(asks).withColumn("_last", F.last("_item", ignorenulls=True).over(order))
    return found.filter("_asks = 1").select(*key, "_row.*", "_last")
