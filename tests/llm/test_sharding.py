import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fluvial.llm import sharding


def assigned(spark, ids, tree):
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r.doc_id: r.shard for r in sharding.assign_shard(df, df.doc_id, tree).collect()}


def plain(key, tree):
    """The same walk down the tree, from the hash's definition."""

    def draw(name, weight):
        import math

        seed = xxhash.xxh64(key.to_bytes(8, "little", signed=True), 42).intdigest()
        bits = xxhash.xxh64(name.encode(), seed).intdigest() >> 11
        return -math.log((bits + 0.5) / 2**53) / weight

    def least(level, weights):
        return min(weights, key=lambda i: (draw(f"{level}{i}", weights[i]), i)) if len(weights) > 1 else next(iter(weights))

    regions, racks = {}, {}
    for s in tree:
        regions[s.region] = regions.get(s.region, 0) + s.weight
    region = least("region", regions)
    for s in tree:
        if s.region == region:
            racks[s.rack] = racks.get(s.rack, 0) + s.weight
    rack = least("rack", racks)
    return least("shard", {s.shard: s.weight for s in tree if s.rack == rack})


def test_walk_equals_definition(spark):
    tree = [s._replace(weight=1 + s.shard % 3) for s in sharding.topology(25)]
    got = assigned(spark, range(-50, 450), tree)
    assert got == {i: plain(i, tree) for i in range(-50, 450)}


def test_growth_confined(spark):
    ids = range(6000)
    a, b = assigned(spark, ids, sharding.topology(24)), assigned(spark, ids, sharding.topology(25))
    assert all(b[i] in (a[i], 24) for i in ids)
    assert 6000 / 25 * 0.7 < sum(x == 24 for x in b.values()) < 6000 / 25 * 1.3
    assert all(250 * 0.7 < n < 250 * 1.4 for n in Counter(a.values()).values()) and len(set(a.values())) == 24
    heavier = [s._replace(weight=2.0) if s.shard == 5 else s for s in sharding.topology(24)]
    c = assigned(spark, ids, heavier)
    moved = [i for i in ids if c[i] != a[i]]
    assert moved and all(c[i] // 8 == 0 for i in moved)  # only into the region of the shard whose weight changed
    inside = [i for i in moved if a[i] // 8 == 0]
    assert all(c[i] // 4 == 1 for i in inside) and all(c[i] == 5 for i in inside if a[i] // 4 == 1)


def test_documents(spark):
    rows = [(i % 700, f"text é {i % 300}", "x", 1) for i in range(1500)] + [(None, None, None, None), (None, "", "y", 2), (3, "z" * 200_000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot long")
    got = sharding.shard_documents(docs, sharding.topology(24), sharding.topology(25)).collect()
    data = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(data(t)) + 8, zlib.crc32(data(t))) for i, t, _, _ in rows)
    for s in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in own]
        assert keys == sorted(keys)
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert sharding.shard_documents(docs.limit(0), sharding.topology(2), sharding.grow(sharding.topology(2))).count() == 0


def test_a_shard_more_takes_rows_into_itself_alone_at_every_count(spark):
    rows = spark.range(3000).withColumnRenamed("id", "doc_id")
    for n in [*range(1, 13), 20, 23, 24, 25, 40]:
        tree = sharding.topology(n)
        both = sharding.assign_shard(sharding.assign_shard(rows, F.col("doc_id"), tree), F.col("doc_id"), sharding.grow(tree), "grown")
        moved = both.filter("shard <> grown").groupBy("grown").count().collect()
        assert [r.grown for r in moved] == [n] and 0.4 * 3000 / (n + 1) < moved[0]["count"] < 2 * 3000 / (n + 1)
    assert sharding.grow(sharding.topology(24)) == sharding.topology(25) and sharding.grow([])[0] == sharding.Shard(0, 0, 0)
    docs = rows.withColumn("text", F.lit("x"))
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, sharding.topology(20), sharding.topology(21))
