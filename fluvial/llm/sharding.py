"""Sharding by a weighted hash tree: region, rack, shard.

At each level a row draws -ln(u) / weight for every child of the node it is in, u being a hash of the row's key
and the child's name, and goes to the child with the least draw. A child's draw depends on nothing but its own name
and weight. So a change of weights moves rows only into (or out of) the children whose weights change, and the
subtrees of the other children keep their rows where they are. A shard that opens a region of its own gains rows
from all over and no other shard gains any.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.staging import number_within


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """Equal shards, numbered through: `per_rack` in a rack, `racks` in a region; the last region may be partly filled.

    A shard more changes the weight of that region, and rows that come to it may go to any of its shards: see `grow`.
    """
    return [Shard(s // (racks * per_rack), s // per_rack, s) for s in range(shards)]


def grow(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree and a shard more, in a region and a rack of its own: rows move into the new shard and nowhere else."""
    return [*tree, Shard(*(max((s[i] for s in tree), default=-1) + 1 for i in range(3)), weight)]


def draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 53 bits of a hash of key and name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))) / F.lit(float(weight))


def _least(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct(draw(key, f"{level}{i}", w).alias("d"), F.lit(i).alias("i")) for i, w in sorted(weights.items())]
    return F.array_min(F.array(*draws))["i"]


def _by_parent(parent: Column, choices: dict[int, Column]) -> Column:
    """choices[parent], evaluated only for the parent that holds."""
    (first, column), *rest = choices.items()
    out = F.when(parent == first, column)
    for k, column in rest:
        out = out.when(parent == k, column)
    return out


def assign_shard(df: DataFrame, key: Column, tree: Sequence[Shard], out: str = "shard") -> DataFrame:
    """Add the column `out` (int): the shard that each row's key draws in the tree.

    All rows with a null key go to one shard, as equal keys do. A weight must be above 0.
    """
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for s in tree:
        if s.weight <= 0:
            raise ValueError("weights must be above 0")
        regions.setdefault(s.region, {}).setdefault(s.rack, {})[s.shard] = s.weight
    if not regions:
        raise ValueError("a tree needs a shard")
    of_racks = {r: {k: sum(v.values()) for k, v in racks.items()} for r, racks in regions.items()}
    region, rack = f"_{out}_region", f"_{out}_rack"
    df = df.withColumn(region, _least(key, "region", {r: sum(v.values()) for r, v in of_racks.items()}))
    df = df.withColumn(rack, _by_parent(F.col(region), {r: _least(key, "rack", v) for r, v in of_racks.items()}))
    shards = {k: v for racks in regions.values() for k, v in racks.items()}
    return df.withColumn(out, _by_parent(F.col(rack), {k: _least(key, "shard", v) for k, v in shards.items()}).cast("int")).drop(region, rack)


def shard_documents(docs: DataFrame, tree: Sequence[Shard], grown: Sequence[Shard]) -> DataFrame:
    """Law `key`: doc_id and the tree decide each document's shard, now and with the grown tree, which must have a shard more in a region of its own.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32 (0 for null), law, shard, slot
    (gapless from 0 in doc_id order, null first; ties by checksum and size) and grown_shard. Rows with equal doc_id
    share a shard; a null doc_id is a key like any other. Texts of any length are measured whole; repeated rows have slots
    of their own. An empty table gives an empty result. Other columns of docs, whatever their names, are ignored.
    """
    more = set(grown) - set(tree)
    if len(more) != 1 or len(grown) != len(tree) + 1 or any(s.region in {t.region for t in tree} for s in more):
        raise ValueError("the grown tree must have one shard more, in a region of its own")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign_shard(rows, F.col("doc_id"), tree)
    rows = assign_shard(rows, F.col("doc_id"), grown, "grown_shard")
    rows = number_within(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
