"""Exact top-k by inner product: a KD-tree for each shard, searched best-first.

Shards are the cells of a few median splits that a bounded sample of vectors gives; every vector is put in its cell,
and a cell that many (or many equal) vectors fill is dealt over several shards. Each shard keeps one tree of median
splits, with the tight box of every node, as one row of the index.
A query first searches the shard of its own cell. Its k-th best score then goes along to the other shards: to those
alone whose box allows a better score, found by way of boxes around groups of shards (few enough to broadcast, bounded by
bytes); and there only nodes whose box allows one are opened, best box first. A box bounds the inner product by taking,
component by component, the better of its two sides. Equal scores are never pruned, so ties go to the smaller id exactly.
A shard's tree is read once for each QUERIES queries that its box lets in.

Scores are exact integers: float64 while no sum can reach 2**53, else int64, and Python's integers from 2**62 on.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.staging import bounded_batches, discard, join_skewed, materialize

SCALE = 64
#: Vectors of a shard, of a leaf; queries searched together, and of a task.
SHARD, LEAF, TOGETHER, QUERIES = 8_192, 64, 512, 20_000
#: Bytes of the sample that places the splits, and of the groups' boxes that are broadcast; parts of a cell in one group.
SAMPLE_BYTES, BOX_BYTES, PARTS = 16 << 20, 16 << 20, 4_096
KEY = ["dim", "shard", "part"]
GROUP = ["dim", "cells", "parts"]
#: The largest number of a decimal(38, 0), in which scores from 2**62 on travel.
WIDEST = 10**38 - 1
LOWEST = {np.float64: -np.inf, np.int64: np.iinfo(np.int64).min, object: -(10**90)}


def scaled(embedding: Column) -> Column:
    """floor(64 * x) of each component, x as double; a whole number in a double. (floor gives longs, and doubles from 2**52 on are whole.)"""

    def one(x: Column) -> Column:
        y = x.cast("double") * SCALE
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.transform(embedding, one)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and whole-number vector of the rows without a null or non-finite component. A null vec_id takes no part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def arithmetic(dim: int, most: float) -> type:
    """The numbers in which no inner product of vectors of this length, with components up to `most`, is rounded."""
    bound = max(dim, 1) * int(most) ** 2
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def exact(v: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers in float64 as another kind of numbers."""
    if kind is object:
        out = np.empty(v.shape, object)
        out.ravel()[:] = [int(x) for x in v.ravel()]
        return out
    return v.astype(kind, copy=False)


class Router:
    """Median splits down to about `cells` cells: at node i, component `at[i]` decides, under `cut[i]` goes left."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.depth = max(0, (max(cells, 1) - 1).bit_length()) if sample.size else 0
        self.at, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        groups = {1: sample}
        for i in range(1, 1 << self.depth):
            own = groups.pop(i, sample[:0])
            if len(own):
                self.at[i] = np.argmax(own.var(axis=0))
                self.cut[i] = np.median(own[:, self.at[i]])
            left = own[:, self.at[i]] < self.cut[i]
            groups |= {2 * i: own[left], 2 * i + 1: own[~left]}

    def cells(self, v: np.ndarray) -> np.ndarray:
        node = np.ones(len(v), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (v[np.arange(len(v)), self.at[node]] >= self.cut[node])
        return node - (1 << self.depth)


class Tree:
    """Median splits of the vectors v; nodes are ranges of the reordered vectors with their boxes. Node i has children 2i+1, 2i+2."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(v))
        self.depth = max(0, (-(-max(len(v), 1) // leaf) - 1).bit_length())
        size = (1 << (self.depth + 1)) - 1
        self.start, self.end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.end[0] = len(v)
        for i in range((1 << self.depth) - 1):
            a, b = self.start[i], self.end[i]
            mid = (a + b) // 2
            if b - a > 1 and v.shape[1]:
                own = v[order[a:b]]
                order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(np.ptp(own, axis=0))], mid - a)]
            self.start[2 * i + 1], self.end[2 * i + 1], self.start[2 * i + 2], self.end[2 * i + 2] = a, mid, mid, b
        self.ids, self.v = ids[order], v[order]
        self.box()

    def box(self) -> None:
        shape = (len(self.start), self.v.shape[1])
        self.lo, self.hi = np.zeros(shape), np.zeros(shape)
        for i in range(len(self.start)):
            if self.end[i] > self.start[i]:
                own = self.v[self.start[i] : self.end[i]]
                self.lo[i], self.hi[i] = own.min(axis=0), own.max(axis=0)

    @classmethod
    def stored(cls, ids: bytes, v: bytes, dim: int, leaf: int = LEAF, kind: type = np.float64) -> Tree:
        """A tree whose vectors were stored in its order: the ranges follow from their number."""
        tree = cls.__new__(cls)
        tree.ids, n = np.frombuffer(ids, np.int64), len(ids) // 8
        tree.v = np.frombuffer(v, np.float64).reshape(n, dim)
        tree.depth = max(0, (-(-max(n, 1) // leaf) - 1).bit_length())
        size = (1 << (tree.depth + 1)) - 1
        tree.start, tree.end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        tree.end[0] = n
        for i in range((1 << tree.depth) - 1):
            a, b = tree.start[i], tree.end[i]
            tree.start[2 * i + 1 : 2 * i + 3], tree.end[2 * i + 1 : 2 * i + 3] = (a, (a + b) // 2), ((a + b) // 2, b)
        tree.box()
        tree.v, tree.lo, tree.hi = exact(tree.v, kind), exact(tree.lo, kind), exact(tree.hi, kind)
        return tree

    def search(self, ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of each query's k best of scores of at least its kth. All numbers are of the tree's kind."""
        kth, up, down = kth.copy(), np.maximum(q, 0), np.minimum(q, 0)
        low = LOWEST[object if q.dtype == object else q.dtype.type]
        top = np.full((len(q), k), low, q.dtype)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def bound(node: int, of: np.ndarray) -> np.ndarray:
            return up[of] @ self.hi[node] + down[of] @ self.lo[node]

        def turn(best: np.ndarray) -> int | float:  # the heap gives its least first
            most = best.max()
            return -(most.item() if isinstance(most, np.generic) else most)

        everyone = np.arange(len(q))
        first = bound(0, everyone)
        heap = [(turn(first), 0, everyone, first)] if len(self.ids) and len(q) else []
        while heap:
            _, node, of, best = heapq.heappop(heap)
            of = of[best >= kth[of]]
            if not len(of):
                continue
            if 2 * node + 1 < len(self.start):
                for child in (2 * node + 1, 2 * node + 2):
                    if self.end[child] > self.start[child]:
                        b = bound(child, of)
                        keep = b >= kth[of]
                        if keep.any():
                            heapq.heappush(heap, (turn(b[keep]), child, of[keep], b[keep]))
                continue
            a, b = self.start[node], self.end[node]
            scores = q[of] @ self.v[a:b].T
            scores[self.ids[a:b][None, :] == ids[of][:, None]] = low
            r, c = np.nonzero((scores >= kth[of][:, None]) & (scores > low))
            if len(r):
                found.append((of[r], self.ids[a + c], scores[r, c]))
                held += len(r)
                both = np.concatenate([top[of], scores], axis=1)
                top[of] = np.partition(both, -k, axis=1)[:, -k:]
                kth[of] = np.maximum(kth[of], top[of].min(axis=1))
                if held > 1_000_000:
                    found = [best_of(*map(np.concatenate, zip(*found, strict=True)), k)]
                    held = len(found[0][0])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, q.dtype)
        return best_of(*map(np.concatenate, zip(*found, strict=True)), k)


def best_of(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(of)), key=lambda i: (of[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, of))
    of, ids, scores = of[order], ids[order], scores[order]
    first = np.searchsorted(of, of, side="left")
    keep = np.arange(len(of)) - first < k
    return of[keep], ids[keep], scores[keep]


class Numbers:
    """How scores travel between tasks: as long, or as decimal(38, 0) where a table's vectors need more."""

    def __init__(self, kinds: dict[int, type]) -> None:
        self.kinds = kinds
        self.wide = object in kinds.values()
        self.sql = "decimal(38, 0)" if self.wide else "long"

    def column(self, scores: list) -> pa.Array:
        if self.wide:
            return pa.array([None if s is None else Decimal(max(-WIDEST, min(WIDEST, int(s)))) for s in scores], pa.decimal128(38, 0))
        return pa.array([None if s is None else int(s) for s in scores], pa.int64())

    def thresholds(self, column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
        """k-th scores; null is below all."""
        low = LOWEST[kind]
        return np.array([low if x is None else int(x) for x in column.to_pylist()], kind)


def _search(k: int, numbers: Numbers) -> Callable:
    def search(key: tuple, queries: pa.Table, index: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        kind = numbers.kinds[dim]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(index):
            ids, q = queries["vec_id"].to_numpy(), exact(matrix(queries["v"], dim), kind)
            kth = numbers.thresholds(queries["kth"], kind)
            tree = Tree.stored(index["ids"][0].as_py(), index["vectors"][0].as_py(), dim, kind=kind)
            for at in range(0, len(q), TOGETHER):
                part = slice(at, at + TOGETHER)
                of, found, scores = tree.search(ids[part], q[part], kth[part], k)
                out.append((ids[part][of], found, scores))
        asked, found, scores = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": asked, "vec_id": found, "score": numbers.column(scores.tolist())})

    return search


def _allowed(q: np.ndarray, kth: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(query, box) positions where the box allows the query's kth score."""
    lo, hi = exact(lo, kind), exact(hi, kind)
    return np.nonzero(np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T >= kth[:, None])


def _expand(numbers: Numbers) -> Callable:
    """From queries that meet a group to pairs of a query and a shard other than its own."""

    def expand(key: tuple, queries: pa.Table, boxes: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        kind = numbers.kinds[dim]
        out = queries.slice(0, 0).drop_columns([c for c in queries.column_names if c not in (*KEY, "vec_id", "v", "kth")]).select([*KEY, "vec_id", "v", "kth"])
        if not len(queries) or not len(boxes):
            return out
        lo, hi, shards, parts = matrix(boxes["lo"], dim), matrix(boxes["hi"], dim), boxes["shard"].to_numpy(), boxes["part"].to_numpy()
        tables = []
        for at in range(0, len(queries), TOGETHER):
            own = queries.slice(at, TOGETHER)
            r, c = _allowed(exact(matrix(own["v"], dim), kind), numbers.thresholds(own["kth"], kind), lo, hi, kind)
            other = (own["shard"].to_numpy()[r] != shards[c]) | (own["part"].to_numpy()[r] != parts[c])
            r, c = pa.array(r[other]), c[other]
            tables.append(pa.table([own["dim"].take(r), pa.array(shards[c]), pa.array(parts[c]), own["vec_id"].take(r), own["v"].take(r), own["kth"].take(r)], [*KEY, "vec_id", "v", "kth"]))
        return pa.concat_tables(tables)

    return expand


def _meet(pairs: DataFrame, table: DataFrame, key: list[str], together: Callable, schema: str) -> DataFrame:
    """together(key, queries, rows of the table) for each key of pairs, a stored table of queries, in blocks of about QUERIES.

    The table's rows of a key are repeated for that key's blocks alone.
    """
    blocks = materialize(pairs.groupBy(*key).count().select(*key, F.ceil(F.col("count") / QUERIES).alias("blocks")), "blocks")
    dealt = join_skewed(pairs, blocks, key, ["vec_id"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks")
    copies = table.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    return dealt.groupBy(*key, "block").cogroup(copies.groupBy(*key, "block")).applyInArrow(together, schema)


def _routers(rows: DataFrame, counts: dict[int, int], shard_rows: int) -> dict[int, Router]:
    """Splits for each length of vectors, from a sample of SAMPLE_BYTES of all lengths together, or 64 vectors of each.

    Each row is drawn by itself with the share that its length's count allows: nothing is sorted or shuffled for it, and
    which rows are drawn moves the splits alone, no result.
    """
    share = max(64, SAMPLE_BYTES // (8 * max(1, sum(counts))))
    drawn = rows
    if counts:
        of_dim = F.create_map(*(F.lit(x) for d, n in counts.items() for x in (d, min(1.0, share / n))))
        drawn = rows.filter(F.rand(20) < of_dim[F.col("dim")])
    few = drawn.select("dim", "v").toArrow()
    dims = few["dim"].to_numpy()
    out = {}
    for dim, n in counts.items():
        own = few["v"].filter(pa.array(dims == dim))
        out[dim] = Router(matrix(own, dim), -(-n // shard_rows))
    return out


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every`, its k best among the others.

    The score is the inner product of the vectors scaled to whole numbers, exact whatever its size; ranks follow it up to
    38 digits, and a score that a long can't hold is given as the nearest long. Rows that are null, or hold a null or
    non-finite component, take no part; vectors of other lengths than the query's aren't compared with it. Rows with
    the query's own vec_id are no candidates; a repeated vec_id is else a candidate as often as it is there, and as a
    query it is asked once (its least vector). An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors).withColumn("dim", F.size("v"))
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    told = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(most).alias("most")).collect()  # a row for each length of vectors
    counts = {r["dim"]: r["n"] for r in told}
    numbers = Numbers({r["dim"]: arithmetic(r["dim"], r["most"]) for r in told})
    routers = _routers(rows, counts, shard_rows)
    shared = spark.sparkContext.broadcast(routers)  # splits: two numbers for each cell

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                cells = shared.value[int(dim)].cells(matrix(part["v"], int(dim)))
                yield pa.record_batch([part["vec_id"], part["v"], part["dim"], pa.array(cells)], ["vec_id", "v", "dim", "shard"])

    routed = rows.mapInArrow(route, "vec_id long, v array<double>, dim int, shard long").withColumn("row", F.monotonically_increasing_id())
    routed = materialize(routed, "routed")
    parts = routed.groupBy("dim", "shard").count().select("dim", "shard", F.ceil(F.col("count") / (2 * shard_rows)).alias("n"))
    placed = join_skewed(routed, parts, ["dim", "shard"], ["row"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("n")))
    placed = materialize(placed.select(*KEY, "vec_id", "v"), "placed")
    discard(routed)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        tree = Tree(table["vec_id"].to_numpy(), matrix(table["v"], dim))
        row = {"dim": dim, "shard": key[1].as_py(), "part": key[2].as_py(), "ids": tree.ids.tobytes(), "vectors": tree.v.tobytes(), "lo": tree.lo[0].tolist(), "hi": tree.hi[0].tolist()}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("part", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]))

    index = placed.groupBy(*KEY).applyInArrow(build, "dim int, shard long, part long, ids binary, vectors binary, lo array<double>, hi array<double>")
    index = materialize(index, "index")
    queries = placed.filter(F.col("vec_id") % every == 0)
    queries = queries.groupBy("vec_id").agg(F.min_by(F.struct(*KEY, "v"), F.struct("v", *KEY)).alias("q")).select("vec_id", "q.*")
    queries = materialize(queries, "queries")
    discard(placed)

    hits = f"query_id long, vec_id long, score {numbers.sql}"
    none = F.lit(None).cast(numbers.sql)
    home = queries.withColumn("kth", none).groupBy(*KEY).cogroup(index.groupBy(*KEY)).applyInArrow(_search(k, numbers), hits)
    home = materialize(home, "home")
    kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(none).alias("kth"))
    asked = queries.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select(*KEY, "vec_id", "v", "kth")
    away = materialize(_elsewhere(asked, index, routers, numbers), "away")
    other = _meet(away, index, KEY, _search(k, numbers), hits)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = home.unionByName(other).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    held = F.greatest(F.least(F.col("score"), F.lit(2**63 - 1).cast(numbers.sql)), F.lit(-(2**63)).cast(numbers.sql)) if numbers.wide else F.col("score")
    return found.select("query_id", "rank", "vec_id", held.cast("long").alias("score"))


def _elsewhere(asked: DataFrame, index: DataFrame, routers: dict[int, Router], numbers: Numbers) -> DataFrame:
    """A row for each query and shard, other than its own, whose box allows the query's kth score.

    Shards next to each other make groups; each query meets the boxes of all groups, and then those of the shards of the
    groups that allow it. The more cells there are, the more of them make a group, so that groups' boxes keep to BOX_BYTES.
    """
    shifts = {d: max(0, r.depth - max(0, (BOX_BYTES // (16 * max(1, sum(routers)))).bit_length() - 1)) for d, r in routers.items()}
    shift = F.create_map(*(F.lit(x) for kv in shifts.items() for x in kv))[F.col("dim")] if shifts else F.lit(0)
    boxes = index.select(*KEY, "lo", "hi", F.call_function("shiftright", F.col("shard"), shift).alias("cells"), F.floor(F.col("part") / PARTS).alias("parts"))

    def around(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        lo, hi = matrix(table["lo"], dim).min(axis=0), matrix(table["hi"], dim).max(axis=0)
        return pa.Table.from_pylist([{"dim": dim, "cells": key[1].as_py(), "parts": key[2].as_py(), "lo": lo.tolist(), "hi": hi.tolist()}], schema=pa.schema([("dim", pa.int32()), ("cells", pa.int64()), ("parts", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]))

    top = boxes.groupBy(*GROUP).applyInArrow(around, "dim int, cells long, parts long, lo array<double>, hi array<double>").toArrow()  # BOX_BYTES
    dims = top["dim"].to_numpy()
    groups = {}
    for dim in np.unique(dims).tolist():
        own = top.filter(pa.array(dims == dim))
        groups[dim] = own["cells"].to_numpy(), own["parts"].to_numpy(), matrix(own["lo"], dim), matrix(own["hi"], dim)
    shared = asked.sparkSession.sparkContext.broadcast(groups)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_dims = batch["dim"].to_numpy()
            for dim in np.unique(all_dims).tolist():
                part, kind = batch.filter(pa.array(all_dims == dim)), numbers.kinds[dim]
                cells, parts, lo, hi = shared.value[dim]
                r, c = _allowed(exact(matrix(part["v"], dim), kind), numbers.thresholds(part["kth"], kind), lo, hi, kind)
                for at in range(0, len(r), 10_000):
                    rr, cc = pa.array(r[at : at + 10_000]), c[at : at + 10_000]
                    yield pa.record_batch([*(part[x].take(rr) for x in (*KEY, "vec_id", "v", "kth")), pa.array(cells[cc]), pa.array(parts[cc])], [*KEY, "vec_id", "v", "kth", "cells", "parts"])

    schema = f"dim int, shard long, part long, vec_id long, v array<double>, kth {numbers.sql}"
    pairs = materialize(asked.mapInArrow(send, schema + ", cells long, parts long"), "groups_met")
    return _meet(pairs, boxes, GROUP, _expand(numbers), schema)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
