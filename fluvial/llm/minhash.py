"""Near-duplicate documents: sets of three-word shingles with a Jaccard similarity of at least 0.85, and their components.

1. One pass gives each set MINIMA minima under universal hash functions (odd multipliers modulo 2^64, upper half). Bands of
   ROWS minima are hashed to keys; sets that share a key are a bucket. A pair at the threshold shares none with a chance of
   (1 - 0.85^6)^40 = 6e-9, and more similar ones much less.
2. Candidates are verified by signature: the lower bytes of the minima must agree in AGREE places of 240 (a link fails that
   with a chance below 2e-11), and the parity bitmaps must leave room for enough overlap, which is a strict bound.
3. What passes is confirmed on the full sets, read again from the texts.
4. Links make components by alternating large-star and small-star steps.
A bucket never makes all of its pairs: its sets are tried against its first one. Only what is then still in different
components is compared further, in blocks inside tasks that hold the sets themselves: the sets of a bucket's largest
component meet its other sets alone, not each other. A pair is looked at under the first key that it shares, goes through
steps 2 and 3 on the spot unless its sets are connected by now, and a task gives out the links that connect, fewer than it
has sets. Copies of a set count as one set throughout.
Words are told apart by 128 bits of a hash and shingles by 64, under a key drawn for each job (see shingles.py).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.llm.shingles import bitmap, fold, mix, name, shingle_sets
from fluvial.staging import bounded_batches, discard, hot_keys, join_skewed, materialize, pick

WORDS, PERCENT = 3, 85
BANDS, ROWS = 40, 6
MINIMA, AGREE = BANDS * ROWS, 160
#: Shingles whose minima are taken at once; sets of a block and their shingles, on average; names that a task remembers.
SLICE, TILE, TILE_SHINGLES, SEEN = 1 << 15, 512, 1 << 21, 300_000
#: Rows of ids that make a task: tables that are counted are stored in so many rows a file at least.
TASK_ROWS = 50_000


def _stored(df: DataFrame, name: str, rows: int) -> DataFrame:
    """A stored table of at most so many short rows, in no more files than they need."""
    return materialize(df.coalesce(max(1, -(-rows // TASK_ROWS))), name)


def similar(overlap: int, n: int, m: int) -> bool:
    """100 * overlap >= 85 * union, in integers; arrays alike."""
    return 100 * overlap >= PERCENT * (n + m - overlap)


def multipliers(key: bytes) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(int.from_bytes(key, "little"))).integers(0, 1 << 64, MINIMA, np.uint64) | np.uint64(1)


def minima(sets: list[np.ndarray], by: np.ndarray) -> np.ndarray:
    """The minima of non-empty sets under each multiplier, a row a set."""
    out = np.empty((len(sets), len(by)), np.uint32)
    sizes = np.cumsum([len(s) for s in sets])
    first = 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + SLICE)))
        own = np.concatenate(sets[first:last])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]], dtype=np.int64)]).astype(np.int64)
        hashed = np.empty_like(own)
        for i, a in enumerate(by):
            np.multiply(own, a, out=hashed)
            out[first:last, i] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
        first = last
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        keys = mix((keys << np.uint64(1)) ^ keys ^ (rows[:, :, k] * np.uint64(0x9E3779B97F4A7C15)))
    return keys.view(np.int64)


def scan(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n, a, b (the set's name) and text_hash of each document; keys, sig and bits where a task meets a set first."""
    names = ["doc_id", "n", "a", "b", "text_hash", "keys", "sig", "bits"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = multipliers(key)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ns, ids, new, at = [], [], [], []
            for i, (s, low) in enumerate(shingle_sets(batch["text"], WORDS, key)):
                ns.append(len(s))
                ids.append(name(s, low))
                if len(s) and ids[-1] not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(ids[-1])
                    new.append(s)
                    at.append(i)
            found = minima(new, by)
            keys, sigs, bits = [None] * len(ns), [None] * len(ns), [None] * len(ns)
            for i, k, sig, s in zip(at, band_keys(found), found.astype(np.uint8), new, strict=True):
                keys[i], sigs[i], bits[i] = k, sig.tobytes(), bitmap(s).tobytes()
            a, b = zip(*ids, strict=True) if ids else ((), ())
            yield pa.record_batch([batch["doc_id"], pa.array(ns, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), batch["text_hash"], pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(bits, pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return materialize(rows.mapInArrow(read, "doc_id long, n long, a long, b long, text_hash long, keys array<long>, sig binary, bits binary"), "minima")


def _buckets(sets: DataFrame) -> DataFrame:
    """key, sid, n, first and large (three sets or more) of the buckets of several sets; first is a bucket's least sid."""
    rows = sets.select(F.explode("keys").alias("key"), "sid", "n")
    shared = rows.groupBy("key").agg(F.min("sid").alias("first"), F.max("sid").alias("last"), F.count("*").alias("k")).filter("first <> last")
    shared = materialize(shared.select("key", "first", (F.col("k") > 2).alias("large")), "shared_keys")
    met = materialize(pick(rows, shared.select("key"), "key"), "met")
    found = materialize(join_skewed(met, shared, ["key"], ["sid"]), "buckets")
    discard(shared, met)
    return found


def _with_both(pairs: DataFrame, sets: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Stored pairs (x, y) with the given columns of both sets, those of y by their second names. A set may be in very many pairs."""
    one = join_skewed(pairs, sets.select(F.col("sid").alias("x"), *columns), ["x"], ["y"])
    second, hot = sets.select(F.col("sid").alias("y"), *(F.col(c).alias(d) for c, d in columns.items())), hot_keys(pairs, ["y"])
    return one.join(second, "y") if hot is None else join_skewed(one, second, ["y"], ["x"], hot=hot)


def _may_link(sig: np.ndarray, sig2: np.ndarray, n: np.ndarray, m: np.ndarray, bits: list[bytes], bits2: list[bytes]) -> np.ndarray:
    """Which pairs agree in enough minima and have bits that leave room for enough overlap."""
    keep = (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((sig == sig2).sum(axis=1) >= AGREE)
    for i in np.flatnonzero(keep).tolist():
        x, y = np.frombuffer(bits[i], np.uint64), np.frombuffer(bits2[i], np.uint64)
        width = min(len(x), len(y))
        differ = int(np.bitwise_count(fold(x, width) ^ fold(y, width)).sum())
        keep[i] = similar((int(n[i]) + int(m[i]) - differ) // 2, int(n[i]), int(m[i]))
    return keep


def _signatures(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), MINIMA)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {k: batch[k].to_pylist() for k in ("sig", "sig2", "bits", "bits2")}
        keep = _may_link(_signatures(c["sig"]), _signatures(c["sig2"]), batch["n"].to_numpy(), batch["m"].to_numpy(), c["bits"], c["bits2"])
        yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y"])


def _similar_sets(p: pa.BinaryScalar, q: pa.BinaryScalar) -> bool:
    x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
    return similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_similar_sets(p, q) for p, q in zip(batch["shingles"], batch["shingles2"], strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y"])


def _full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, key: bytes) -> DataFrame:
    """sid and shingles of the sets in `wanted` (sid), read from one text of each."""
    own = materialize(sets.select("sid", "a", "b", "text_hash").join(wanted, "sid", "left_semi"), "wanted")
    hashes = own.select("text_hash")  # of one text a set, so hardly any twice

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for s, low in shingle_sets(batch["text"], WORDS, key):
                ab = name(s, low)
                if ab not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(ab)
                    out.append((*ab, s.tobytes()))
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["a", "b", "shingles"])

    rows = pick(docs.select("text", F.xxhash64("text").alias("text_hash")), hashes, "text_hash").select("text")
    found = rows.mapInArrow(read, "a long, b long, shingles binary").dropDuplicates(["a", "b"])
    return materialize(found.join(own, ["a", "b"]).select("sid", "shingles"), "full_sets")


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame, key: bytes) -> DataFrame:
    """Of candidate pairs (x, y) the links."""
    pairs = materialize(pairs, "pairs")
    n = pairs.count()
    both = _with_both(pairs, sets, {"n": "m", "sig": "sig2", "bits": "bits2"})
    near = _stored(both.select("x", "y", "n", "m", "sig", "sig2", "bits", "bits2").mapInArrow(_verified, "x long, y long"), "near", n)
    discard(pairs)
    if near.isEmpty():
        return near
    full = _full_sets(docs, sets, near.select(F.col("x").alias("sid")).union(near.select("y")).distinct(), key)
    links = _with_both(near, full, {"shingles": "shingles2"}).select("x", "y", "shingles", "shingles2").mapInArrow(_confirmed, "x long, y long")
    links = _stored(links, "links", n)
    discard(near, full)
    return links


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours. The n edges (x, y) have x > y, before and after."""
    both = _stored(edges.union(edges.select("y", "x")).toDF("node", "other"), "both", 2 * n)
    least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
    out = join_skewed(both, least, ["node"], ["other"]).filter("other > node").select(F.col("other").alias("x"), F.col("least").alias("y"))
    out = _stored(out.distinct(), "large_star", n)
    discard(both)
    return out


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("x").agg(F.min("y").alias("least"))
    joined = join_skewed(edges, least, ["x"], ["y"])
    # a node's edge to the least stays, its other neighbours get one
    moved = joined.select(F.when(F.col("y") == F.col("least"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("least").alias("y"))
    return _stored(moved.distinct(), "small_star", n)


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """sid and label, the least sid of its component, of the sets that have links and aren't the least themselves.

    known: the same of older links, which needn't be given again.

    Alternates large-star and small-star until neither changes an edge: then each component is a star around its least
    set. The number of rounds grows with the logarithm of the longest path. Each step's edges are written to the shared
    folder; a set with very many links is dealt over salts.
    """
    links = links.select("x", "y") if known is None else links.select("x", "y").union(known.select("sid", "label"))
    edges = materialize(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.xxhash64("y", "x").cast("decimal(38,0)"))).first())

    now = mark(edges)
    while True:
        large = large_star(edges, now[0])
        after = small_star(large, now[0])
        discard(edges, large)
        edges, before, now = after, now, mark(after)
        if now == before:
            return edges.select(F.col("x").alias("sid"), F.col("y").alias("label"))


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """key, sid, n, label of the buckets of three sets or more that aren't in one component."""
    known = buckets.filter("large").select("key", "sid", "n").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    known = materialize(known, "labelled")
    open_ = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    found = materialize(join_skewed(known, open_, ["key"], ["sid"]), "apart")
    discard(known)
    return found


TILE_KEY = ["key", "i", "j"]


def _dealt(apart: DataFrame) -> DataFrame:
    """key, i, j, block, sid, label and n of the sets of each tile, of a stored table.

    A bucket of one block is a tile. In a larger one, only the sets outside its largest component meet all others: their
    blocks come first and meet each other and those of that component, which don't meet.
    """
    parts = apart.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    sizes = parts.groupBy("key").agg(F.max(F.struct("rows", "shingles", "label")).alias("most"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    blocks = lambda rows, shingles: F.greatest(F.ceil(rows / TILE), F.ceil(shingles / TILE_SHINGLES)).cast("int")
    whole, most = blocks(F.col("rows"), F.col("shingles")) == 1, F.col("most")
    sizes = sizes.select(
        "key",
        F.when(~whole, most["label"]).alias("main"),
        F.when(whole, 1).otherwise(blocks(F.col("rows") - most["rows"], F.col("shingles") - most["shingles"])).alias("apart"),
        F.when(whole, 0).otherwise(blocks(most["rows"], most["shingles"])).alias("together"),
    )
    rows = join_skewed(apart, sizes, ["key"], ["sid"])
    inside, at = F.col("main").eqNullSafe(F.col("label")), F.xxhash64("sid")
    rows = rows.withColumn("block", F.when(inside, F.col("apart") + F.pmod(at, F.greatest("together", F.lit(1)))).otherwise(F.pmod(at, "apart")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("apart") + F.when(inside, 0).otherwise(F.col("together")) - 1)))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "label", "n")


def _left_over(apart: DataFrame, sets: DataFrame, docs: DataFrame, key: bytes) -> DataFrame:
    """Links between different components of one bucket that connect all that its links connect; a task compares two blocks of a bucket."""
    full = _full_sets(docs, sets, apart.select("sid").distinct(), key)
    held = full.join(sets.select("sid", "sig", "bits", "keys"), "sid")
    rows = _dealt(apart).join(held, "sid")
    dealt = rows.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    links = materialize(dealt.select(*TILE_KEY, "block", "sid", "label", "n", "sig", "bits", "keys", "shingles").mapInArrow(_tiles, "x long, y long"), "links")
    discard(full)
    return links


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of tiles, whose rows come together; the last tile of a batch waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = np.stack([rows[c].to_numpy().astype(np.int64) for c in TILE_KEY])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            yield from _tile(rows.slice(start, end - start))
        held = rows.slice(starts[-1])
    if held is not None and held.num_rows:
        yield from _tile(held)


def _tile(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of one tile between sets that nothing else connects so far; a pair that shares several keys is looked at under the first of them alone, where it may have been tried already."""
    sid, label, n, block = (rows[c].to_numpy() for c in ("sid", "label", "n", "block"))
    sig, bits, sets = _signatures(rows["sig"].to_pylist()), rows["bits"].to_pylist(), rows["shingles"].combine_chunks()
    keys, own = np.array(rows["keys"].to_pylist(), np.int64), rows["key"][0].as_py()
    one_block = rows["i"][0].as_py() == rows["j"][0].as_py()
    root = label.copy()  # each set's component, by what is linked here too
    x, y = [], []
    for at in range(len(sid)):
        later = np.arange(at + 1, len(sid))
        later = later[(root[later] != root[at]) & (one_block | (block[later] != block[at]))]
        common = keys[later] == keys[at]
        later = later[keys[at][common.argmax(axis=1)] == own]
        if not len(later):
            continue
        first = np.full(len(later), at)
        keep = _may_link(sig[first], sig[later], n[first], n[later], [bits[at]] * len(later), [bits[k] for k in later.tolist()])
        for k in later[keep].tolist():
            if root[k] != root[at] and _similar_sets(sets[at], sets[k]):
                root[root == root[k]] = root[at]
                x.append(min(sid[at], sid[k]))
                y.append(max(sid[at], sid[k]))
    if x:
        yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a set is the distinct shingles of three words, or the whole
    sequence of fewer words. A null or empty text, or one of white space, has no shingles and is a component of its own.
    Rows with equal sets are linked. component_id is the least doc_id of a component, null only if all are null; kept tells
    whether that is the row's own (null as null). Texts of any length are read whole; a repeated row is a copy like
    another. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    bounded_batches(docs.sparkSession)
    key = os.urandom(16)
    docs = docs.select("doc_id", "text")
    rows = scan(docs, key)
    sets = rows.filter("keys is not null").select("a", "b", "n", "text_hash", "keys", "sig", "bits").dropDuplicates(["a", "b"])
    sets = materialize(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    buckets = _buckets(sets)
    links = _links(buckets.filter("sid <> first").select(F.col("first").alias("x"), F.col("sid").alias("y")).distinct(), sets, docs, key)
    labels = components(links)
    apart = _apart(buckets, labels)
    if not apart.isEmpty():
        labels = components(_left_over(apart, sets, docs, key), labels)
    discard(apart)
    discard(buckets)

    whole = sets.select("a", "b", "sid").join(labels, "sid", "left").select("a", "b", F.coalesce("label", "sid").alias("label"))
    least = rows.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least"))
    known = materialize(whole.join(least, ["a", "b"]), "known")
    least = materialize(known.groupBy("label").agg(F.min("least").alias("component_id")), "least_ids")
    of_sets = materialize(join_skewed(known, least, ["label"], ["a", "b"]).select("a", "b", "component_id"), "components")
    discard(known, least, sets)
    full = join_skewed(rows.filter("n > 0").select("doc_id", "n", "a", "b"), of_sets, ["a", "b"], ["doc_id"]).select("doc_id", "n", "component_id")
    out = full.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
), c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
