"""Self-join of documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

Only sets that share one of their first shingles can be that similar (a prefix filter; the order puts frequent
shingles last, as a sketch over all documents tells). Sets that share such a shingle form its list.
1. In each list, the first set is tried against the others: pairs in proportion to the list. The first is the one
   with the fewest shingles that aren't frequent: of many near copies, the one that differs least from the rest.
   Frequent shingles' lists are dealt over salts, and the salts' first sets are tried against the first of them.
   Links make components.
2. In lists of several components, the set with the most links so far is tried against those of other components.
3. What is left are pairs of one list in different components. Lists in one component are done; the other ones are
   cut into size-banded tiles of bounded size, in which bitmap signatures are compared.
A pair goes to the exact intersection of sorted arrays only if the bit counts allow it: the bitmaps are parities, so
bits that differ are no more than shingles that are not shared, which bounds the overlap from above.
No pair over the threshold is lost, and copies of a set count as one set throughout. Words are told apart by 128 bits,
shingles by 96 in the exact intersection, under a key drawn for each job (see shingles.py).
No join rests on a key being rare: whatever holds a large share of the rows is dealt over salts.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.components import connected_components
from fluvial.llm.shingles import KEY, bitmap, fold, name, overlap, shingle_sets
from fluvial.staging import bounded_batches, discard, hot_keys, join_skewed, materialize, pick

WORDS = 5
#: Counters of the sketch that tells frequent shingles, at least and at most (4 bytes each in a task); frequent: so many times the mean, and more than LEAST.
MIN_COUNTERS, MAX_COUNTERS, CHUNK, TIMES, LEAST = 1 << 16, 1 << 24, 1 << 14, 4, 64
SALTS = 16
#: Sets of a block; a tile compares two blocks.
TILE = 512
SEEN = 300_000
_BAND = math.log(1.25)


def similar(overlap: int, n: int, m: int) -> bool:
    """100 * overlap >= 80 * union, in integers."""
    return 100 * overlap >= 80 * (n + m - overlap)


def prefix_length(n: int) -> int:
    """So many first shingles of a set of n meet those of any set similar to it."""
    return n - (80 * n + 99) // 100 + 1 if n else 0


def _close(n: str, m: str) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * 80


def shingle_table(docs: DataFrame, key: bytes = KEY) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, a, b (the set's name), bits and text_hash for each document; and a bit for each counter of all documents' shingles: frequent or not."""
    counters = min(MAX_COUNTERS, max(MIN_COUNTERS, 1 << (4 * max(docs.count(), 1)).bit_length()))
    shift = np.uint64(64 - counters.bit_length() + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int32)
        for batch in batches:
            found, ns, names, bits = [], [], [], []
            for s, low in shingle_sets(batch["text"], WORDS, key):
                ns.append(len(s))
                names.append(name(s, low))
                bits.append(bitmap(s).tobytes())
                found.append((s >> shift).astype(np.int64))
            if found:
                places, n = np.unique(np.concatenate(found), return_counts=True)
                total[places] = np.minimum(total[places].astype(np.int64) + n, 2**31 - 1)
            a, b = zip(*names, strict=True) if names else ((), ())
            none = pa.nulls(len(ns), pa.int64())
            yield pa.record_batch([batch["doc_id"], pa.array(ns, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bits, pa.binary()), batch["text_hash"], none, pa.nulls(len(ns), pa.binary())], names_)
        for k in range(counters // CHUNK):
            part = total[k * CHUNK : (k + 1) * CHUNK]
            part = part.astype(np.uint8 if part.max() < 256 else np.int32)  # a task's counts are small
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield pa.record_batch([none, none, none, none, pa.nulls(1, pa.binary()), none, pa.array([k], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names_)

    names_ = ["doc_id", "n", "a", "b", "bits", "text_hash", "chunk", "counts"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    both = materialize(rows.mapInArrow(scan, "doc_id long, n long, a long, b long, bits binary, text_hash long, chunk long, counts binary"), "shingles")
    table = both.filter("chunk is null").select("doc_id", "n", "a", "b", "bits", "text_hash")
    least = max(LEAST, TIMES * (table.agg(F.sum("n")).first()[0] or 0) / counters)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK, np.int64)
        for batch in batches:
            for c in batch["counts"]:
                part = zlib.decompress(c.as_py())
                total += np.frombuffer(part, np.uint8 if len(part) == CHUNK else np.int32)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(total > least).tobytes()], pa.binary())], ["chunk", "frequent"])

    found = both.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk long, frequent binary").collect()  # a bit a counter
    frequent = np.zeros(counters // 8, np.uint8)
    for k, part in found:
        frequent[k * CHUNK // 8 : (k + 1) * CHUNK // 8] = np.frombuffer(part, np.uint8)
    return table, frequent


def lists(docs: DataFrame, frequent: np.ndarray, key: bytes = KEY) -> DataFrame:
    """(token, salted, own, pos, a, b, la, lb): the sets that have the token among their first ones, and the first set of their list.

    own: the set's shingles that aren't frequent; pos: the token's place in the set's order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # a bit a counter
    counters = 8 * len(frequent)
    shift = np.uint64(64 - counters.bit_length() + 1)
    fields = ["token", "salt", "a", "b", "own", "pos"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(shared.value, count=counters).astype(bool)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            tokens, salts, names, lengths, owned = [], [], [], [], []
            for s, low in shingle_sets(batch["text"], WORDS, key):
                own = name(s, low)
                if not len(s) or own in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(own)
                late = often[(s >> shift).astype(np.int64)]
                k = prefix_length(len(s))
                rare, common = s[~late][:k], s[late]
                common = common[: k - len(rare)]
                tokens += [rare, common]
                salts += [np.full(len(rare), -1), np.full(len(common), own[0] % SALTS)]
                names.append(own)
                lengths.append(k)
                owned.append(len(s) - int(late.sum()))
            if names:
                ab = np.array(names, np.int64).repeat(lengths, axis=0)
                yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), pa.array(np.array(owned, np.int32).repeat(lengths)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]))], fields)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (token, salt, own, a, b). A token's first row is held back until a second set has it, unless it is salted."""
        held = None  # the last row so far: token, salt, a, b, own, pos, its list's first set, whether it was told
        for batch in batches:
            t, s, a, b, o, p = (batch[c].to_numpy() for c in fields)
            if held is not None:
                t, s, a, b, o, p = (np.concatenate([[x], y]) for x, y in zip(held[:6], (t, s, a, b, o, p), strict=True))
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
            again = np.concatenate([[False], ~new[1:] & (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
            at = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
            la, lb = a[at], b[at]
            if held is not None:
                of_held = at == 0
                la[of_held], lb[of_held] = held[6], held[7]
            followed = np.zeros(len(t), bool)  # the first of a list, and another set comes
            other = ~new & ~again
            followed[at[other]] = True
            tell = (other | (followed & new) | (new & (s >= 0))) & ~again
            if held is not None:
                tell[0] = not held[8] and (followed[0] or s[0] >= 0)
                told_held = held[8] or tell[0]
            last = len(t) - 1
            told = tell.copy()
            if held is not None:
                told[0] = told_held
            done = bool(told[last]) if not again[last] else bool(told[np.flatnonzero(~again)[-1]])
            held = (t[last], s[last], a[last], b[last], o[last], p[last], la[last], lb[last], done)
            if tell.any():
                yield pa.record_batch([pa.array(t[tell]), pa.array(s[tell] >= 0), pa.array(o[tell].astype(np.int32)), pa.array(p[tell].astype(np.int32)), pa.array(a[tell]), pa.array(b[tell]), pa.array(la[tell]), pa.array(lb[tell])], ["token", "salted", "own", "pos", "a", "b", "la", "lb"])

    entries = docs.select("text").mapInArrow(prefixes, "token long, salt int, a long, b long, own int, pos int")
    dealt = entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "own", "a", "b")
    return materialize(dealt.mapInArrow(meet, "token long, salted boolean, own int, pos int, a long, b long, la long, lb long"), "lists")


def _signs(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, n, bits of the named sets, and text_hash of one of their documents."""
    own = table.select("a", "b", F.struct("n", "bits", "text_hash").alias("s")).join(nodes, ["a", "b"], "left_semi")
    return materialize(own.groupBy("a", "b").agg(F.max_by("s", "s.text_hash").alias("s")).select("a", "b", "s.*"), "signs")


def _arrays(docs: DataFrame, hashes: DataFrame, key: bytes) -> DataFrame:
    """a, b, shingles (hi, lo) of the sets whose documents' text_hash is given, read from their texts again."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for s, low in shingle_sets(batch["text"], WORDS, key):
                own = name(s, low)
                if own not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(own)
                    out.append((*own, s.tobytes() + low.tobytes()))
            columns = zip(*out, strict=True) if out else [()] * 3
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "shingles"])

    rows = pick(docs.select("text", F.xxhash64("text").alias("text_hash")), materialize(hashes, "hashes"), "text_hash").select("text")
    return materialize(rows.mapInArrow(read, "a long, b long, shingles binary").dropDuplicates(["a", "b"]), "arrays")


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose differing bits leave room for enough overlap."""
    for batch in batches:
        keep = []
        for n, m, p, q in zip(*(batch[c].to_pylist() for c in ("n", "m", "bits", "bits2")), strict=True):
            x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            width = min(len(x), len(y))
            differ = int(np.bitwise_count(fold(x, width) ^ fold(y, width)).sum())
            keep.append(similar((n + m - differ) // 2, n, m))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "c", "d"])


def _set(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sorted arrays have enough in common."""
    for batch in batches:
        keep = []
        for p, q in zip(batch["shingles"], batch["shingles2"], strict=True):
            x, y = _set(p.as_buffer()), _set(q.as_buffer())
            keep.append(similar(overlap(x, y), len(x[0]), len(y[0])))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "c", "d"])


def _with_both(pairs: DataFrame, sets: DataFrame, other: dict[str, str]) -> DataFrame:
    """Pairs (a, b, c, d), a stored table, with the columns of both sets, those of the second renamed. A set may be in very many pairs."""
    one = join_skewed(pairs, sets, ["a", "b"], ["c", "d"])
    second, hot = sets.withColumnsRenamed({"a": "c", "b": "d"} | other), hot_keys(pairs, ["c", "d"])
    return one.join(second, ["c", "d"]) if hot is None else join_skewed(one, second, ["c", "d"], ["a", "b"], hot=hot)


def _verify(pairs: DataFrame, signs: DataFrame, docs: DataFrame, key: bytes) -> DataFrame:
    """Of pairs (a, b, c, d), the links. Only sets of pairs that the bits allow are read again for their arrays."""
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    near = _with_both(pairs, signs.select("a", "b", "n", "bits"), {"n": "m", "bits": "bits2"}).filter(_close("n", "m"))
    near = materialize(near.select("a", "b", "c", "d", "n", "m", "bits", "bits2").mapInArrow(_allowed, "a long, b long, c long, d long"), "near")
    if near.isEmpty():
        return near
    nodes = near.select("a", "b").union(near.select("c", "d")).distinct()
    arrays = _arrays(docs, signs.join(nodes, ["a", "b"], "left_semi").select("text_hash").distinct(), key)
    full = _with_both(near, arrays, {"shingles": "shingles2"})
    links = materialize(full.select("a", "b", "c", "d", "shingles", "shingles2").mapInArrow(_linked, "a long, b long, c long, d long"), "links")
    discard(pairs, near, arrays)
    return links


TILE_KEY = ["token", "tile", "i", "j"]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b, c, d) of tiles, whose rows come together; of a tile that batches cut, what has come is held back."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = np.stack([rows[c].to_numpy() for c in TILE_KEY])
        starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1])
        held = rows.slice(starts[-1])
        yield from _pairs_of(rows.slice(0, starts[-1]), starts)
    if held is not None and held.num_rows:
        yield from _pairs_of(held, np.array([0, held.num_rows]))


def _pairs_of(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    columns = {c: rows[c].to_numpy() for c in (*TILE_KEY, "block", "pos", "a", "b", "n", "label_a", "label_b")}
    bits = rows["bits"].to_pylist()
    out = []
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        x, y = _tile({c: v[start:end] for c, v in columns.items()}, bits[start:end])
        if len(x):
            out.append((start + x, start + y))
    if out:
        x, y = (np.concatenate(c) for c in zip(*out, strict=True))
        a, b = columns["a"], columns["b"]
        swap = (a[x] > a[y]) | ((a[x] == a[y]) & (b[x] > b[y]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        yield pa.record_batch([pa.array(c) for c in (a[x], b[x], a[y], b[y])], ["a", "b", "c", "d"])


def _tile(t: dict[str, np.ndarray], raw: list[bytes], step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that are in different components, close in size, and may meet in the token first and have enough in common by their bits."""
    n, pos, la, lb, block = t["n"], t["pos"], t["label_a"], t["label_b"], t["block"]
    own, i, j = _band(n) == t["tile"][0], t["i"][0], t["j"][0]
    words = np.array([len(x) // 8 for x in raw])
    width = int(words.min())
    bits = np.empty((len(raw), width), np.uint64)
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        bits[at] = fold(np.frombuffer(b"".join([raw[k] for k in at]), np.uint64).reshape(len(at), w), width)
    left, order = np.flatnonzero(own), np.arange(len(n))
    xs, ys = [], []
    for at in range(0, len(left), step):
        x = left[at : at + step, None]
        both = n[x] + n
        ok = ((la[x] != la) | (lb[x] != lb)) & (9 * (n[x] - pos[x]) >= 4 * both) & (9 * (n - pos) >= 4 * both) & (9 * np.minimum(n[x], n) >= 4 * both)
        ok &= ~own | (order > x)  # two of its own once
        if i != j:
            ok &= block[x] != block
        p, q = np.nonzero(ok)
        for k in range(0, len(p), 1 << 14):
            xp, yq = x[p[k : k + (1 << 14)], 0], q[k : k + (1 << 14)]
            total = n[xp] + n[yq]
            differ = np.bitwise_count(bits[xp] ^ bits[yq]).sum(axis=1, dtype=np.int64)
            keep = 9 * ((total - differ) // 2) >= 4 * total
            xs.append(xp[keep])
            ys.append(yq[keep])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (order[:0], order[:0])


def _band(n: np.ndarray) -> np.ndarray:
    """Of two sets that are similar, the larger one is in the band of the smaller or in the next."""
    return np.floor(np.log(n) / _BAND).astype(np.int32)


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """token, pos, a, b, label_a, label_b of the lists of three sets or more that aren't in one component."""
    known = lists.select("token", "pos", "a", "b").join(labels, ["a", "b"], "left")
    known = known.withColumn("label_a", F.coalesce("label_a", "a")).withColumn("label_b", F.coalesce("label_b", "b"))
    known = materialize(known, "labelled")
    label = F.struct("label_a", "label_b")
    open_ = known.groupBy("token").agg(F.count("*").alias("k"), F.min(label).alias("lo"), F.max(label).alias("hi")).filter("k > 2 and lo <> hi").select("token")
    found = materialize(join_skewed(known, open_, ["token"], ["a", "b"]), "open_lists")
    discard(known)
    return found


def _around_linked(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b, c, d): each open list's set with the most links, if it has any, and those in other components."""
    degrees = links.select("a", "b").unionAll(links.select("c", "d")).groupBy("a", "b").agg(F.count("*").alias("degree"))
    known = lists.join(degrees, ["a", "b"])
    middle = known.groupBy("token").agg(F.max_by(F.struct("a", "b", "label_a", "label_b"), F.struct("degree", "a", "b")).alias("m"))
    tried = join_skewed(lists, middle, ["token"], ["a", "b"]).filter("label_a <> m.label_a or label_b <> m.label_b")
    return tried.select(F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("a").alias("c"), F.col("b").alias("d")).distinct()


def _left_over(lists: DataFrame, signs: DataFrame) -> DataFrame:
    """Pairs (a, b, c, d) of one list in different components that bit counts allow."""
    banded = signs.select("a", "b", "n", F.floor(F.log("n") / _BAND).cast("int").alias("band"))
    rows = open_sets = materialize(lists.join(banded, ["a", "b"]), "open_sets")
    if rows.isEmpty():
        return rows.select("a", "b", F.col("a").alias("c"), F.col("b").alias("d"))
    rows = banded_rows = materialize(rows.withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") - 1))), "banded")
    # the smaller of two similar sets, one of the tile's own, has the first token that they share early
    early = (F.col("tile") == F.col("band")) & (F.expr("9 * (n - pos) >= 8 * n"))
    label = F.struct("label_a", "label_b")
    sizes = rows.groupBy("token", "tile").agg(F.count("*").alias("k"), F.count_if(early).alias("early"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    sizes = sizes.filter("early > 0 and lo <> hi").select("token", "tile", F.ceil(F.col("k") / TILE).cast("int").alias("blocks"))
    rows = join_skewed(rows, sizes, ["token", "tile"], ["a", "b"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.select(*TILE_KEY, "block", "pos", "a", "b", "n", "label_a", "label_b").join(signs.select("a", "b", "bits"), ["a", "b"])
    tiles = rows.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    found = materialize(tiles.mapInArrow(_tiles, "a long, b long, c long, d long").distinct(), "tiled")
    discard(open_sets, banded_rows)
    return found


def _labels(links: DataFrame) -> DataFrame:
    """(a, b, label_a, label_b) of the sets that have links, as a stored table."""
    found = connected_components(links.select(F.struct("a", "b").alias("x"), F.struct(F.col("c").alias("a"), F.col("d").alias("b")).alias("y")))
    return materialize(found.select("node.a", "node.b", F.col("label.a").alias("label_a"), F.col("label.b").alias("label_b")), "labels")


def near_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased; a set is the distinct shingles of five words. A null or
    empty text, or one of white space, has no shingles and is a component of its own. Rows with equal sets are linked.
    component_id is the least doc_id of a component, null only if all are null. Texts of any length are read whole, in
    slices; a repeated row is a copy like another. An empty table gives an empty result; other columns, whatever their
    names, are ignored.
    """
    return _components(docs, os.urandom(16)).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, key: bytes) -> DataFrame:
    """near_components with a, b, the name of each row's set under the key."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    table, frequent = shingle_table(docs, key)
    met = lists(docs, frequent, key)
    signs = _signs(table, met.select("a", "b").distinct())
    star = met.filter("a <> la or b <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"), F.col("a").alias("c"), F.col("b").alias("d"))
    firsts = met.filter("salted and a = la and b = lb").select("token", F.struct("own", "a", "b").alias("s"))
    over = firsts.join(firsts.groupBy("token").agg(F.min("s").alias("f")), "token").filter("s <> f").select("f.a", "f.b", F.col("s.a").alias("c"), F.col("s.b").alias("d"))
    links = _verify(star.union(over).distinct(), signs, docs, key)
    labels = _labels(links)
    for candidates in (lambda rest: _around_linked(rest, links), lambda rest: _left_over(rest, signs)):
        before, met = met, _open_lists(met, labels)
        discard(before)
        if met.isEmpty():
            break
        more = _verify(candidates(met), signs, docs, key)
        if not more.isEmpty():
            links = links.union(more)
            labels = _labels(links)
    discard(met, signs)

    own = materialize(table.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least")), "own")
    known = materialize(own.join(labels, ["a", "b"], "left").withColumns({f"label_{x}": F.coalesce(f"label_{x}", x) for x in ("a", "b")}), "known")
    whole = known.groupBy("label_a", "label_b").agg(F.min("least").alias("component_id"))
    sets = materialize(join_skewed(known, whole, ["label_a", "label_b"], ["a", "b"]).select("a", "b", "component_id"), "components")
    discard(own, known, labels)
    full = join_skewed(table.filter("n > 0").select("doc_id", "n", "a", "b"), sets, ["a", "b"], ["doc_id"])
    alone = table.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "a", "b")
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "a", "b").unionByName(alone)


def keep_least(docs: DataFrame) -> DataFrame:
    """The rows of docs with the least doc_id of their component, with all their columns, whatever their names.

    Rows without shingles and rows with a null doc_id stay. If a doc_id repeats, each of its rows goes by its own text.
    Equal rows of a doc_id that stays all stay. An empty table gives an empty result.
    """
    key = os.urandom(16)
    marks = _components(docs, key).select("doc_id", "a", "b", F.expr("n_shingles > 0 and doc_id <> component_id").alias("goes"))
    marks = materialize(marks.filter("doc_id is not null"), "marks")
    dropped = materialize(marks.filter("goes").select("doc_id").distinct(), "dropped")
    both = marks.filter("not goes").join(dropped, "doc_id", "left_semi").select("doc_id", "a", "b").distinct()
    both = materialize(both, "both")  # rows that stay although their doc_id goes with another text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    out = pick(rows.drop("text"), dropped, "doc_id", "left_anti").select("row.*")
    if both.isEmpty():
        return out

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array([name(*s) for s in shingle_sets(batch["text"], WORDS, key)], np.int64).reshape(-1, 2)
            yield pa.record_batch([batch["doc_id"], pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), batch["row"]], ["doc_id", "a", "b", "row"])

    again = pick(rows, materialize(both.select("doc_id").distinct(), "ids"), "doc_id").select("doc_id", "text", "row")
    schema = again.select("doc_id", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "row").schema
    return out.unionByName(again.mapInArrow(named, schema).join(both, ["doc_id", "a", "b"], "left_semi").select("row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
), c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
