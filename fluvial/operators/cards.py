"""Cards: candidates, keys, duplicates, existing notes and what may be written."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.functions.text import casefolded, collapsed, folded, nfkc_casefold, note_key, words
from fluvial.scans import along
from fluvial.staging import bounded_batches, discard, hot_keys, join_skewed, joins_by_rows, materialize, number_within, pick


# Fixed value: what an id may be.
SAFE_ID = r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z"


def from_conversations(turns: DataFrame) -> DataFrame:
    """A card for each user turn that an assistant answers: card_id (its conv_id and turn), section, front, back."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("back"))
    rows = rows.filter("role = 'user' and next_role = 'assistant'")
    return rows.select(F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.struct("conv_id", "turn")).alias("card_id"), F.col("conv_id").alias("section"), F.coalesce("text", F.lit("")).alias("front"), F.coalesce("back", F.lit("")).alias("back"))


def numbered(rows: DataFrame, *names: str) -> DataFrame:
    """Ids of from_conversations as numbers for a result: conv_id * 10000 + turn, and below -2**62 from turn 10,000 on.

    No two ids share a number; those that have none (turns below 0; later turns of 2**31 and more, or of such conv_ids)
    are errors. The numbers of later turns are not in the ids' order, so operators take the ids themselves.
    """

    def number(name: str) -> Column:
        conv, turn = (F.col(f"{name}.{x}").cast("long") for x in ("conv_id", "turn"))
        late = (turn >= 10_000) & (turn < 1 << 31) & conv.between(0, (1 << 31) - 1)
        found = F.when(F.col(name).isNull(), F.lit(None).cast("long")).when(turn.between(0, 9_999), conv * 10_000 + turn)
        return found.when(late, F.lit(-(1 << 62)) - conv * (1 << 31) - turn).otherwise(F.raise_error(F.lit("no number for a card's conv_id and turn")).cast("long"))

    return rows.withColumns({n: number(n) for n in names})


def mark_duplicates(cards: DataFrame) -> DataFrame:
    """Add duplicate: true for all but the first card, by card_id, with a folded front and back; cards with neither are none.

    The first of each key is an aggregate with partial sums, and rows meet it through salts, so many cards may share a key.
    """
    keyed = cards.withColumn("_key", F.sha2(F.concat_ws("\n", folded(F.col("front")), folded(F.col("back"))), 256)).withColumn("_none", (folded(F.col("front")) == "") & (folded(F.col("back")) == ""))
    keyed = materialize(keyed, "keyed_cards")
    first = keyed.groupBy("_key").agg(F.min("card_id").alias("_first"))
    return join_skewed(keyed, first, ["_key"], ["card_id"]).withColumn("duplicate", ~F.col("_none") & (F.col("card_id") > F.col("_first"))).drop("_key", "_none", "_first")


def match_existing(cards: DataFrame, notes: DataFrame, html: bool = False) -> DataFrame:
    """card_id, note_id: the first note, by note_id, with the card's folded front or its folded back; null if there is none.

    html: the notes' sides are HTML, whose text is compared.

    Two equi-joins instead of one on either key, over keys that are first reduced to their least note. Empty keys match nothing.
    """
    sides = []
    own, key = (casefolded(collapsed(F.col("_side"))), note_key(F.col("_side"))) if html else (folded(F.col("_side")), folded(F.col("_side")))
    for side in ("front", "back"):
        least = notes.withColumn("_side", F.col(side)).groupBy(key.alias("key")).agg(F.min("note_id").alias("note_id")).filter("key <> ''")
        sides.append(cards.withColumn("_side", F.col(side)).select("card_id", own.alias("key")).join(least, "key").select("card_id", "note_id"))
    found = sides[0].unionAll(sides[1]).groupBy("card_id").agg(F.min("note_id").alias("note_id"))
    return cards.select("card_id").join(found, "card_id", "left")


def to_append(cards: DataFrame, notes: DataFrame) -> DataFrame:
    """Cards whose collapsed (front, section) no note has, the first of each such key: what an append would add."""
    key = lambda df: df.withColumn("_front", collapsed(F.col("front")))
    fresh = key(cards).join(key(notes).select("_front", "section").distinct(), ["_front", "section"], "left_anti")
    first = fresh.groupBy("_front", "section").agg(F.min_by(F.struct("card_id", "front", "back"), "card_id").alias("c"))
    return first.select("c.card_id", "section", "c.front", "c.back")


def word_list() -> Column:
    return words(F.concat_ws("\n", "front", "back"))


def letters(side: str) -> Column:
    """A side in one compatibility form and without case, punctuation and white space; symbols stay."""
    return F.regexp_replace(nfkc_casefold(F.col(side)), r"(?U)[\p{P}\p{Z}\s]", "")


def source_ids(*ids: Column, lists: tuple[Column, ...] = ()) -> Column:
    """A card's sources, once each and in order: single ids and lists of ids. What isn't a safe id is none."""
    every = F.concat(F.array(*(x.cast("string") for x in ids)), *(F.coalesce(x, F.array()).cast("array<string>") for x in lists))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x.rlike(SAFE_ID))))


def _own_sources(sources: Column | None) -> Column:
    return F.array_compact(F.array(F.col("section").cast("string"))) if sources is None else sources


#: Cards of a source whose texts are compared all with all in one task; a larger source is cut into such blocks by size.
ALL_WITH_ALL = 4_096
#: An element's share of a block: as many elements as ELEMENTS a card fill it, too.
ELEMENTS = 1_024
#: A source's blocks are put in so many groups, whose signatures meet in tasks, or in more where groups would have more than MOST_BLOCKS blocks.
GROUPS, MOST_BLOCKS = 8, 16
#: A meeting of two blocks names the pairs that may be similar, up to so many a row of theirs, and beyond that the rows.
PAIRS_A_ROW = 8
#: Rows and columns that are compared at once, and pairs of which more is compared.
STEP, CLOSER = (256, 256), 8_192


def similar_pairs(cards: DataFrame, threshold: float = 0.86, elements: Column | None = None, sources: Column | None = None) -> DataFrame:
    """first_id, second_id, similarity (3 places) of cards that share a source and whose sets (of words, else of the list or text `elements`) are at least that similar.

    sources: an array of distinct ids (see source_ids), else the section is the only one; without sources a card is similar to
    none. A text stands for its runs of three characters. A pair that shares several sources counts once.
    """
    joins_by_rows(cards.sparkSession)
    sets = cards.select("card_id", _own_sources(sources).alias("sources"), (word_list() if elements is None else elements).alias("t"))
    sets = materialize(sets.withColumn("s", _sketch("t", threshold)).select("card_id", "sources", "t", "s.*"), "card_sets")
    return _similar(sets.select("card_id", "t", "n", "bits"), sets.select("card_id", F.explode("sources").alias("source")), threshold)


def _elements(value: list | str | None) -> set:
    """The elements of a list, or a text's runs of three characters; a shorter text is its own only one."""
    if isinstance(value, str):
        return {value[k : k + 3] for k in range(len(value) - 2)} or ({value} if value else set())
    return set(() if value is None else value)


def _sketch(name: str, threshold: float) -> Column:
    """n, bits: how many elements a list or text has, and their signature, which has the same bits in each task."""

    def of(t: pd.Series) -> pd.DataFrame:
        codes = [_runs(v) if isinstance(v, str) and len(v) > 2 else np.fromiter(map(_hash, _elements(v)), np.int64) for v in t]
        n = np.fromiter(map(len, codes), np.int64, len(codes))
        return pd.DataFrame({"n": n, "bits": [_signature(c, w) for c, w in zip(codes, _widths(n, threshold), strict=True)]})

    return F.pandas_udf(of, "n int, bits binary")(name)


def _hash(element: object) -> int:
    return zlib.crc32(element.encode("utf-8", "surrogatepass")) if isinstance(element, str) else hash(element)


def _similar(sets: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """first_id, second_id, similarity of the pairs in one source that are similar; sets: card_id, t, n, bits (see _sketch), and places: card_id, source, both stored.

    Cards of a source are put in blocks by their size, blocks in a few groups, and signatures of two groups meet in a task
    where sizes leave room for the threshold. A pair whose signatures leave room, too, is compared by its elements in one of
    the meetings of blocks that found it, whatever sources it shares. So a text is shuffled as often as there are such meetings, not as there are blocks.
    """
    spark = sets.sparkSession
    bounded_batches(spark)
    places = materialize(places.join(sets.filter("n > 0").select("card_id", "n", F.xxhash64("bits").alias("mark")), "card_id"), "card_places")
    budget = max(1, ALL_WITH_ALL) * ELEMENTS
    cost = F.greatest(F.lit(ELEMENTS), F.col("n")).cast("long")
    large = materialize(places.groupBy("source").agg(F.sum(cost).alias("cost")).filter(F.col("cost") > budget).select("source"), "large_sources")
    signed = sets.select("card_id", "n", "bits")
    first, kept = F.lit(0), ("card_id", "n", "bits", "source")
    if large.isEmpty():
        rows = places.select("card_id", "source").join(signed, "card_id").select(*kept, first.alias("i"), first.alias("j"), F.lit(True).alias("own"), first.alias("block"))
    else:
        many = materialize(number_within(pick(places, large, "source"), "source", ["n", "mark"], "rank"), "card_ranks")  # equal sets in a row
        many = along(many, ["source"], "rank", sums={"until": cost}).withColumn("block", F.floor((F.col("until") - cost) / budget).cast("int"))
        many = materialize(many.select("card_id", "source", "n", "block"), "card_blocks")
        blocks = many.groupBy("source", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        each = F.least(F.lit(MOST_BLOCKS), F.ceil((F.max("block").over(Window.partitionBy("source")) + 1) / GROUPS))
        blocks = materialize(blocks.withColumn("group", F.floor(F.col("block") / each).cast("int")), "block_sizes")
        groups = materialize(blocks.groupBy("source", "group").agg(F.min("low").alias("low"), F.max("high").alias("high")), "group_sizes")
        i = groups.select("source", F.col("group").alias("i"), "high")
        meet = i.join(groups.select("source", F.col("group").alias("j"), "low"), "source").filter((F.col("i") <= F.col("j")) & (F.col("high") >= F.lit(threshold) * F.col("low") - 1e-9))
        sides = meet.select("source", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("group"))
        sides = sides.join(blocks.select("source", "group", "block"), ["source", "group"]).withColumn("own", F.col("group") == F.col("i"))
        rows = many.select("card_id", "source", "block").join(signed, "card_id").join(sides, ["source", "block"]).select(*kept, "i", "j", "own", "block")
        small = pick(places, large, "source", "left_anti").select("card_id", "source").join(signed, "card_id")
        rows = rows.unionByName(small.select(*kept, first.alias("i"), first.alias("j"), F.lit(True).alias("own"), first.alias("block")))
    by = ["source", "i", "j"]
    # a fixed number of partitions, as the work follows the pairs, not the bytes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *by).sortWithinPartitions(*by)
    kind, of_source = (t.schema[c].dataType.simpleString() for t, c in ((sets, "card_id"), (places, "source")))
    met = materialize(dealt.mapInArrow(functools.partial(_met, threshold=threshold), f"rows int, source {of_source}, i int, j int, one {kind}, other {kind}"), "card_meetings")
    ends = (F.least("one", "other").alias("first_id"), F.greatest("one", "other").alias("second_id"))
    paired = F.col("one").isNotNull() & F.col("other").isNotNull()
    # in the largest of its meetings, which most likely holds both cards for other pairs, too
    once = met.filter(paired).groupBy(*ends).agg(F.max(F.struct(*met.columns)).alias("m")).select("m.*")
    sides = F.array(F.struct(F.col("one").alias("card_id"), F.lit(True).alias("own")), F.struct(F.col("other").alias("card_id"), (F.col("i") == F.col("j")).alias("own")))
    rows = once.unionByName(met.filter(~paired)).select(*by, F.inline(sides)).filter("card_id is not null").distinct()
    dealt = rows.join(sets.select("card_id", "t"), "card_id").repartition(parts, *by).sortWithinPartitions(*by)
    found = dealt.mapInArrow(functools.partial(_compared, threshold=threshold), f"one {kind}, other {kind}, similarity double")
    return found.select(*ends, "similarity").groupBy("first_id", "second_id").agg(F.round(F.max("similarity"), 3).alias("similarity"))


def _met(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """rows, source, i, j, one, other: pairs of cards of the blocks i and j that may be similar, or a card of one of them alone, which may have similar ones in the other; rows: how many cards the blocks have."""
    return _gathered(found for parts in _tiles(batches) for found in _of_signatures(parts, threshold))


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """one, other, similarity of the similar rows of each tile."""
    return _gathered(found for parts in _tiles(batches) for found in _of_tile(parts, threshold))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each tile (source, i, j); rows come tile by tile, and one tile is held."""
    held, last = [], None
    for batch in batches:
        keys = list(zip(*(batch[c].to_pylist() for c in ("source", "i", "j")), strict=True))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != last:
                yield held
                held, last = [], keys[at]
            held.append(batch.slice(at, end - at))
            at = end
    yield held


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 8_192) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _of_signatures(parts: list[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of two groups the blocks that sizes let meet, and of these what signatures let meet."""
    if sum(map(len, parts)) < 2:
        return
    rows = pa.Table.from_batches(parts)
    ids, bits, source = rows["card_id"].combine_chunks(), rows["bits"].to_pylist(), rows["source"][0].as_py()
    own, n, block = (np.array(rows[c].to_pylist()) for c in ("own", "n", "block"))
    width = np.fromiter((8 * len(b) for b in bits), np.int64, len(bits))
    order = np.lexsort((n, width, block))
    blocks = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
    left, right = ([b for b in blocks if own[b[0]] == side] for side in (True, False))
    for k, a in enumerate(left):
        for b in right or left[k:]:
            if n[a].max() < threshold * n[b].min() - 1e-9 or n[b].max() < threshold * n[a].min() - 1e-9:
                continue
            pairs, count, met = [], 0, np.zeros((2, len(n)), bool)
            for p, q in _near(a, b, n, width, bits, threshold):
                met[0, p] = met[1, q] = True
                count += len(p)
                if count <= PAIRS_A_ROW * (len(a) + len(b)):
                    pairs.append((p, q))
            if not count:
                continue
            if count <= PAIRS_A_ROW * (len(a) + len(b)):
                one, other = (ids.take(pa.array(np.concatenate(x))) for x in zip(*pairs, strict=True))
            else:
                one, other = (ids.take(pa.array(np.flatnonzero(x))) for x in ((met[0] | met[1], met[0] & False) if a is b else met))
                one, other = (pa.concat_arrays(x) for x in ((one, pa.nulls(len(other), ids.type)), (pa.nulls(len(one), ids.type), other)))
            size, i, j = (pa.scalar(int(x), pa.int32()) for x in (len(a) + len(b), block[a[0]], block[b[0]]))
            tile = (pa.repeat(x, len(one)) for x in (size, pa.scalar(source, rows.schema.field("source").type), i, j))
            yield pa.record_batch([*tile, one, other], ["rows", "source", "i", "j", "one", "other"])


def _near(one: np.ndarray, other: np.ndarray, n: np.ndarray, width: np.ndarray, bits: list[bytes], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, a part at a time, whose sizes and signatures leave room for the threshold; each pair once if both sides are one."""
    ratio = 2 * threshold / (1 + threshold)
    for at, a in _steps(one, width, STEP[0]):
        for to, b in _steps(other, width, STEP[1]):
            if one is other and to + len(b) <= at or n[a[-1]] < threshold * n[b[0]] - 1e-9 or n[b[-1]] < threshold * n[a[0]] - 1e-9:
                continue
            least = min(width[a[0]], width[b[0]])
            x, y = _folded(a, bits, least), np.ascontiguousarray(_folded(b, bits, least).T)
            differ = np.zeros((len(a), len(b)), np.uint16 if least < 1 << 16 else np.int32)
            for k in range(least // 64):
                differ += np.bitwise_count(x[:, k, None] ^ y[k])
            room = np.minimum((1 - ratio) * (n[a] + n[b[-1]]) + 1e-6, least).astype(differ.dtype)
            p, q = np.nonzero(differ <= room[:, None])
            left, right = n[a[p]], n[b[q]]
            both = left + right
            good = (both - differ[p, q] >= ratio * both - 1e-9) & (np.minimum(left, right) >= threshold * np.maximum(left, right) - 1e-9)
            if one is other:
                good &= p + at < q + to
            if good.any():
                yield a[p[good]], b[q[good]]


def _of_tile(parts: list[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Sizes leave room for few pairs, narrow signatures for fewer, wide ones for hardly any that isn't similar; elements decide."""
    if sum(map(len, parts)) < 2:
        return
    rows = pa.Table.from_batches(parts)
    ids, own = rows["card_id"].combine_chunks(), np.array(rows["own"].to_pylist(), bool)
    numbers: dict = {}
    codes = [_codes(x.as_py(), numbers) for x in rows["t"]]
    n = np.fromiter(map(len, codes), np.int64, len(codes))
    width = _widths(n, threshold)
    bits = [_signature(c, w) for c, w in zip(codes, width, strict=True)]
    wide = [_signature(c, 8 * w) for c, w in zip(codes, width, strict=True)]
    order = np.lexsort((n, width))
    one = order[own[order]]
    other = one if len(one) == len(order) else order[~own[order]]
    ratio = 2 * threshold / (1 + threshold)
    for p, q in _near(one, other, n, width, bits, threshold):
        least = 8 * min(width[p].min(), width[q].min())
        size = max(1, CLOSER * 4_096 // least)
        for k in range(0, len(p), size):
            u, v = p[k : k + size], q[k : k + size]
            both = n[u] + n[v]
            near = both - np.bitwise_count(_folded(u, wide, least) ^ _folded(v, wide, least)).sum(axis=1, dtype=np.int64) >= ratio * both - 1e-9
            u, v, both = u[near], v[near], both[near]
            common = np.fromiter((len(np.intersect1d(codes[c], codes[d], assume_unique=True)) for c, d in zip(u, v, strict=True)), np.int64, len(u))
            share = common / (both - common)
            good = share >= threshold
            if good.any():
                yield pa.record_batch([ids.take(pa.array(u[good])), ids.take(pa.array(v[good])), pa.array(share[good])], ["one", "other", "similarity"])


def _runs(text: str) -> np.ndarray:
    """A number for each run of three characters, once each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _codes(value: list | str | None, numbers: dict) -> np.ndarray:
    """A number for each element, once each, different ones for different elements; those of a list come from `numbers`."""
    if isinstance(value, str) and len(value) > 2:
        return _runs(value)
    return np.fromiter((-1 - numbers.setdefault(x, len(numbers)) for x in _elements(value)), np.int64)


def _widths(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many bits the signature of so many elements has."""
    return np.maximum(256, 1 << np.ceil(np.log2(np.maximum(1, (1 if threshold >= 0.75 else 4) * n))).astype(np.int64))


def _signature(codes: np.ndarray, width: int) -> bytes:
    """For each of `width` bits, a power of two, the parity of the elements that fall on it: two sets differ in as many elements as bits, or more.

    Its halves laid over each other are the signature of half the bits. All of a code's bits decide where it falls.
    """
    x = codes.view(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    spots = (x ^ x >> np.uint64(31)).astype(np.int64) & (width - 1)
    return np.packbits(np.bincount(spots, minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def _steps(order: np.ndarray, width: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of at most `size` rows, of one width each, and where they begin."""
    edges = [0, *(np.flatnonzero(np.diff(width[order])) + 1), len(order)]
    for low, high in zip(edges, edges[1:], strict=False):
        for k in range(low, high, size):
            yield k, order[k : min(k + size, high)]


def _folded(rows: np.ndarray, bits: list[bytes], width: int) -> np.ndarray:
    """The rows' signatures as words, of `width` bits each; the rows are of one width."""
    words = np.frombuffer(b"".join(bits[k] for k in rows), np.uint64).reshape(len(rows), -1, width // 64)
    return np.bitwise_xor.reduce(words, axis=1)


# What forbids a write, and the code of each, in this order.
GATES = {
    "no_kept_cards": "kept_count = 0",
    "blocking_cards_in_write_list": "blocking_write_count > 0",
    "mapping_incomplete": "not mapping_complete",
    "duplicate_not_checked": "not duplicate_check_complete",
    "final_confirmation_required": "not final_confirmation_confirmed",
    "write_target_invalid": "not target_valid",
    "generation_in_progress": "not generation_complete",
}


def write_gates(rows: DataFrame) -> DataFrame:
    """Add reasons (codes of what forbids the write, in order) and allowed. A condition that is null counts as unmet."""
    hits = (F.when(F.coalesce(F.expr(c), F.lit(True)), F.lit(code)) for code, c in GATES.items())
    return rows.withColumn("reasons", F.array_compact(F.array(*hits))).withColumn("allowed", F.size("reasons") == 0)


def deduplicate(cards: DataFrame, threshold: float = 0.86, sources: Column | None = None) -> DataFrame:
    """card_id, matched_id, kind, reason, similarity: each card that repeats a kept one, decided in card_id order.

    A card is kept unless an earlier kept one has its texts (`exact`), has them but for case, punctuation and white
    space (`canonical`) or, with a source in common, is at least `threshold` similar in words or in runs of three letters
    (`similar`); the first such card is its match. Null sides are empty. sources: as for similar_pairs. A null card_id is no card.

    Different texts are compared once each, whatever number of cards has them: a pair of texts says for a source which kept and
    which open card is the first there. Equal cards of the same sources share all that, so the first stands for them. Of the
    others each round decides all whose earlier partners are decided; of equal canonical texts a group's first kept and
    first open card say all. A round's tables are written and the round before deleted.
    """
    joins_by_rows(cards.sparkSession)
    canon = F.unhex(F.sha2(F.concat(letters("front"), F.lit("\x1f"), letters("back")), 256))
    exact = F.unhex(F.sha2(F.concat(F.coalesce("front", F.lit("")), F.lit("\x1f"), F.coalesce("back", F.lit(""))), 256))
    keyed = cards.filter("card_id is not null").select("card_id", _own_sources(sources).alias("sources"), canon.alias("canon"), exact.alias("exact"), F.array_distinct(word_list()).alias("w"), F.concat(letters("front"), F.lit("\n"), letters("back")).alias("r"))
    keyed = materialize(keyed.withColumns({"w_s": _sketch("w", threshold), "r_s": _sketch("r", threshold)}), "dedup_cards")
    texts = keyed.groupBy("exact").agg(F.min("card_id").alias("text"))
    own = materialize(join_skewed(keyed.select("card_id", "sources", "canon", "exact"), texts, ["exact"], ["card_id"]), "dedup_own")
    first = materialize(own.groupBy("exact", "sources").agg(F.min("card_id").alias("card_id"), F.first("canon").alias("canon"), F.first("text").alias("text")), "dedup_first")
    near = materialize(_near_texts(keyed, first, threshold), "dedup_ways")

    hot = hot_keys(first, ["canon"])
    hot = hot if hot is None else materialize(hot, "dedup_hot")
    kind_of_id = cards.schema["card_id"].dataType.simpleString()
    start = first.select("*", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast(f"struct<first_id:{kind_of_id},similarity:double,words:boolean>").alias("hit"))
    state = materialize(start, "dedup_state")
    while not state.filter("kept is null").isEmpty():
        placed = state.select("card_id", "kept", "text", F.explode("sources").alias("source"))
        known = placed.filter("kept is null or kept").groupBy("text", "source").agg(F.min(F.when(F.col("kept"), F.col("card_id"))).alias("first_id"), F.min(F.when(F.col("kept").isNull(), F.col("card_id"))).alias("open_id"))
        told = near.join(known, ["text", "source"]).groupBy(F.col("other").alias("text"), "source").agg(
            F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "similarity", "words"))).alias("near"),
            F.min("open_id").alias("near_open"),
        )
        links = placed.filter("kept is null").join(told, ["text", "source"]).groupBy("card_id").agg(F.min("near").alias("near"), F.min("near_open").alias("near_open"))
        own_id = F.col("card_id")
        links = links.select("card_id", F.when(F.col("near.first_id") < own_id, F.col("near")).alias("near"), F.when(F.col("near_open") < own_id, F.col("near_open")).alias("near_open"))
        groups = state.groupBy("canon").agg(F.min(F.when(F.col("kept"), F.col("card_id"))).alias("same"), F.min(F.when(F.col("kept").isNull(), F.col("card_id"))).alias("same_open"))
        same = F.when(F.col("same") < own_id, F.struct(F.col("same").alias("first_id"), F.lit(1.0).alias("similarity"), F.lit(True).alias("words")))
        hit = F.when(F.col("same_hit.first_id") <= F.coalesce("near.first_id", "same_hit.first_id"), F.col("same_hit")).otherwise(F.col("near"))
        ahead = F.least("near_open", F.when(F.col("same_open") < own_id, F.col("same_open")))
        rows = state.withColumnRenamed("hit", "_old")
        rows = rows.join(groups, "canon", "left") if hot is None else join_skewed(rows, groups, ["canon"], ["card_id"], "left", hot)
        rows = rows.join(links, "card_id", "left").withColumn("same_hit", same).withColumn("_hit", hit).withColumn("_ahead", ahead)
        now = F.when(F.col("_ahead").isNull(), F.col("_hit").isNull()).when(F.col("_hit.first_id") < F.col("_ahead"), False)
        rows = rows.select(*first.columns, F.coalesce("kept", now).alias("kept"), F.coalesce("_old", F.when(F.col("kept").isNull() & ~now, F.col("_hit"))).alias("hit"))
        before, state = state, materialize(rows, "dedup_state")
        discard(before)
    stands = state.select("exact", "sources", F.col("card_id").alias("_stand"), "hit")
    rows = own.select("card_id", "exact", "sources", "canon").join(stands, ["exact", "sources"])
    rows = rows.withColumn("matched_id", F.coalesce("hit.first_id", F.when(F.col("card_id") > F.col("_stand"), F.col("_stand")))).filter("matched_id is not null").drop("sources")
    other = own.select(F.col("card_id").alias("matched_id"), F.col("exact").alias("_exact"), F.col("canon").alias("_canon"))
    rows = rows.join(other, "matched_id")
    kind = F.when(F.col("exact") == F.col("_exact"), "exact").when(F.col("canon") == F.col("_canon"), "canonical").otherwise("similar")
    reason = F.when(F.col("kind") == "exact", "exact_text").when(F.col("kind") == "canonical", "normalized_text").when(F.col("hit.words"), "shared_source_token_overlap").otherwise("shared_source_character_overlap")
    return rows.withColumn("kind", kind).select("card_id", "matched_id", "kind", reason.alias("reason"), F.when(F.col("kind") == "similar", F.col("hit.similarity")).otherwise(1.0).alias("similarity"))


def _near_texts(keyed: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """text, source, other, similarity, words: similar texts that share the source, each pair both ways; words: by their words.

    A text is the first card that has it.
    """
    places = materialize(first.select("text", F.explode("sources").alias("source")).distinct(), "dedup_places")
    held = places.withColumnRenamed("text", "card_id")
    found = (_similar(keyed.select("card_id", F.col(k).alias("t"), f"{k}_s.n", f"{k}_s.bits"), held, threshold).withColumn("words", F.lit(k == "w")) for k in "wr")
    best = F.max(F.struct("similarity", "words"))  # of equal ones, the words'
    rows = functools.reduce(DataFrame.unionAll, found).groupBy("first_id", "second_id").agg(best.alias("b")).select(F.col("first_id").alias("text"), F.col("second_id").alias("other"), "b.*")
    ways = materialize(rows, "dedup_pairs").join(places, "text").join(places.withColumnRenamed("text", "other"), ["other", "source"])
    return ways.select("text", "source", "other", "similarity", "words").union(ways.select(F.col("other").alias("text"), "source", F.col("text").alias("other"), "similarity", "words"))
