"""Texts cut into pieces of bounded size, without loss or overlap."""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.scans import along, last_within
from fluvial.staging import bounded_batches, discard, join_skewed, joins_by_rows, materialize

# Characters of a piece, wanted and at most, and chunks of a document; where to cut, best first.
TARGET, MOST, MOST_CHUNKS = 6_000, 12_000, 48
#: What places a block: blocks of different places share no chunk.
PLACE = ("file_label", "page", "slide", "sheet", "row_start", "row_end", "cell_range", "section", "timestamp_start", "timestamp_end", "notebook_cell", "line_start", "line_end")
#: A part of a heading path that looks like a file path.
_PATH = r"^[/\\]|^[A-Za-z]:[/\\]|(^|[/\\])\.\.([/\\]|\z)"
SEPARATORS = ("\n\n", "\n", ". ", "。", "; ", "；", " ")


def cuts(text: str, target: int = TARGET, most: int = MOST) -> Iterator[tuple[int, int]]:
    """(start, end) of each piece. A piece ends behind the best separator in the second half of the target, else between the target and the bound, else at the target."""
    at = 0
    while len(text) - at > most:
        windows = ((at + max(1, target // 2), at + target), (at + target, at + most))
        found = (text.rfind(s, low, high) + len(s) for low, high in windows for s in SEPARATORS if text.rfind(s, low, high) >= 0)
        end = next(found, at + target)
        yield at, end
        at = end
    if at < len(text) or not at:
        yield at, len(text)


#: Characters of a batch of pieces, unless one piece has more.
PIECES = 2 << 20


def _cut_batches(batches: Iterator[pa.RecordBatch], target: int, most: int) -> Iterator[pa.RecordBatch]:
    """doc_id and text to doc_id, sequence, start and text of the pieces, in batches of about PIECES characters."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string())], ["doc_id", "sequence", "start", "text"])

    for batch in batches:
        rows, held = [], 0
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            text = text.as_py() or ""
            for k, (a, b) in enumerate(cuts(text, target, most)):
                rows.append((doc, k, a, text[a:b]))
                held += b - a
                if held >= PIECES:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)


def text_chunks(docs: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """doc_id, sequence, start, text of each document's pieces, in place; an empty or null text is one empty piece."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(functools.partial(_cut_batches, target=target, most=most), "doc_id long, sequence int, start int, text string")


def table_cuts(text: str, target: int, most: int) -> Iterator[str]:
    """A table's rows in pieces that each repeat its header; a row beyond the bound is cut as a text."""
    header, *rows = text.split("\n")
    if len(text) <= most or not rows:
        yield from (text[a:b] for a, b in cuts(text, target, most))
        return
    room, wanted = most - len(header) - 1, max(1, target - len(header) - 1)
    if room < 1:
        raise ValueError("table header exceeds the bound")
    ends = [0, *accumulate(len(r) + 1 for r in rows)]  # rows i to j - 1 take ends[j] - ends[i] - 1 characters
    at = 0
    while at < len(rows):
        if len(rows[at]) > room:
            yield from (f"{header}\n{rows[at][a:b]}" for a, b in cuts(rows[at], wanted, room))
            at += 1
            continue
        end = max(at + 1, bisect_right(ends, ends[at] + wanted + 1) - 1)
        end = next((k for k in range(at + 1, end) if len(rows[k]) > room), end)
        yield "\n".join([header, *rows[at:end]])
        at = end


def _pieces(kinds: list[str], texts: list[str], target: int, most: int) -> Iterator[str]:
    """The pieces of a unit that is larger than the bound."""
    text = "\n\n".join(texts)
    context = texts[0] + "\n\n" if len(texts) == 2 and kinds[0] == "paragraph" else ""
    if kinds == ["table"]:
        yield from table_cuts(text, target, most)
    elif context and len(context) < most:
        yield from (context + texts[1][a:b] for a, b in cuts(texts[1], max(1, target - len(context)), most - len(context)))
    else:
        yield from (text[a:b] for a, b in cuts(text, target, most))


def heading_parts(path: Column) -> Column:
    """The parts of a section's path that aren't blank and don't look like file paths."""
    strip = lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+\z", "")
    return F.transform(F.filter(path, lambda p: (strip(p) != "") & ~p.rlike(_PATH)), strip)


def _starts(units: DataFrame, target: int) -> list[DataFrame]:
    """Stored tables of (_key, unit), which begin chunks; units: _key, unit, run, barrier, lo, hi, bound.

    A run holds the units between two barriers. A chunk that began at any unit would end with the last unit of its run that
    ends within the bound; the unit behind it is where it points. The units that pointers reach from the run's first one
    begin chunks: they are marked in rounds, as each round doubles both the marked units and the pointers' reach.
    """
    reach = last_within(units.select("_key", "run", "unit", "lo", "hi", "bound"), ["_key", "run"], F.col("hi"), F.col("lo") + F.col("bound"), target, "unit")
    reach = reach.select("_key", F.col("unit").alias("from"), (F.greatest("unit", F.coalesce("_last", "unit")) + 1).alias("unit"))
    inside = units.filter("barrier = 0").select("_key", "unit")  # a pointer to a barrier leaves its run
    jumps = materialize(reach.join(inside, ["_key", "unit"]).select("_key", F.col("from").alias("unit"), F.col("unit").alias("next")), "jumps")
    marked = [materialize(units.filter("barrier = 1").select("_key", "unit"), "heads")]
    while True:
        known = functools.reduce(DataFrame.unionByName, marked)
        new = materialize(known.join(jumps, ["_key", "unit"]).select("_key", F.col("next").alias("unit")), "marked")
        if new.isEmpty():
            discard(new, jumps)
            return marked
        marked.append(new)
        onward = jumps.select("_key", F.col("unit").alias("next"), F.col("next").alias("after"))
        before, jumps = jumps, materialize(jumps.join(onward, ["_key", "next"]).select("_key", "unit", F.col("after").alias("next")), "jumps")
        discard(before)


def _places(rows: DataFrame, target: int, most: int) -> DataFrame:
    """_key, at, unit and chunk of each of the blocks, of which columns of a stored table are given: kinds, sizes and places, not texts."""
    stays = ((F.col("kind") == "list_item") & (F.col("above") == "list_item")) | (F.col("kind").isin("code", "formula") & (F.col("above") == "paragraph"))
    begun = materialize(along(rows, ["_key"], "at", before={"above": F.col("kind")}).withColumn("begins", F.when(stays, 0).otherwise(1)), "block_starts")
    inside = materialize(along(begun, ["_key"], "at", sums={"unit": F.col("begins")}), "block_units")
    discard(begun)

    units = inside.groupBy("_key", "unit").agg((F.sum("n") + 2 * (F.count("*") - 1)).alias("n"), F.max(F.col("kind") == "table").alias("table"), F.min_by("place", F.when(F.col("place").isNotNull(), F.col("at"))).alias("place"), F.max("head_n").alias("head_n"))
    units = materialize(units.withColumn("alone", F.col("table") | (F.col("n") > most - F.col("head_n"))), "units")
    placed = along(units, ["_key"], "unit", sums={"end": F.col("n") + 2}, before={"alone_above": F.col("alone"), "place_above": F.col("place")})
    barrier = F.col("alone") | F.coalesce("alone_above", F.lit(True)) | ~F.col("place").eqNullSafe(F.col("place_above"))
    placed = materialize(placed.select("_key", "unit", (F.col("end") - 2 - F.col("n")).alias("lo"), (F.col("end") - 2).alias("hi"), F.greatest(F.lit(1), target - F.col("head_n")).alias("bound"), barrier.cast("int").alias("barrier")), "unit_ends")
    runs = materialize(along(placed, ["_key"], "unit", sums={"run": F.col("barrier")}), "unit_runs")
    marked = _starts(runs, target)
    starts = functools.reduce(DataFrame.unionByName, marked).withColumn("starts", F.lit(1))
    flagged = materialize(runs.select("_key", "unit").join(starts, ["_key", "unit"], "left"), "flagged")
    chunks = materialize(along(flagged, ["_key"], "unit", sums={"chunk": F.coalesce("starts", F.lit(0))}).select("_key", "unit", "chunk"), "unit_chunks")
    found = materialize(join_skewed(inside.select("_key", "at", "unit"), chunks, ["_key", "unit"], ["at"]), "block_chunks")
    discard(inside, units, placed, runs, flagged, chunks, *marked)
    return found


def structural_chunks(blocks: DataFrame, key: str = "doc_id", target: int = TARGET, most: int = MOST, place: tuple[str, ...] = PLACE, max_chunks: int = MOST_CHUNKS) -> DataFrame:
    """key, sequence, section_ord, heading_path, text, block_ords, block_kinds, chunk_id, error.

    blocks: key, section_ord, block_ord (distinct in a section), heading, heading_path (alike in a section), kind, text and
    columns of `place`. Blocks of a section share a chunk while they have one place and fit the target; code or a formula stays
    with the paragraph above it, list items with those above, and tables are alone. What is larger than the bound is cut without
    loss, tables by rows under their header, code under its paragraph. A section whose heading is beyond the bound is one
    row with an error, and so is a table whose header is; the rows of a document of more than max_chunks chunks say
    too_many_chunks. A null text is empty, a null key a document like another; no rows give none.

    Where chunks begin follows from sizes, found along sections of any length (see _starts); texts come together only as
    chunks, and only units larger than the bound go to Python.
    """
    bounded_batches(blocks.sparkSession)
    joins_by_rows(blocks.sparkSession)
    target = min(target, most)
    places = [c for c in place if c in blocks.columns]
    where = F.struct(*places) if places else F.lit(None).cast("struct<none:int>")
    path = F.when(F.size("heading_path") > 0, F.col("heading_path")).otherwise(F.array_compact(F.array("heading")))
    parts = heading_parts(F.coalesce(path, F.array().cast("array<string>")))
    rows = blocks.select(F.struct(F.col(key).alias("doc"), F.col("section_ord").cast("long").alias("section")).alias("_key"), F.col("block_ord").cast("long").alias("at"), "kind", F.coalesce("text", F.lit("")).alias("text"), F.when(F.coalesce(*(F.col(c).cast("string") for c in places), F.lit(None)).isNotNull() if places else F.lit(False), where).alias("place"), parts.alias("parts"))
    rows = materialize(rows.withColumn("head", F.when(F.size("parts") > 0, F.concat(F.lit("# "), F.array_join("parts", " > "), F.lit("\n\n"))).otherwise("")), "chunk_blocks")
    too_long = F.length("head") >= most
    chunks = _places(rows.filter(~too_long).select("_key", "at", "kind", F.length("text").alias("n"), "place", F.length("head").alias("head_n")), target, most)

    whole = rows.select("_key", "at", "kind", "text", "head", "parts").join(chunks.select("_key", "at", "chunk"), ["_key", "at"])
    whole = whole.groupBy("_key", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "text"))).alias("blocks"), F.first("head").alias("head"), F.first("parts").alias("parts"))
    whole = whole.select("_key", "chunk", "head", "parts", F.col("blocks.at").alias("ords"), F.col("blocks.kind").alias("kinds"), F.col("blocks.text").alias("texts"))
    size = F.aggregate("texts", F.lit(-2), lambda n, t: n + F.length(t) + 2)
    whole = materialize(whole.withColumn("large", size > most - F.length("head")), "chunk_texts")
    errors = rows.filter(too_long).groupBy("_key").agg(F.first("parts").alias("parts")).select("_key", F.lit(1).cast("long").alias("chunk"), "parts", F.lit(None).cast("array<long>").alias("ords"), F.lit(None).cast("array<string>").alias("kinds"), F.array(F.lit(None).cast("string")).alias("pieces"), F.lit("heading_too_long").alias("error"))
    fits = whole.filter("not large").select("_key", "chunk", "parts", "ords", "kinds", F.array(F.concat("head", F.array_join("texts", "\n\n"))).alias("pieces"), F.lit(None).cast("string").alias("error"))
    names = ["_key", "chunk", "parts", "ords", "kinds", "pieces", "error"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for head, kinds, texts in zip(*(batch[c].to_pylist() for c in ("head", "kinds", "texts")), strict=True):
                try:
                    found.append([head + p for p in _pieces(kinds, texts, max(1, target - len(head)), most - len(head))])
                    errors.append(None)
                except ValueError:
                    found.append([None])
                    errors.append("table_header_too_long")
            yield pa.record_batch([*(batch[c] for c in ("_key", "chunk", "parts", "ords", "kinds")), pa.array(found, pa.list_(pa.string())), pa.array(errors, pa.string())], names)

    key_type = whole.schema["_key"].dataType.simpleString()
    large = whole.filter("large").mapInArrow(cut, f"_key {key_type}, chunk long, parts array<string>, ords array<long>, kinds array<string>, pieces array<string>, error string")
    pieces = materialize(fits.unionByName(large).unionByName(errors), "chunk_pieces")
    return _numbered(pieces, blocks.schema[key].dataType.simpleString(), key, max_chunks)


def _numbered(pieces: DataFrame, kind: str, key: str, max_chunks: int) -> DataFrame:
    """A row for each piece, numbered along its document, with the document's error."""
    at = F.shiftleft(F.col("_key.section"), 32) + F.col("chunk")
    counts = materialize(pieces.select("_key", "chunk", F.struct("_key.doc").alias("doc"), at.alias("at"), F.size("pieces").alias("k")), "piece_counts")
    ends = materialize(along(counts, ["doc"], "at", sums={"until": F.col("k")}), "piece_ends")
    totals = counts.groupBy("doc").agg(F.sum("k").alias("total"))
    first = join_skewed(ends, totals, ["doc"], ["at"]).select("_key", "chunk", (F.col("until") - F.col("k")).alias("first"), "total")
    rows = pieces.join(first, ["_key", "chunk"]).select("*", F.posexplode("pieces").alias("_i", "text"))
    rows = rows.select(F.col("_key.doc").cast(kind).alias(key), F.col("_key.section").cast("int").alias("section_ord"), F.col("parts").alias("heading_path"), "text", F.transform("ords", lambda x: x.cast("int")).alias("block_ords"), F.col("kinds").alias("block_kinds"), F.coalesce("error", F.when(F.col("total") > max_chunks, "too_many_chunks")).alias("error"), (F.col("first") + F.col("_i")).cast("int").alias("sequence"))
    named = F.concat_ws("\x1f", F.col(key).cast("string"), F.col("section_ord").cast("string"), F.col("sequence").cast("string"), F.transform("block_ords", lambda x: x.cast("string")))
    return rows.withColumn("chunk_id", F.concat(F.lit("chunk-"), F.substring(F.sha2(named, 256), 1, 16)))
