"""Harmonic packing of documents into training sequences.

A document's ids are cut at full sequences, and the rest at halves: 1024, 512, ... down to SMALL ids, so that all
pieces but a document's last have a length that divides the sequence. A piece of length n is of class k = capacity
div n, and each bin of a class takes k pieces, a fixed count, whatever other pieces there are. So every worker fills
bins of its own as pieces come, holding only the open bins' pieces, and no rows are moved. What is in open bins when
a worker ends is dealt anew, longest piece first, into bins of any classes; pieces of power-of-two length are
first put together as powers of two, for such sequences need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.llm.bpe import encoder, share_vocabulary, texts
from fluvial.staging import bounded_batches

CAPACITY, SMALL, END_ID = 2048, 64, 1
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_lengths(n: int, capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """Lengths that add up to n: full sequences, then halves, quarters, ... and a rest under `small`."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= small:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return out + [n] * (n > 0)


class Bins:
    """The open bins of one worker. Pieces are tuples whose third item is their length; `emit` gets (piece, bin, offset)."""

    def __init__(self, emit: Callable[[tuple, int, int], None], capacity: int = CAPACITY) -> None:
        self.emit, self.capacity, self.next = emit, capacity, 0
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self._close(held)
            del self.open[k]

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.emit(p, self.next, at)
            at += p[2]
        self.next += 1

    def finish(self) -> None:
        left = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        self.open = {}
        even = [p for p in left if p[2] & (p[2] - 1) == 0 and p[2] >= SMALL]
        total = sum(p[2] for p in even)
        for bit in reversed(range(self.capacity.bit_length())):
            while total >= 1 << bit:  # longest first, powers of two fill a larger one exactly
                group, room = [], 1 << bit
                while room:
                    group.append(even.pop(0))
                    room -= group[-1][2]
                self._close(group)
                total -= 1 << bit
        group, room = [], self.capacity
        for p in (p for p in left if not (p[2] & (p[2] - 1) == 0 and p[2] >= SMALL)):
            if p[2] > room:
                self._close(group)
                group, room = [], self.capacity
            group.append(p)
            room -= p[2]
        if group:
            self._close(group)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_type: str = "long") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and END_ID; null and empty texts are END_ID alone. Every id is in exactly one piece.
    sequence_id joins the worker's number and its bin's; offsets in a sequence are gapless. Texts of any length are
    packed whole. Rows that repeat are packed each by itself; an empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    bounded_batches(docs.sparkSession)
    spec = share_vocabulary(docs.sparkSession, vocabulary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ready = encoder(spec.value), []
        worker = TaskContext.get().partitionId() << 36
        bins = Bins(lambda p, k, at: ready.append((*p, worker + k, at)), capacity)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True):
                ids = np.append(enc.encode(text), np.uint32(END_ID)).astype("<u4", copy=False)
                at = 0
                for n in cut_lengths(len(ids), capacity):
                    bins.add((doc_id, at, n, zlib.crc32(ids[at : at + n]), len(ids)))
                    at += n
            yield _rows(ready)
            ready.clear()
        bins.finish()
        yield _rows(ready)

    return docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), "text").mapInArrow(pack, SCHEMA)


def _rows(ready: list[tuple]) -> pa.RecordBatch:
    columns = zip(*ready, strict=True) if ready else [()] * len(COLUMNS)
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], list(COLUMNS))
