"""Texts and files to blocks where a format needs a parser: Arrow batches in, rows of blocks out, one document in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: What a parser yields of each block. Sections and blocks count from 0 within their document.
BLOCK = pa.struct([
    ("section_ord", pa.int32()), ("heading", pa.string()), ("heading_path", pa.list_(pa.string())), ("block_ord", pa.int32()), ("kind", pa.string()),
    ("text", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("place", pa.string()), ("language", pa.string()),
])
_TYPES = "section_ord int, heading string, heading_path array<string>, block_ord int, kind string, text string, line_start int, line_end int, place string, language string, error string"


class Rejected(ValueError):
    """A document that can't be read; its code becomes the row's `error`."""


def block(section: int, path: Iterable[str], at: int, kind: str, text: str, start: int | None = None, end: int | None = None, place: str | None = None, language: str | None = None) -> dict:
    path = list(path)
    return {"section_ord": section, "heading": path[-1] if path else None, "heading_path": path, "block_ord": at, "kind": kind, "text": text, "line_start": start, "line_end": end, "place": place, "language": language}


def parsed(rows: DataFrame, parse: Callable[[str], Iterator[dict]], column: str = "text", key: str = "doc_id") -> DataFrame:
    """The key and the blocks that `parse` yields of each value, in place: no shuffle.

    Null counts as empty. A document that the parser rejects is one row with `error`, and none of its blocks; a document
    without blocks has no row.
    """
    fields = [f.name for f in BLOCK]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                error, found = None, []
                try:
                    found = list(parse(value if value is not None else ""))
                except Rejected as e:
                    error, found = str(e), [{}]
                if found:
                    table = pa.array(found, BLOCK)
                    own = pa.array([batch.column(0)[i].as_py()] * len(found), batch.column(0).type)
                    yield pa.record_batch([own, *table.flatten(), pa.array([error] * len(found), pa.string())], [key, *fields, "error"])

    return rows.select(key, column).mapInArrow(read, f"{key} {rows.schema[key].dataType.simpleString()}, {_TYPES}")
