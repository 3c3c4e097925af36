"""JSON values to rows of path and value."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed value: how deep values may lie in each other.
MOST_DEPTH = 64


class TooDeep(ValueError):
    """A value lies deeper than it may."""


def scalars(value: object, path: str = "$", most_depth: int = MOST_DEPTH) -> Iterator[tuple[str, str]]:
    """(path, value) of each scalar, in document order. Dots and backslashes in keys are escaped. TooDeep if one lies too deep."""
    todo = [(path, value, 1)]
    while todo:
        at, v, depth = todo.pop()
        if depth > most_depth:
            raise TooDeep
        if isinstance(v, dict):
            todo += reversed([(f"{at}.{k.replace(chr(92), chr(92) * 2).replace('.', chr(92) + '.')}", x, depth + 1) for k, x in v.items()])
        elif isinstance(v, list):
            todo += reversed([(f"{at}[{i}]", x, depth + 1) for i, x in enumerate(v)])
        else:
            yield at, v if isinstance(v, str) else json.dumps(v)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _blocks_of(text: str | None, most_depth: int) -> list[tuple]:
    """(block_ord, text, section, error) of a record. A record with any error is that error alone."""
    try:
        return [(i, f"{p} = {v}", p.rpartition(".")[0] or p, None) for i, (p, v) in enumerate(list(scalars(json.loads(text or "null", parse_constant=_no_constant), most_depth=most_depth)))]
    except TooDeep:
        return [(0, None, None, "document_too_complex")]
    except (ValueError, RecursionError):
        return [(0, None, None, "invalid_json")]


def _each(most_depth: int, keep: list[str], column: str):  # noqa: ANN202
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_blocks_of(t, most_depth) for t in batch[column].to_pylist()]
            again = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            ords, *rest = zip(*(r for rows in found for r in rows), strict=True) if len(again) else ((), (), (), ())
            yield pa.record_batch([*(batch[c].take(again) for c in keep), pa.array(ords, pa.int32()), *(pa.array(c, pa.string()) for c in rest)], [*keep, "block_ord", "text", "section", "error"])

    return read


def json_blocks(rows: DataFrame, key: str, column: str, most_depth: int = MOST_DEPTH) -> DataFrame:
    """key, block_ord, text (`path = value`), error of each row's JSON text.

    A text that isn't JSON, or holds NaN or Infinity, is one row with invalid_json, one with values too deep in each other one
    with document_too_complex. Rows are parsed by themselves: paths come in the order of the text, which variants don't keep.
    """
    own = rows.select(F.col(key).cast("long").alias(key), column)
    return own.mapInArrow(_each(most_depth, [key], column), f"{key} long, block_ord int, text string, section string, error string").drop("section")


def json_lines(rows: DataFrame, key: str, column: str, most_depth: int = MOST_DEPTH) -> DataFrame:
    """key, record (from 1), line (from 1), block_ord, text, section, error of each line of JSON that isn't blank, errors as in json_blocks.

    A line is a row before it is parsed, so a long text is dealt out. section is a value's path without its last part.
    """
    lines = rows.select(F.col(key).cast("long").alias(key), F.split(F.coalesce(F.col(column), F.lit("")), r"\r\n?|\n").alias("lines"))
    full = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("json"))), lambda s: s["json"].rlike(r"(?U)\S"))
    each = lines.select(key, F.posexplode(full).alias("record", "own")).select(key, (F.col("record") + 1).alias("record"), "own.line", "own.json")
    return each.mapInArrow(_each(most_depth, [key, "record", "line"], "json"), f"{key} long, record int, line int, block_ord int, text string, section string, error string")
