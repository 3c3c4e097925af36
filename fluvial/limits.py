"""Tables that may hold so many rows and no more."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fluvial.staging import discard, materialize


class TooManyRows(ValueError):
    """A bounded table was larger than its bound."""


def materialize_bounded(df: DataFrame, name: str, most: int) -> DataFrame:
    """A stored table of df, which may have `most` rows; TooManyRows if it has more, and nothing is kept.

    Rows are counted as they are written, in the same pass: no second scan, and no row goes to the driver. Writing stops
    no earlier than each task's end, but each task stops at most + 1 rows of its own, so too large a table is not written whole.
    """
    seen = Observation()
    own = df.mapInArrow(_first(most + 1), df.schema)
    table = materialize(own.observe(seen, F.count(F.lit(1)).alias("n")), name)
    if seen.get["n"] > most:
        discard(table)
        raise TooManyRows(f"{name}: over {most} rows")
    return table


def _first(most: int):  # noqa: ANN202
    def cut(batches):  # noqa: ANN001, ANN202
        left = most
        for batch in batches:
            if left <= 0:
                return
            yield batch.slice(0, left)
            left -= len(batch)

    return cut
