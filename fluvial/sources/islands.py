"""Texts to blocks: runs of lines that aren't blank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(docs: DataFrame, kind: str = "paragraph", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_ord, kind, text, line_start, line_end) of each run of non-blank lines; lines count from 1.

    Lines of paragraphs lose white space at their end, those of kind `code` keep it. A document's lines are folded
    where they are: no shuffle, and no more in memory than a document. Blank and null texts have no blocks.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n")
    if kind != "code":
        clean = F.regexp_replace(clean, r"(?U)[^\S\n]++(?=\n|\z)", "")
    lines = F.split(clean, "\n")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    # a run's lines have their number less their place among the non-blank lines in common
    full = F.filter(numbered, lambda x: x["text"].rlike(r"(?U)\S"))
    placed = F.transform(full, lambda x, i: F.struct((x["line"] - i).alias("run"), x["line"].alias("line"), x["text"].alias("text")))
    rows = docs.select(key, placed.alias("placed"))
    starts = F.array_compact(F.transform("placed", lambda x, i: F.when((i == 0) | (x["run"] != F.get("placed", i - 1)["run"]), i)))
    rows = rows.withColumn("starts", starts)
    # only the pieces are dealt out, so a row doesn't carry all lines of its document
    pieces = F.transform("starts", lambda s, k: F.slice("placed", s + 1, F.coalesce(F.get("starts", k + 1), F.size("placed")) - s))
    rows = rows.select(key, F.posexplode(pieces).alias("block_ord", "own"))
    return rows.select(
        key,
        "block_ord",
        F.lit(kind).alias("kind"),
        F.array_join(F.transform("own", lambda x: x["text"]), "\n").alias("text"),
        F.element_at("own", 1)["line"].alias("line_start"),
        F.element_at("own", -1)["line"].alias("line_end"),
    )
