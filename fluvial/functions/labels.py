"""Column functions for what is shown: source labels, places, tags, previews. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluvial.functions.text import collapsed

# Characters of a label, of a written tag, of a model's tag.
LABEL_CHARS, TAG_CHARS, MODEL_TAG_CHARS = 120, 48, 32


def source_label(path: Column) -> Column:
    """The last part of a path without control characters, 120 characters at most; `document` where nothing is left."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"(?s)([^/\\]*)\z", 1)
    label = F.rtrim(F.substring(collapsed(F.regexp_replace(name, r"[\x00-\x1f\x7f]+", " ")), 1, LABEL_CHARS))
    return F.when(label.isin("", ".", ".."), "document").otherwise(label)


def tag(text: Column) -> Column:
    """A tag of a-z, 0-9 and single hyphens, 48 characters at most; null is empty."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.rtrim(F.substring(F.trim(dashed, F.lit("-")), 1, TAG_CHARS), F.lit("-"))


def model_tag(text: Column) -> Column:
    """A model's tag: white space as one underscore, lower case; empty if longer than 32 characters."""
    out = F.lower(F.replace(collapsed(text), F.lit(" "), F.lit("_")))
    return F.when(F.length(out) <= MODEL_TAG_CHARS, out).otherwise("")


def default_tags(mode: Column, source_type: Column, *own: str) -> Column:
    """The library's own tags, the mode's and the source's, each once and in this order."""
    parts = [*map(F.lit, own), F.concat(F.lit("mode-"), mode), F.concat(F.lit("source-"), source_type)]
    return F.array_distinct(F.filter(F.array(*map(tag, parts)), lambda x: x != ""))


def split_tags(text: Column) -> Column:
    """Tags between commas, semicolons (also full-width) and white space, each once, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), "[,，;；\\s]+"), lambda x: x != ""))


def preview(text: Column, most: int = 120, mark: str = "...") -> Column:
    """Collapsed text, cut to `most` characters with the mark in them."""
    flat = collapsed(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - len(mark))), F.lit(mark)))


def clock(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on; whole seconds, none below zero."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("int")
    two = lambda x: F.format_string("%02d", x.cast("int"))
    short = F.concat_ws(":", two(F.floor(s / 60) % 60), two(s % 60))
    return F.when(s >= 3600, F.concat_ws(":", F.when(s >= 360_000, F.floor(s / 3600).cast("string")).otherwise(two(F.floor(s / 3600))), short)).otherwise(short)


def _range(start: str, end: str) -> Column:
    return F.when(F.col(end) > F.col(start), F.concat_ws("-", start, end)).otherwise(F.col(start).cast("string"))


def locator(columns: list[str]) -> Column:
    """struct(kind, value) of a place from the location columns that are there; the most exact one first, `document` at last."""
    col = lambda c: F.col(c) if c in columns else F.lit(None)
    at = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    found = [("page", "page", col("page")), ("slide", "slide", col("slide"))]
    if "sheet" in columns:
        inside = [F.when(F.length(col("cell_range")) > 0, at("cell", col("cell_range")))]
        inside += [F.when(col("row_start").isNotNull(), at("row", _range("row_start", "row_end")))] if "row_start" in columns else []
        sheet = F.when(col("sheet").isNotNull(), F.coalesce(*inside, at("sheet", col("sheet"))))
    else:
        sheet = F.lit(None).cast("struct<kind:string,value:string>")
    out = [F.when(col(c).isNotNull(), at(k, v)) for c, k, v in found] + [sheet, F.when(col("notebook_cell").isNotNull(), at("cell", col("notebook_cell")))]
    if "timestamp_start" in columns:
        out.append(F.when(col("timestamp_start").isNotNull(), at("timestamp", clock(col("timestamp_start")))))
    if "line_start" in columns:
        out.append(F.when(col("line_start").isNotNull(), at("line", _range("line_start", "line_end"))))
    out.append(F.when(F.length(col("section").cast("string")) > 0, at("section", col("section"))))
    return F.coalesce(*out, at("document", F.lit("document")))


def shown(label: Column, place: Column, most: int = 96) -> Column:
    """A label with its place, `most` characters in all: `notes.md · lines 3–5`."""
    value = F.when(place["kind"].isin("row", "line"), F.replace(place["value"], F.lit("-"), F.lit("–"))).otherwise(place["value"])
    many = place["kind"].isin("row", "line") & place["value"].contains("-")
    name = F.when(many, F.concat(place["kind"], F.lit("s"))).when(place["kind"] == "timestamp", "time").otherwise(place["kind"])
    return F.substring(F.when(place["kind"].isin("document", "block"), label).otherwise(F.concat(label, F.lit(" · "), name, F.lit(" "), value)), 1, most)


def escaped(text: Column) -> Column:
    """Text as HTML, lines as <br>."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    for plain, html in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(plain), F.lit(html))
    return out
