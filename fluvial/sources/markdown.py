"""Markdown to blocks: one regular expression cuts a text into headings, fences, lists, tables and paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.sources.parsed import block, parsed

_HEADING = r"\#{1,6}[^\S\n]+\S.*\n"
_ITEM = r"[^\S\n]*(?:[-+*]|\d+[.)])[^\S\n]+.*\n"
_FENCE = r"[^\S\n]*(?:```|~~~)"
_BLANK = r"[^\S\n]*\n"
_BLOCK = re.compile(rf"""
    (?P<marks>\#{{1,6}})[^\S\n]+(?P<heading>\S.*)\n
  | [^\S\n]*(?P<fence>```|~~~)(?P<language>.*)\n(?P<code>(?:(?![^\S\n]*(?P=fence)).*\n)*)(?:.*\n)?
  | (?P<list>(?:{_ITEM})+)
  | (?P<head>.*\|.*\n)[^\S\n]*\|?(?:[^\S\n]*:?-{{3,}}:?[^\S\n]*\|)+[^\S\n]*\n(?P<rows>(?:.*\|.*\n)*)
  | (?P<blank>{_BLANK})
  | (?P<paragraph>.*\n(?:(?!{_HEADING}|{_ITEM}|{_FENCE}|{_BLANK}).*\n)*)
""", re.VERBOSE)  # fmt: skip
_MARK = re.compile(r"^[^\S\n]*(?:[-+*]|\d+[.)])[^\S\n]+", re.MULTILINE)
_FRONT = re.compile(r"[^\S\n]*---[^\S\n]*\n(?:(?![^\S\n]*---[^\S\n]*\n).*\n){0,49}[^\S\n]*---[^\S\n]*\n")
#: The same for Spark, on texts with \n alone.
FRONT = r"(?s)\A[ \t]*---[ \t]*\n((?:(?![ \t]*---[ \t]*\n)[^\n]*\n){0,49})[ \t]*---[ \t]*(?:\n.*)?\z"


def blocks_of(text: str) -> Iterator[dict]:
    """A section ends before each heading; its path holds the headings above it. Texts before the first heading have none."""
    text = "".join(line + "\n" for line in text.splitlines())
    front = _FRONT.match(text)
    at = front.end() if front else 0
    line, section, path, seen = 1 + text.count("\n", 0, at), -1, [""] * 6, 0
    for m in _BLOCK.finditer(text, at):
        start, line = line, line + m[0].count("\n")
        if m["blank"] is not None:
            continue
        if m["heading"] is not None:
            level = len(m["marks"])
            path[level - 1 :] = [m["heading"].strip(), *[""] * (6 - level)]
            section += 1
            out = ("heading", path[level - 1])
        elif m["fence"]:
            out = ("code", m["code"].removesuffix("\n"))
        elif m["list"]:
            out = ("list", "\n".join(x.strip() for x in _MARK.sub("", m["list"]).removesuffix("\n").split("\n")))
        elif m["head"]:
            out = ("table", (m["head"] + m["rows"]).removesuffix("\n"))
        else:
            out = ("paragraph", "\n".join(x.rstrip() for x in m["paragraph"].removesuffix("\n").split("\n")))
        section = max(section, 0)
        yield block(section, filter(None, path), seen, *out, start, line - 1, language=m["language"].strip()[:64] if m["fence"] else None)
        seen += 1


def blocks(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    return parsed(docs, blocks_of, column, key)


def front_matter(text: Column) -> Column:
    """struct(title, tags) of the lines between two `---` at the start, the second within 50 lines; null where there are none.

    A title of over 120 characters, with a slash or a backslash, or that looks like a secret is none. At most 20 tags.
    """
    inside = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), FRONT, 1)
    value = lambda name: F.regexp_replace(F.trim(F.element_at(F.regexp_extract_all(inside, F.lit(rf"(?im)^[ \t]*{name}[ \t]*:(.*)$"), F.lit(1)), -1)), "^['\"]+|['\"]+$", "")
    title, tags = value("title"), value("tags")
    good = (title != "") & (F.length(title) <= 120) & ~title.rlike(r"[/\\]") & ~F.lower(title).rlike("api_key|authorization|bearer ")
    parts = F.transform(F.split(F.regexp_replace(tags, r"^[\[\]]+|[\[\]]+$", ""), ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""))
    return F.when(inside != "", F.struct(F.when(good, title).alias("title"), F.slice(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda x: x != ""), 1, 20).alias("tags")))
