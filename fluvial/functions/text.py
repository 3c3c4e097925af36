"""Column functions on texts. Everything stays in the JVM but what it has no function for: NFKC and the characters that HTML names."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as CJK.
CJK = r"[\x{3400}-\x{9fff}]"


def clean(text: Column) -> Column:
    """Without white space at either end; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; case stays."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    """Collapsed and in lower case: the key of cards in a batch and of notes that exist."""
    return F.lower(collapsed(text))


def casefolded(text: Column) -> Column:
    """Lower case that is blind to case throughout: ß as ss, and one form of s and of sigma."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ſς", "sσ")


def letters_only(text: Column) -> Column:
    """Letters and digits in lower case: the key of point titles."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def _pairs(text: Column) -> Column:
    together = F.regexp_replace(text, r"[^\x{3400}-\x{9fff}]", "")
    return F.regexp_extract_all(together, F.lit("(?=(.{2}))."), F.lit(1))


def cjk_pairs(text: Column) -> Column:
    """Each two neighbours of all CJK characters of the text, put together."""
    return F.array_distinct(_pairs(text))


def words(text: Column) -> Column:
    """A text's words of two or more of a-z, 0-9 and _, and its CJK pairs, as often as they come."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), F.lit(0)), _pairs(low))


def tokens(text: Column) -> Column:
    """The set of a text's words."""
    return F.array_distinct(words(text))


def runs(text: Column) -> Column:
    """A text's runs of three characters, as often as they come; a shorter text is its own only run."""
    found = F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))."), F.lit(1))
    return F.when(F.length(text) >= 3, found).otherwise(F.filter(F.array(text), lambda x: x != ""))


def language(zh: Column, en: Column) -> Column:
    """zh, en, mixed or unknown, by numbers of CJK and Latin letters. Mixed: at least 8, or a fifth, of the rarer."""
    least = F.least(zh, en)
    mixed = (least >= 8) | ((least > 0) & (least / F.nullif(zh + en, F.lit(0)) >= 0.2))
    return F.when(zh + en == 0, "unknown").when(mixed, "mixed").when(zh > en, "zh").otherwise("en")


def nfkc_casefold(text: Column) -> Column:
    """Compatibility forms made one (full-width letters and marks, ligatures) and case folded; null is empty."""

    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t or "").casefold())

    return F.pandas_udf(fold, "string")(text)


_HIDDEN = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")


def plain_of_html(text: Column) -> Column:
    """The text of a note's HTML: blocks and <br> by lines, no scripts and styles, characters decoded; null is empty."""

    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: html.unescape(_TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", t or "")))))

    return F.pandas_udf(plain, "string")(text)


def note_key(field: Column) -> Column:
    """What a note's HTML field has in common with a card's plain text: decoded, collapsed, case folded."""
    return casefolded(collapsed(plain_of_html(field)))
