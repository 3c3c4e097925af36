"""Models' answers: JSON texts to cards and points, one structured error for a text that is none, and grounding in the source."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.text import casefolded, clean, collapsed

# Characters of a card's front, back and excerpt, at most.
FRONT, BACK, EXCERPT = 500, 4_000, 1_000


def first_json(text: str) -> object:
    """The first object or list anywhere in a text, without a fence of ``` around it; None if there is none."""
    text = text.strip()
    if text.startswith("```") and text.endswith("```") and len(lines := text.splitlines()) >= 3:
        text = "\n".join(lines[1:-1]).strip()
    read = json.JSONDecoder().raw_decode
    for at, c in enumerate(text):
        if c in "[{":
            try:
                return read(text, at)[0]
            except (ValueError, RecursionError):
                continue
    return None


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first JSON value of each text, written anew; whether it is a list; whether the text is blank."""
    for batch in batches:
        found = [None if t is None else first_json(t) for t in batch["_answer"].to_pylist()]
        texts = pa.array([None if v is None else json.dumps(v, ensure_ascii=False) for v in found], pa.string())
        blank = [not (t or "").strip() for t in batch["_answer"].to_pylist()]
        yield pa.record_batch([batch["_id"], texts, pa.array([isinstance(v, list) for v in found]), pa.array(blank)], ["_id", "_value", "_listed", "_blank"])


def _with_values(answers: DataFrame, key: str, text: str) -> DataFrame:
    rows = answers.select(F.col(key).alias("_id"), F.col(text).alias("_answer"))
    kind = answers.schema[key].dataType.simpleString()
    return rows.mapInArrow(_values, f"_id {kind}, _value string, _listed boolean, _blank boolean").withColumnRenamed("_id", key)


def _stripped(text: Column, blank: str | None) -> Column:
    """Without white space at either end, or without the characters of `blank`; null is empty."""
    return clean(text) if blank is None else F.btrim(F.coalesce(text, F.lit("")), F.lit(blank))


def _text(value: Column, most: int, blank: str | None) -> Column:
    """A JSON string, stripped; null if it is none, blank or too long."""
    kind = F.schema_of_variant(value)
    out = _stripped(F.try_variant_get(value, "$", "string"), blank)
    return F.when((kind == "STRING") & F.length(out).between(1, most), out)


def parse_cards(answers: DataFrame, key: str = "answer_id", text: str = "text", most: int = 5, blank: str | None = None) -> DataFrame:
    """key, state, card_ord, front, back, source_excerpt: the first `most` cards of each answer; one card that isn't whole fails them all.

    state: success, empty_output, invalid_json or empty_cards; an answer without cards is one row. A null or blank text is empty_output.
    blank: characters that are stripped off a card's texts, else all white space.
    """
    rows = _with_values(answers, key, text)
    value = F.try_parse_json("_value")
    listed = F.when(F.col("_listed"), value).otherwise(F.try_variant_get(value, "$.cards", "variant"))
    cards = F.try_variant_get(listed, "$", "array<variant>")
    is_list = F.coalesce(F.schema_of_variant(listed).startswith("ARRAY"), F.lit(False))

    def card(x: Column) -> Column:
        get = lambda name: F.try_variant_get(x, f"$.{name}", "variant")
        given = lambda v: v.isNotNull() & ~F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")).isin("", "0", "false")
        excerpt = F.when(given(get("source_excerpt")), get("source_excerpt")).otherwise(get("rationale"))
        return F.struct(_text(get("front"), FRONT, blank).alias("front"), _text(get("back"), BACK, blank).alias("back"), _text(excerpt, EXCERPT, blank).alias("source_excerpt"))

    rows = rows.withColumn("_cards", F.when(is_list, F.transform(F.slice(cards, 1, most), card)))
    whole = F.forall("_cards", lambda c: c["front"].isNotNull() & c["back"].isNotNull() & c["source_excerpt"].isNotNull())
    state = F.when(F.col("_blank"), "empty_output").when(F.col("_cards").isNull(), "invalid_json").when(F.size("_cards") == 0, "empty_cards").when(~whole, "invalid_json").otherwise("success")
    rows = rows.withColumn("state", state).withColumn("_cards", F.when(F.col("state") == "success", F.col("_cards")))
    return rows.select(key, "state", F.posexplode_outer("_cards").alias("card_ord", "_c")).select(key, "state", "card_ord", "_c.*")


def parse_points(answers: DataFrame, key: str = "chunk_id", text: str = "text", blank: str | None = None) -> DataFrame:
    """key, error, point_ord, point_id, title, explanation, evidence, importance, tags of each answer: a JSON list, or {"knowledge_points": []}.

    The whole text must be JSON. An answer that isn't right is one row with error invalid_json; an empty list gives no row.
    blank: as for parse_cards.
    """
    value = F.try_parse_json(clean(F.col(text)))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    listed = F.when(kind(value).startswith("ARRAY"), value).otherwise(F.try_variant_get(value, "$.knowledge_points", "variant"))
    rows = answers.select(key, F.when(kind(listed).startswith("ARRAY"), F.try_variant_get(listed, "$", "array<variant>")).alias("_items"))

    def point(x: Column) -> Column:
        get = lambda name: _stripped(F.try_variant_get(x, f"$.{name}", "string"), blank)
        tags = F.try_variant_get(x, "$.tags", "variant")
        names = F.filter(F.transform(F.coalesce(F.try_variant_get(tags, "$", "array<string>"), F.array()), lambda t: _stripped(t, blank)), lambda t: t != "")
        right = kind(x).startswith("OBJECT") & (get("title") != "") & (get("explanation") != "") & (tags.isNull() | kind(tags).startswith("ARRAY") | (kind(tags) == "VOID"))
        importance = F.coalesce(F.nullif(get("importance"), F.lit("")), F.lit("medium"))
        return F.struct(right.alias("right"), get("title").alias("title"), get("explanation").alias("explanation"), get("evidence").alias("evidence"), importance.alias("importance"), names.alias("tags"))

    rows = rows.withColumn("_items", F.transform("_items", point))
    wrong = F.col("_items").isNull() | F.exists("_items", lambda p: ~p["right"])
    none = F.array(F.lit(None).cast(rows.schema["_items"].dataType.elementType))
    rows = rows.withColumn("error", F.when(wrong, "invalid_json")).select(key, "error", F.posexplode(F.when(wrong, none).otherwise(F.col("_items"))).alias("point_ord", "_p"))
    digest = F.substring(F.sha2(collapsed(F.concat("_p.title", F.lit("\n"), "_p.explanation")), 256), 1, 12)
    point_id = F.concat(F.lit("kp_"), F.col(key).cast("string"), F.lit("_"), F.col("point_ord").cast("string"), F.lit("_"), digest)
    return rows.select(key, "error", F.when(F.col("error").isNull(), F.col("point_ord")).alias("point_ord"), F.when(F.col("error").isNull(), point_id).alias("point_id"), *(F.col(f"_p.{c}") for c in ("title", "explanation", "evidence", "importance", "tags")))


def basic_cards(cards: DataFrame, key: str, card_type: Column, most: int) -> DataFrame:
    """The first `most` cards of each key (card_ord); an answer with a card that isn't of type basic, or lacks a side, gives none but an error."""
    rows = cards.filter(F.col("card_ord") < most).withColumn("_bad", ~F.coalesce(card_type == "basic", F.lit(False)) | (clean(F.col("front")) == "") | (clean(F.col("back")) == ""))
    failed = rows.filter("_bad").select(key).distinct().withColumn("_failed", F.lit(True))
    rows = rows.join(failed, key, "left")
    return rows.withColumn("error", F.when(F.col("_failed"), "card_validation")).drop("_bad", "_failed")


def ground(cards: DataFrame, points: DataFrame, chunks: DataFrame, key: str = "answer_id") -> DataFrame:
    """Cards (point_id, chunk_id, source_excerpt) with error: unknown_point, outside_batch or not_grounded; and `accepted`, if no card of the answer has one.

    points: point_id, chunk_id; chunks: chunk_id, text. An excerpt is grounded if the chunk's text has it, spaces and case aside.
    """
    known = points.select("point_id", F.col("chunk_id").alias("_home"))
    norm = lambda x: casefolded(collapsed(x))
    rows = cards.join(known, "point_id", "left").join(chunks.select("chunk_id", F.col("text").alias("_text")), "chunk_id", "left")
    error = F.when(F.col("_home").isNull(), "unknown_point").when(~F.col("_home").eqNullSafe(F.col("chunk_id")), "outside_batch").when(~F.contains(norm(F.coalesce("_text", F.lit(""))), norm(F.col("source_excerpt"))), "not_grounded")
    rows = rows.withColumn("error", error).drop("_home", "_text")
    failed = rows.filter("error is not null").select(key).distinct().withColumn("_failed", F.lit(True))
    return rows.join(failed, key, "left").withColumn("accepted", F.col("_failed").isNull()).drop("_failed")
