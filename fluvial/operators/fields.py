"""Names and values at the edges: fields of a note type, settings of a run, bounded and safe texts, one canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.operators.lifecycle import CARD_LIMITS

# Names that a field may have, in the order in which they are looked for.
FRONT = ("front", "question", "正面", "问题", "题目")
BACK = ("back", "answer", "背面", "答案")
SOURCE = ("source", "来源", "extra", "出处")
CLOZE_FRONT = ("text", "文本", "文字")
CLOZE_BACK = ("backextra", "back extra", "背面额外", "额外")
# What tells a credential, a sensitive key and a path of the machine; characters of a text, a preview and a metadata value.
CREDENTIAL = r"(?i)(?:\bsk-[A-Za-z0-9_-]{12,}\b|\bbearer\s+[A-Za-z0-9._~+/=-]{12,}\b|\bAKIA[A-Z0-9]{16}\b)"
SENSITIVE_KEY = r"(?i)(?:api.?key|password|secret|credential|access.?token|private.?key)"
LOCAL_PATH = r"^(?:[/\\]|[A-Za-z]:[\\/])|(?:^|[/\\])\.\.(?:[/\\]|$)"
MARKERS = ("apikey", "token", "secret", "bearer", "password", "authorization")
MATERIAL, KEY_CHARS, VALUE_CHARS, ITEMS = 50_000, 120, 2_000, 128


def suggest_fields(fields: DataFrame, note_type: str = "note_type") -> DataFrame:
    """front_field, back_field, source_field and complete for each note type, from its fields (ord, name) and its template.

    A field that is one role isn't another; of several with one name the last one counts.
    """
    plain = lambda x: F.regexp_replace(F.lower(x), r"(?U)[\s_-]+", "")
    name = plain(F.col("name"))
    rows = fields.withColumn("_key", name).groupBy(note_type, "_key").agg(F.max_by("name", "ord").alias("name"), F.max("template").alias("template"))
    cloze = F.col("template") == "cloze_candidate"

    def rank(own: tuple[str, ...], more: tuple[str, ...]) -> Column:
        keys = lambda names: F.array(*(plain(F.lit(n)) for n in names))
        place = F.array_position(F.when(cloze, keys((*more, *own))).otherwise(keys(own)), F.col("_key"))
        return F.when(place > 0, place)

    rows = rows.withColumns({"_front": rank(FRONT, CLOZE_FRONT), "_back": rank(BACK, CLOZE_BACK), "_source": rank(SOURCE, ())})
    best = lambda role: F.sort_array(F.collect_list(F.when(F.col(role).isNotNull(), F.struct(F.col(role).alias("p"), F.col("name").alias("name")))))
    found = rows.groupBy(note_type).agg(best("_front").alias("f"), best("_back").alias("b"), best("_source").alias("s"))  # names that are known alone: some ten a type at most
    first = lambda xs, *taken: F.get(F.filter(xs, lambda x: ~F.coalesce(F.array_contains(F.array(*taken), x["name"]), F.lit(False)) if taken else F.lit(True)), 0)["name"]
    found = found.withColumn("front_field", first(F.col("f")))
    found = found.withColumn("back_field", first(F.col("b"), F.coalesce("front_field", F.lit(""))))
    found = found.withColumn("source_field", first(F.col("s"), F.coalesce("front_field", F.lit("")), F.coalesce("back_field", F.lit(""))))
    return found.select(note_type, "front_field", "back_field", "source_field", (F.col("front_field").isNotNull() & F.col("back_field").isNotNull()).alias("complete"))


def assess_fields(rows: DataFrame, fields: Column) -> DataFrame:
    """Add reasons: front_field_required, back_field_required, mapped_field_missing, mapped_fields_not_unique."""
    chosen = F.array_compact(F.array("front_field", "back_field", "source_field"))
    cases = {"front_field_required": F.col("front_field").isNull(), "back_field_required": F.col("back_field").isNull(), "mapped_field_missing": F.size(F.array_except(chosen, fields)) > 0, "mapped_fields_not_unique": F.size(F.array_distinct(chosen)) < F.size(chosen)}
    return rows.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in cases.items()))))


def card_limits(spark: SparkSession) -> DataFrame:
    """asked, card_limit: the table of settings to join runs with."""
    return spark.createDataFrame(list(CARD_LIMITS.items()), "asked string, card_limit int")


def clamp_range(low: Column, high: Column, limit: Column) -> Column:
    """A range of cards within a limit, as struct(low, high)."""
    return F.struct(F.least(low, limit).alias("low"), F.least(high, limit).alias("high"))


def bounded_material(rows: DataFrame, text: str, shown: int = 2_000) -> DataFrame:
    """Add char_count, error (material_too_long), preview and truncated."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return rows.withColumns({"char_count": n, "error": F.when(n > MATERIAL, "material_too_long"), "preview": F.substring(F.coalesce(F.col(text), F.lit("")), 1, shown), "truncated": n > shown})


def append_material(old: Column, label: Column, new: Column) -> Column:
    """New text behind the old one, under a line with its label; alone where the old one is blank."""
    old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when(~old.rlike(r"(?U)\S"), new).otherwise(F.concat(old, F.lit("\n\n--- "), label, F.lit(" ---\n\n"), new))


def unsafe(value: Column) -> Column:
    """Why a text may not be kept: local_path, credential or null."""
    return F.when(value.rlike(LOCAL_PATH), "local_path").when(value.rlike(CREDENTIAL), "credential")


def checked_metadata(metadata: Column) -> Column:
    """The first fault of a map of texts: too_many_items, bad_key, sensitive_key, value_too_long, local_path, credential; null if there is none."""
    keys, values = F.map_keys(metadata), F.map_values(metadata)
    fault = F.when(F.size(metadata) > ITEMS, "too_many_items").when(F.exists(keys, lambda k: ~F.length(k).between(1, KEY_CHARS)), "bad_key").when(F.exists(keys, lambda k: k.rlike(SENSITIVE_KEY)), "sensitive_key")
    fault = fault.when(F.exists(values, lambda v: F.length(v) > VALUE_CHARS), "value_too_long").when(F.exists(values, lambda v: v.rlike(LOCAL_PATH)), "local_path")
    return fault.when(F.exists(values, lambda v: v.rlike(CREDENTIAL)), "credential")


def scrubbed(config: Column) -> Column:
    """A map without the keys that name a credential, whatever their case and separators."""
    compact = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    return F.map_filter(config, lambda k, v: ~compact(k).rlike("|".join(MARKERS)))


def canonical_json(rows: DataFrame, names: list[str]) -> Column:
    """One JSON text of the columns, keys in order, no blanks, null fields kept."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
