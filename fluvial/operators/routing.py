"""What a document is, which modes and templates suit it, and what a run over it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.text import language
from fluvial.operators.planning import MOST_POINTS, POINT_CHARS

# What tells a definition, a comparison and a step, in texts and in titles.
DEFINITION = r"(?i)(?:\b(?:means|defined\s+as|refers\s+to)\b|\b(?:is|are)\s+(?:an?\s+|the\s+type\s+of\b|types?\s+of\b)|(?:定义为|是指|指的是))"
COMPARISON = r"(?i)(?:\b(?:unlike|versus|whereas|compared\s+(?:with|to)|difference|similar)\b|(?:相比|区别|不同于|相同于|而非|对比))"
STEP = r"(?i)(?:\b(?:first|then|next|finally|step\s*\d*)\b|(?:首先|然后|接着|最后|步骤\s*[一二三四五六七八九十\d]*))"
TITLE_COMPARISON = r"(?i)(?:\b(?:unlike|versus|whereas|difference)\b|(?:相比|区别|不同于|对比))"
TITLE_STEP = r"(?i)(?:\b(?:first|then|next|finally|step)\b|(?:首先|然后|最后|步骤))"
CJK_LETTER = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
SPECIAL = ("formula", "code", "table", "transcript")
STRUCTURED = ("heading", "list", "list_item", "quote")

# Modes in the order in which a document's counts ask for them, with the count of each.
MODES = {"code_understanding": "code", "table_relationship": "table", "transcript_summary_candidate": "transcript", "formula_rule": "formula", "compare_contrast": "comparison", "process_steps": "process", "definition": "definition"}
# Modes in the order in which a point asks for them, with its types and the kind of block.
POINT_MODES = {
    "formula_rule": (("formula", "rule"), "formula"),
    "code_understanding": (("code", "code_understanding"), "code"),
    "table_relationship": (("table", "relationship"), "table"),
    "transcript_summary_candidate": (("transcript", "summary"), "transcript"),
    "compare_contrast": (("comparison", "compare"), None),
    "process_steps": (("process", "sequence"), None),
    "definition": (("definition", "term"), None),
}
# The template of each mode, where it isn't the mode itself, and the reason code's last part.
TEMPLATES = {"exam": "exam_answer", "code_understanding": "concept", "table_relationship": "compare_contrast", "transcript_summary_candidate": "concept"}
REASONS = {"code_understanding": "code", "table_relationship": "table", "transcript_summary_candidate": "transcript", "formula_rule": "formula", "compare_contrast": "comparison", "process_steps": "process", "definition": "definition", "concept": "concept_fallback"}
# Level, share of points at least and at most, calls at least and at most.
LEVELS = (("fast", 0.5, 1.0, 1, 3), ("standard", 0.75, 1.25, 3, 8), ("deep", 1.0, 1.5, 4, 12))


def signals(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: every count, its kind, density, confidence, language and modes, from one aggregation.

    `blocks` has kind and text. Blank and null texts count as blocks alone; a document without any other is `empty`.
    """
    text = F.coalesce("text", F.lit(""))
    full = text.rlike(r"(?U)\S")
    n = F.length(text)
    seen = lambda hit: F.count_if(full & hit)
    letters = lambda p: F.sum(F.when(full, n - F.length(F.regexp_replace(text, p + "+", ""))).otherwise(0))
    counts = blocks.groupBy(key).agg(
        F.count("*").alias("block_count"), seen(F.lit(True)).alias("content_blocks"), F.sum(F.when(full, n).otherwise(0)).alias("char_count"),
        seen(text.rlike(DEFINITION)).alias("definition"), seen(text.rlike(COMPARISON)).alias("comparison"), seen(F.regexp_count(text, F.lit(STEP)) >= 2).alias("process"),
        *(seen(F.col("kind") == k).alias(k) for k in SPECIAL),
        F.count_if(F.col("kind").isin(*STRUCTURED)).alias("_structured"),
        F.least(F.lit(MOST_POINTS), F.sum(F.when(full, F.greatest(F.lit(1), F.ceil(n / POINT_CHARS))).otherwise(0))).cast("long").alias("estimated_points"),
        language(letters(CJK_LETTER), letters("[A-Za-z]")).alias("language"),
    )
    some = lambda *names: sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in names), F.lit(0))
    kind = F.when(F.col("content_blocks") == 0, "empty").when(some(*SPECIAL) > 1, "mixed")
    for k in ("code", "table", "transcript", "formula", "_structured"):
        kind = kind.when(F.col(k) > 0, k.lstrip("_"))
    share = sum((F.col(c) for c in SPECIAL), F.lit(0)) / F.greatest(F.col("content_blocks"), F.lit(1))
    sure = F.least(F.lit(0.98), F.round(F.lit(0.55) + some("definition", "comparison", "process", *SPECIAL) * F.lit(0.06) + share * F.lit(0.08), 2))
    modes = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(m)) for m, c in MODES.items()), F.lit("concept")))
    return counts.withColumns({
        "document_kind": kind.otherwise("text"),
        "content_density": F.round(F.col("char_count") / F.col("block_count"), 2),
        "confidence": F.when(F.col("content_blocks") == 0, 0.25).otherwise(sure),
        "modes": modes,
    }).drop("_structured")


def point_type(title: Column, kinds: Column) -> Column:
    """The type of a point from its chunk's kinds of blocks, else from its title."""
    out = F.when(F.array_contains(kinds, SPECIAL[0]), SPECIAL[0])
    for k in SPECIAL[1:]:
        out = out.when(F.array_contains(kinds, k), k)
    return out.when(title.rlike(TITLE_COMPARISON), "comparison").when(F.regexp_count(title, F.lit(TITLE_STEP)) >= 2, "process").when(title.rlike(DEFINITION), "definition").otherwise("concept")


def route(rows: DataFrame, requested: Column, kind_of_point: Column, kinds: Column) -> DataFrame:
    """Add mode, template, reason_code and route_confidence to rows with a document's `signals`.

    A requested mode other than `auto` wins; then the point's type and blocks; then the document's counts, in another order.
    """
    asked = F.coalesce(requested, F.lit("auto"))
    kind_of_point, kinds = F.lower(F.coalesce(kind_of_point, F.lit(""))), F.coalesce(kinds, F.array().cast("array<string>"))
    point = F.lit(None).cast("string")
    for mode, (types, block) in reversed(POINT_MODES.items()):
        point = F.when(kind_of_point.isin(*types) | (F.array_contains(kinds, block) if block else F.lit(False)), mode).otherwise(point)
    document = F.get("modes", 0)
    auto = F.coalesce(point, document)
    mapped = lambda table, x: F.element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), x)
    mode = F.when(asked != "auto", asked).otherwise(auto)
    sure = F.when(asked != "auto", 1.0).when(point.isNotNull(), 0.92).otherwise(F.greatest(F.when(document == "concept", 0.5).otherwise(0.8), F.col("confidence")))
    reason = F.when(asked != "auto", "explicit_mode").otherwise(F.concat(F.lit("auto."), mapped(REASONS, auto)))
    return rows.withColumns({"mode": mode, "template": F.coalesce(mapped(TEMPLATES, mode), mode), "reason_code": reason, "route_confidence": sure})


def estimate(documents: DataFrame) -> DataFrame:
    """Each document (with estimated_points) at each level: level, card_min, card_max, call_min, call_max, confirm."""
    levels = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(x, ("level", "low", "high", "call_min", "call_max"), strict=True))) for x in LEVELS))
    rows = documents.withColumn("_l", F.explode(levels))
    n = F.col("estimated_points")
    low = F.when(n > 0, F.greatest(F.lit(1), F.ceil(n * F.col("_l.low")))).otherwise(0).cast("long")
    high = F.when(n > 0, F.greatest(F.least(F.lit(MOST_POINTS), F.ceil(n * F.col("_l.high"))), low)).otherwise(0).cast("long")
    return rows.select("*", "_l.level", low.alias("card_min"), high.alias("card_max"), "_l.call_min", "_l.call_max", (F.col("_l.level") != "fast").alias("confirm")).drop("_l")
