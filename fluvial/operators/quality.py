"""Quality of cards: ordered rules with a score and a status, and the structural gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.text import cjk_pairs, clean, collapsed

# Patterns, limits and weights of the rules.
GENERIC_FRONT = (
    r"(?:请|试着)?解释(?:以下|这个|上述)?内容",
    r"根据(?:这份|上述|以下)?材料(?:可知|回答)?",
    r"\b(?:explain|describe) (?:this|the following|the material)\b",
    r"\bwhat (?:is|does) (?:this|the material)\b",
)
BOILERPLATE = (
    r"根据(?:这份|上述|以下)?材料(?:可知|回答)?",
    r"\baccording to (?:the|this) material\b",
    r"\bthe material (?:says|states|shows)\b",
)
MARKDOWN = r"```|(?:^|\n)\s{0,3}#{1,6}\s|!??\[[^\]]*\]\([^)]*\)|\*\*[^*]+\*\*|__[^_]+__"
BULLET = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)"
PROMPT_ARTIFACT = r"(?:return\s+(?:only\s+)?json|quality\s+rules?|card\s+mode\s*:|template\s+instructions?|system\s+prompt|as\s+an?\s+ai|输出\s*json|提示词|模板说明)"
INTRO = r"^(?:答案是|正确答案是|回答是|根据材料(?:可知)?|the answer is|this answer is|according to the material)\s*[:：,，]?"
CLOZE = r"\{\{c[1-9]\d*::[^{}\n]+?(?:::[^{}\n]+?)?\}\}"
QUESTION_START = r"^(?:what|why|how|when|where|which|who|name|state|compare|under what)\b"
QUESTION_WORDS = "什么 为何 为什么 如何 哪个 哪些 是否 有什么 区别 作用 公式 步骤 常见误区 含义 定义".split()
SEVERAL_POINTS = r"(?:以及|并说明|分别|同时|\band\b.+\band\b)"
PUNCTUATION = r"[\s?？!！。，,.、:：;；]"
TWO_SIDES = r"(?:\bvs\.?\b|\bversus\b|difference between|compare.+(?:and|with)|.+(?:与|和).+(?:区别|异同|相比|不同))"
IN_ORDER = r"(?:首先|其次|然后|接着|最后|第一|第二|第三|\bfirst\b|\bthen\b|\bnext\b|\bfinally\b|(?:^|\n)\s*\d+[.)])"
CONDITION = r"(?:条件|适用|当.+时|在.+情况下|\bwhen\b|\bif\b|\bwhere\b|\bprovided\b|\bappl(?:y|ies)\b)"
NO_TERM = r"^(?:(?:它|这|这个|上述内容)(?:是)?什么|what(?:is)?it)$"
VAGUE_EXAM = r"(?:讨论|分析|简述|解释)(?:上述|相关|这个|以下)?内容|\b(?:discuss|describe|explain) (?:this|the above|the material)\b"
VERBOSE = {"quick_review": 90, "definition": 220, "exam": 280, "compare_contrast": 320, "process_steps": 360, "formula_rule": 260, "mistake_trap": 240, "concept": 260, "cloze_candidate": 160}
BLOCKING = ("empty_front", "empty_back", "unsupported_cloze", "cloze_syntax_invalid")
#: Hundredths that a rule takes off, 12 where nothing is said.
COSTS = dict.fromkeys(BLOCKING, 55) | dict.fromkeys(("front_not_question_like", "source_not_grounded_simple", "back_contains_unnecessary_intro", "too_many_cards_from_short_source"), 8) | {"too_many_bullets": 10}
DEFAULT_COST = 12


def _has(text: Column, *patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= text.rlike("(?iU)" + p)
    return out


def _core(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\x{3400}-\x{9fff}]", "")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{3,}"), F.lit(0))


def rules(front: Column, back: Column, source: Column, mode: Column, short_answers: bool = False, cloze_supported: bool = False) -> dict[str, Column]:
    """Each rule's condition, in the order in which hits are told."""
    front, back, source = clean(front), clean(back), clean(source)
    both = F.concat(front, F.lit("\n"), back)
    core = F.regexp_replace(front, "(?U)" + PUNCTUATION, "")
    most = F.when(mode == "quick_review", 140).otherwise(240 if short_answers else 500)
    bullets = F.size(F.filter(F.split(back, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: x.rlike("(?U)" + BULLET)))
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in VERBOSE.items() for x in kv)), mode), F.lit(260))
    question = F.locate("?", front).__gt__(0) | (F.locate("？", front) > 0) | _has(front, QUESTION_START)
    for w in QUESTION_WORDS:
        question |= front.contains(w)
    cloze, cloze_mode = F.lower(both).contains("{{c"), mode == "cloze_candidate"
    rest = F.regexp_replace(front, CLOZE, "")
    valid = front.rlike(CLOZE) & ~F.lower(rest).contains("{{c") & ~rest.contains("}}")
    grounded = F.arrays_overlap(_words(back), _words(source)) | F.arrays_overlap(cjk_pairs(back), cjk_pairs(source))
    there = (front != "") & (back != "")
    term = F.regexp_replace(F.lower(front), "(?U)" + PUNCTUATION, "")
    return {
        "empty_front": front == "",
        "empty_back": back == "",
        "short_front": (front != "") & (F.length(core) < 4),
        "generic_front": _has(front, *GENERIC_FRONT),
        "long_back": F.length(back) > most,
        "multiple_questions": F.length(front) - F.length(F.translate(front, "?？", "")) > 1,
        "multi_point_card": (bullets >= 3) | _has(front, SEVERAL_POINTS),
        "too_many_bullets": bullets >= 4,
        "boilerplate_phrase": _has(both, *BOILERPLATE),
        "markdown_residue": both.rlike("(?U)" + MARKDOWN),
        "answer_too_verbose_for_mode": F.length(back) > limit,
        "front_not_question_like": (front != "") & ~mode.isin("definition", "cloze_candidate") & ~question,
        "unsupported_cloze": (cloze | cloze_mode) & F.lit(not cloze_supported),
        "cloze_syntax_invalid": F.lit(cloze_supported) & cloze_mode & ~valid,
        "source_not_grounded_simple": (source != "") & there & ~grounded,
        "answer_contains_prompt_artifact": _has(back, PROMPT_ARTIFACT),
        "front_contains_answer_leak": (F.length(_core(back)) >= 4) & _core(front).contains(_core(back)),
        "back_contains_unnecessary_intro": _has(back, INTRO),
        "compare_card_missing_two_sides": (mode == "compare_contrast") & ~_has(front, TWO_SIDES),
        "process_card_missing_order": (mode == "process_steps") & (F.regexp_count(back, F.lit("(?iU)" + IN_ORDER)) < 2),
        "formula_card_missing_condition": (mode == "formula_rule") & ~_has(both, CONDITION),
        "definition_card_missing_term": (mode == "definition") & ((F.length(term) < 4) | term.rlike(NO_TERM)),
        "exam_card_too_vague": (mode == "exam") & _has(front, VAGUE_EXAM),
        "quick_review_too_long": (mode == "quick_review") & ((F.length(front) > 80) | (F.length(back) > 80)),
    }


def _rated(cards: DataFrame) -> DataFrame:
    """Add score and status from rule_ids."""
    costs = F.create_map(*(F.lit(x) for kv in COSTS.items() for x in kv))
    total = F.aggregate("rule_ids", F.lit(0), lambda acc, r: acc + F.coalesce(F.element_at(costs, r), F.lit(DEFAULT_COST)))
    blocked = F.arrays_overlap("rule_ids", F.array(*map(F.lit, BLOCKING)))
    status = F.when(blocked, "blocked").when(F.size("rule_ids") > 0, "review").otherwise("ready")
    return cards.withColumn("score", F.greatest(F.lit(0), 100 - total) / 100).withColumn("status", status)


def evaluate(cards: DataFrame, source: Column, mode: Column, **settings: bool) -> DataFrame:
    """Add rule_ids (in rule order), score and status to cards with front and back. One pass, no shuffle."""
    hits = [F.when(hit, F.lit(rule)) for rule, hit in rules(F.col("front"), F.col("back"), source, mode, **settings).items()]
    return _rated(cards.withColumn("rule_ids", F.array_compact(F.array(*hits))))


def add_issue(rated: DataFrame, rule: str, hit: Column) -> DataFrame:
    """Add a rule where `hit` holds and rate anew; one that is already there changes nothing."""
    more = F.when(hit & ~F.array_contains("rule_ids", rule), F.array_append("rule_ids", F.lit(rule))).otherwise(F.col("rule_ids"))
    return _rated(rated.withColumn("rule_ids", more))


def structural_gate(cards: DataFrame) -> DataFrame:
    """Add codes (in order) and passed (no error among them) to cards with card_type, front, back, source."""
    front, back, source = (clean(F.col(c)) for c in ("front", "back", "source"))
    checks = {
        "unsupported_card_type": ~F.col("card_type").eqNullSafe("basic"),
        "empty_front": front == "",
        "empty_back": back == "",
        "front_back_same": front == back,
        "front_too_long": F.length(front) > 200,
        "back_too_short": F.length(back) < 8,
        "missing_source": source == "",
    }
    errors = F.array(*map(F.lit, ("unsupported_card_type", "empty_front", "empty_back")))
    out = cards.withColumn("codes", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items()))))
    return out.withColumn("passed", ~F.arrays_overlap("codes", errors))


def evaluate_batch(cards: DataFrame, batch: str, source: Column, mode: Column, limit: Column, duplicates: DataFrame | None = None, **settings: bool) -> DataFrame:
    """`evaluate` with the rules of a whole batch: duplicate_candidate and too_many_cards_from_short_source.

    duplicates: card_id of cards that repeat another; without it, all but the first card of a batch with a folded front
    and back. A source of 1 to 120 characters has too many cards beyond `limit`, and 3 at least.
    """
    rated = evaluate(cards, source, mode, **settings)
    if duplicates is None:
        key = F.struct(F.col(batch), F.lower(collapsed(F.col("front"))).alias("f"), F.lower(collapsed(F.col("back"))).alias("b"))
        first = rated.groupBy(key.alias("_key")).agg(F.min("card_id").alias("_first"))
        rated = rated.withColumn("_key", key).join(first, "_key").withColumn("_again", (F.col("card_id") > F.col("_first")) & ((F.col("_key.f") != "") | (F.col("_key.b") != ""))).drop("_key", "_first")
    else:
        rated = rated.join(duplicates.select("card_id", F.lit(True).alias("_again")).distinct(), "card_id", "left").withColumn("_again", F.coalesce("_again", F.lit(False)))
    rated = add_issue(rated, "duplicate_candidate", F.col("_again")).drop("_again")
    sizes = cards.groupBy(batch).agg(F.count("*").alias("_cards"))
    rated = rated.join(sizes, batch)
    short = F.length(clean(source)).between(1, 120) & (F.col("_cards") > F.greatest(F.lit(3), limit))
    return add_issue(rated, "too_many_cards_from_short_source", F.coalesce(short, F.lit(False))).drop("_cards")


# The buckets of a summary, those without cards too.
BUCKETS = {"score": ("high", "medium", "low"), "status": ("ready", "review", "blocked"), "duplicate": ("exact", "canonical", "similar")}


def distributions(rated: DataFrame) -> DataFrame:
    """(what, name, n): cards by score (high from 0.85, medium from 0.5), status and duplicate_kind, all buckets; and by rule that was hit."""
    score = F.when(F.col("score") >= 0.85, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    pair = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    own = F.array(pair("score", score), pair("status", F.col("status")), pair("duplicate", F.col("duplicate_kind")))
    told = rated.select(F.explode(F.concat(own, F.transform("rule_ids", lambda r: pair("rule", r)))).alias("x")).select("x.*").filter("name is not null")
    empty = rated.sparkSession.createDataFrame([(w, n) for w, names in BUCKETS.items() for n in names], "what string, name string")
    counts = told.withColumn("one", F.lit(1)).unionByName(empty.withColumn("one", F.lit(0)))
    return counts.groupBy("what", "name").agg(F.sum("one").alias("n"))


def compare_outcomes(actual: DataFrame, expected: DataFrame, key: str = "card_id") -> DataFrame:
    """key, matches: whether status, rule_ids in order and duplicate_kind are those expected; a card that is on one side alone doesn't match."""
    told = lambda df: df.select(key, F.struct("status", "rule_ids", "duplicate_kind").alias("o"))
    both = told(actual).withColumnRenamed("o", "a").join(told(expected), key, "full")
    return both.select(key, (F.col("a").isNotNull() & F.col("a").eqNullSafe(F.col("o"))).alias("matches"))
