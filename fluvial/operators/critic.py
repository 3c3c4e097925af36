"""What becomes of a card: pass, flag, repair or reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.text import cjk_pairs
from fluvial.operators.quality import BLOCKING

# Words that ground nothing; shares of words and of CJK pairs that must be in the source; the verdicts.
STOPWORDS = "and are but for from has have into not that the this was what when where which with".split()
WORD_SHARE, PAIR_SHARE = 0.6, 0.5
ACTIONS = ("pass", "flag", "repair", "reject")
REASON = r"^[a-z][a-z0-9_]{0,119}$"
MOST_REASONS = 32


def grounded(text: Column, source: Column) -> Column:
    """Whether enough of the text's words are in the source; of a text without words, enough of its CJK pairs."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9_]{3,}"), F.lit(0)))
    own, pairs = F.array_except(words(text), F.array(*map(F.lit, STOPWORDS))), cjk_pairs(text)
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(F.size(own) > 0, share(own, words(source)) >= WORD_SHARE).when(F.size(pairs) > 0, share(pairs, cjk_pairs(source)) >= PAIR_SHARE).otherwise(False)


def decide(rated: DataFrame, source: Column, verdict: Column, reasons: Column, repaired: Column) -> DataFrame:
    """Add action, reason_codes and local_blocking to rated cards (rule_ids, front, back).

    What blocks locally or isn't grounded is repaired once and then rejected. Otherwise the model's verdict holds: none
    is a pass, an unknown one a flag, a second repair a reject. Reasons that aren't plain codes are left out.
    """
    blocking = F.filter("rule_ids", lambda r: r.isin(*BLOCKING))
    back, source, repaired = F.coalesce("back", F.lit("")), F.coalesce(source, F.lit("")), F.coalesce(repaired, F.lit(False))
    loose = F.array_contains("rule_ids", "source_not_grounded_simple") | ((back != "") & (source != "") & ~grounded(back, source))
    local = F.concat(blocking, F.when(loose, F.array(F.lit("source_not_grounded"))).otherwise(F.array().cast("array<string>")))
    given = F.coalesce(reasons, F.array().cast("array<string>"))
    safe = F.when(F.size(given) > MOST_REASONS, F.array(F.lit("critic_reason_limit"))).otherwise(F.array_distinct(F.filter(given, lambda r: r.rlike(REASON))))
    nothing = F.array().cast("array<string>")
    stops, known, again = F.size("_local") > 0, verdict.isin(*ACTIONS), repaired & (verdict == "repair")
    return rated.withColumn("_local", local).withColumns({
        "action": F.when(stops, F.when(repaired, "reject").otherwise("repair")).when(verdict.isNull(), "pass").when(~known, "flag").when(again, "reject").otherwise(verdict),
        "reason_codes": F.when(stops, F.when(repaired, F.array_append("_local", F.lit("repair_failed_local_validation"))).otherwise(F.col("_local")))
        .when(verdict.isNull(), nothing).when(~known, F.array(F.lit("critic_output_invalid"))).when(again, F.array_append(safe, F.lit("repair_limit_reached"))).otherwise(safe),
        "local_blocking": stops,
    }).drop("_local")


def as_gate(rated: DataFrame) -> DataFrame:
    """Add issues: each rule with the structural gate's severity."""
    return rated.withColumn("issues", F.transform("rule_ids", lambda r: F.struct(r.alias("code"), F.when(r.isin(*BLOCKING), "error").otherwise("warning").alias("severity"))))
