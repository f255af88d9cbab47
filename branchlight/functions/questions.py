"""Reading typed questions: intent, parameters, cost and cacheability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases per intent, in order of precedence.
INTENTS = {
    "stock_levels": [r"how much.*stock", r"stock level.*", r"inventory.*level", r"how many.*items",
                     r"quantity.*available"],
    "item_locations": [r"where.*located", r"location.*item", r"which branch.*", r"find.*item", r"where can i find"],
    "sales_trends": [r"sales.*trend", r"selling.*well", r"best.*seller", r"top.*product", r"revenue.*analysis"],
    "forecasts": [r"forecast.*", r"predict.*sales", r"future.*demand", r"expected.*sales", r"projection.*"],
    "alerts": [r"low.*stock", r"out.*stock", r"critical.*item", r"alert.*", r"warning.*"],
}
GENERAL = "general"
# Parameter expressions and time words.
ITEM = "(?:item|product|منتج)\\s+([a-zA-Z0-9؀-ۿ\\s]+)"
BRANCH = "(?:branch|فرع)\\s+([a-zA-Z0-9؀-ۿ\\s]+)"
NUMBER = r"\b\d+\b"
RECENT_WORDS = ["today", "اليوم", "this week", "هذا الأسبوع"]
EXTENDED_WORDS = ["month", "شهر", "year", "سنة"]
# Words that make a prompt too personal or too current to cache, and prices per token.
DYNAMIC_WORDS = ["today", "now", "current", "latest", "real-time", "live", "recent", "update", "yesterday", "tomorrow",
                 "my ", "your ", "user", "specific", "custom"]
SHORT_PROMPT, REASON_SHORT, REASON_FINE = 10, "Prompt too short (< 10 chars)", "Suitable for caching"
INPUT_PRICE, OUTPUT_PRICE, RESPONSE_LENGTH = 0.000075, 0.0003, 500


def normalized(query: Column) -> Column:
    return F.trim(F.lower(query))


def intent(query: Column) -> Column:
    """Struct (score, intent): the best-scoring phrase, the earlier one on equal scores.

    A long match near the start of the question scores high."""
    q, cells, order = normalized(query), [], 0
    size = F.length(q)
    for name, phrases in INTENTS.items():
        for phrase in phrases:
            hit = F.regexp_extract(q, phrase, 0)
            at = F.regexp_instr(q, F.lit(phrase)) - 1
            score = (F.length(hit) / size * 0.7 + (F.lit(1.0) - at / size) * 0.3) * 100
            cells.append(F.when(q.rlike(phrase), F.struct(
                score.alias("score"), F.lit(-order).alias("rank"), F.lit(name).alias("intent"))))
            order += 1
    return F.array_max(F.filter(F.array(*cells), lambda c: c.isNotNull()))


def parameters(query: Column) -> dict[str, Column]:
    q = normalized(query)

    def named(pattern: str) -> Column:
        return F.when(q.rlike(pattern), F.trim(F.regexp_extract(q, pattern, 1)))

    def has(words: list[str]) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | F.contains(q, F.lit(word))
        return out

    return {"item_name": named(ITEM), "branch_name": named(BRANCH),
            "numbers": F.transform(F.regexp_extract_all(q, F.lit(NUMBER), 0), lambda n: n.try_cast("bigint")),
            "time_period": F.when(has(RECENT_WORDS), "recent").when(has(EXTENDED_WORDS), "extended")}


def prompt_cost(prompt: Column) -> Column:
    return F.length(prompt) / 4 * INPUT_PRICE + F.lit(RESPONSE_LENGTH / 4 * OUTPUT_PRICE)


def cache_reason(prompt: Column) -> Column:
    """Why a prompt should not be cached (the first word found counts), or that it may be."""
    low, out = F.lower(prompt), None
    for word in DYNAMIC_WORDS:
        text = f"Contains dynamic keyword: '{word}'"
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.when(F.length(F.trim(prompt)) < SHORT_PROMPT, REASON_SHORT).otherwise(REASON_FINE)
