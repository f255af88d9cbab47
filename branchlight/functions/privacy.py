"""Detection and masking of personal data in text, as column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern name, expression, data class, privacy level. Matching ignores case.
PATTERNS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "pii", "confidential"),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b", "pii", "confidential"),
    ("ssn", r"\b\d{3}-?\d{2}-?\d{4}\b", "pii", "restricted"),
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
     "financial", "restricted"),
    ("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "operational", "internal"),
    ("api_key", r"\b[A-Za-z0-9]{32,}\b", "business", "restricted"),
    ("bank_account", r"\b\d{8,17}\b", "financial", "restricted"),
    ("passport", r"\b[A-Z]{1,2}[0-9]{6,9}\b", "pii", "restricted"),
]
LEVELS = ["public", "internal", "confidential", "restricted"]
CLASS_PII, CLASS_BUSINESS, CLASS_OPERATIONAL, CLASS_PUBLIC = (
    "personally_identifiable_information", "business_sensitive", "operational_data", "public_information")

# Masks for prompts, applied in this order.
MASKS = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"),
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CARD]"),
    (r"\b[A-Za-z0-9]{32,}\b", "[API_KEY]"),
]
# Name parts that mark a column as sensitive.
SENSITIVE_NAME_PARTS = ["email", "phone", "mobile", "fax", "address", "customer", "supplier", "contact", "person",
                        "user", "employee", "staff", "client", "vendor", "ssn", "tax", "credit", "card", "password",
                        "secret", "token", "key", "name"]
REDACTED = "[REDACTED]"
LOOSE_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def any_case(pattern: str) -> str:
    # U: letters of every script count as word characters, as the word boundaries intend.
    return "(?iU)" + pattern


# What a text must hold at the least for a pattern to be worth trying: an at sign, a digit, or nothing.
DIGIT_PATTERNS = {"phone", "ssn", "credit_card", "ip_address", "bank_account", "passport"}


def worth_trying(kind: str, text: Column) -> Column:
    """A cheap test that no match can fail, so most texts skip most of the expensive patterns."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind in DIGIT_PATTERNS:
        return text.rlike(r"(?U)\d")
    return F.length(text) >= 32


def pattern_counts(text: Column) -> dict[str, Column]:
    return {name: F.when(worth_trying(name, text), F.regexp_count(text, F.lit(any_case(p)))).otherwise(0)
            for name, p, _, _ in PATTERNS}


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in LEVELS]), rank + 1)


def sensitivity(counts: dict[str, Column]) -> dict[str, Column]:
    """Class, level, number of patterns found and anonymise flag. Financial finds count as personal data."""
    found = {name: counts[name] > 0 for name, _, _, _ in PATTERNS}
    of = {kind: [found[n] for n, _, k, _ in PATTERNS if k == kind]
          for kind in ("pii", "financial", "business", "operational")}

    def any_of(*kinds: str) -> Column:
        out = F.lit(False)
        for kind in kinds:
            for c in of[kind]:
                out = out | c
        return out

    rank = F.greatest(*[F.when(found[n], LEVELS.index(lv)).otherwise(0) for n, _, _, lv in PATTERNS])
    number = sum((f.cast("int") for f in found.values()), F.lit(0))
    return {"classification": F.when(any_of("pii", "financial"), CLASS_PII).when(any_of("business"), CLASS_BUSINESS)
            .when(any_of("operational"), CLASS_OPERATIONAL).otherwise(CLASS_PUBLIC),
            "privacy_level": level_name(rank), "detected_patterns": number, "requires_anonymization": number > 0}


def masked(text: Column) -> Column:
    for pattern, tag in MASKS:
        text = F.regexp_replace(text, "(?U)" + pattern, F.lit(tag.replace("$", "\\$")))
    return text


def digest_number(value: Column) -> Column:
    """A stable whole number from the text: the first eight hex digits of its MD5."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def pseudonym(kind: str, value: Column) -> Column:
    """Same value, same pseudonym; the shape of the original is kept where it has one."""
    n = digest_number(value)
    if kind == "email":
        return F.concat(F.lit("user"), (n % 1000).cast("string"), F.lit("@"), F.split_part(value, F.lit("@"), F.lit(2)))
    if kind == "phone":
        return F.concat(F.lit("555-"), _padded(n % 900 + 100, 3), F.lit("-"), _padded(n % 9000 + 1000, 4))
    if kind == "credit_card":
        return F.concat(F.lit("****-****-****-"), F.right(value, F.lit(4)))
    if kind == "ssn":
        return F.concat(F.lit("***-**-"), F.right(value, F.lit(4)))
    if kind == "ip_address":
        part = (n % 256).cast("string")
        return F.concat(F.lit("192.168."), part, F.lit("."), part)
    return F.concat(F.lit("ANON_"), _padded(n % 10000, 4))


def matches(kind: str, pattern: str, text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(any_case(pattern)), 0))
    return F.when(worth_trying(kind, text), found).otherwise(F.array().cast("array<string>"))


def replaced(kind: str, found: Column, text: Column) -> Column:
    """Every find (the whole match, not its groups) swapped for its pseudonym wherever it stands."""
    return F.aggregate(found, text, lambda acc, m: F.replace(acc, m, pseudonym(kind, m)))


def name_is_sensitive(column: str) -> bool:
    return any(part in column.lower() for part in SENSITIVE_NAME_PARTS)


def looks_personal(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return value.rlike(LOOSE_EMAIL) | (digits >= 9)
