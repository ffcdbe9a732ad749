"""Scalar detectors: per rule a boolean, a match array and helper checks.

Everything is a Column expression; no Python runs on the workers.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.config import RuleSet, rule_set

# Strictly-greater test on a sum of floats: sums that are exactly the limit in
# real arithmetic may come out one rounding step above it.
_FLOAT_SLACK = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


# ------------------------------------------------------------- numeric checks

@cache
def _decimal_digits() -> tuple[str, str]:
    """All non-ASCII decimal digits and, aligned, their ASCII values."""
    marks = [
        chr(c) for c in range(0x80, sys.maxunicode + 1)
        if unicodedata.category(chr(c)) == "Nd"
    ]
    return "".join(marks), "".join(str(unicodedata.decimal(m)) for m in marks)


def luhn_valid(value: Column) -> Column:
    """13 to 19 digits, anything else dropped, mod-10 check digit correct."""
    plain = F.when(
        value.rlike(r"[^\x00-\x7f]"),
        F.translate(value, *_decimal_digits()),
    ).otherwise(value)
    digits = F.regexp_replace(plain, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def shannon_entropy(value: Column) -> Column:
    """Bits per character of the trimmed string; blank -> 0."""
    text = F.regexp_replace(
        value, rf"^[{C.SPACE_CHARS}]+|[{C.SPACE_CHARS}]+$", ""
    )

    def bits(chars: Column) -> Column:
        # sorted, so equal characters lie side by side: one pass, whatever the alphabet
        n = F.size(chars)
        ends = F.filter(
            F.sequence(F.lit(1), n), lambda i: ~F.get(chars, i).eqNullSafe(F.get(chars, i - 1)))

        def add(acc: Column, end: Column) -> Column:
            part = let((end - acc["at"]) / n, lambda p: p * F.log2(p))
            return F.struct((acc["sum"] - part).alias("sum"), end.alias("at"))

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
        return F.aggregate(ends, start, add, lambda acc: acc["sum"])

    return F.when(value.isNull(), F.lit(None).cast("double")).otherwise(
        let(text, lambda t: F.when(F.length(t) == 0, F.lit(0.0)).otherwise(
            let(F.sort_array(F.split(t, "")), bits)))
    )


def is_high_entropy(token: Column) -> Column:
    """Entropy strictly above the limit; the two cheap conditions are implied by it."""
    return (
        (F.length(token) >= C.ENTROPY_MIN_CHARS)
        & (F.size(F.array_distinct(F.split(token, ""))) >= C.ENTROPY_MIN_CHARS)
        & (shannon_entropy(token) > C.ENTROPY_LIMIT + _FLOAT_SLACK)
    )


# -------------------------------------------------------------- keyword rule

def _quoted(word: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", word, flags=re.ASCII)


def keyword_pattern(keywords: Iterable[str]) -> str:
    """Whole-phrase, case-insensitive alternation; built once, on the driver.

    Phrases share their first letter, so most words are ruled out by one comparison per
    letter instead of one per phrase.
    """
    words = sorted(set(keywords))
    groups = []
    for first, same in groupby(words, key=lambda w: w[0]):
        groups.append(_quoted(first) + "(?:" + "|".join(_quoted(w[1:]) for w in same) + ")")
    wordish = lambda ch: ch.isalnum() or ch == "_"
    head = C.START if all(wordish(w[0]) for w in words) else C.EDGE
    tail = C.STOP if all(wordish(w[-1]) for w in words) else C.EDGE
    return f"(?iu){head}(?:{'|'.join(groups)}){tail}"


# -------------------------------------------------------------- rule registry

# rule -> its patterns.  `ip` has two written forms.
PATTERNS: dict[str, tuple[str, ...]] = {
    "email": (C.EMAIL_PATTERN,),
    "phone": (C.PHONE_PATTERN,),
    "nin": (C.NIN_PATTERN,),
    "credit_card": (C.CARD_PATTERN,),
    "ip": (C.IPV4_PATTERN, C.IPV6_PATTERN),
    "jwt": (C.JWT_PATTERN,),
    "api_key": (C.API_KEY_PATTERN,),
    "ref_code": (C.REF_CODE_PATTERN,),
    "currency": (C.CURRENCY_PATTERN,),
    # tokens too short for the limit are left out from the start: same matches
    "high_entropy": (C.LONG_TOKEN_PATTERN,),
}

# Substrings without which a pattern cannot match: a byte search rules most rows
# out before the regular expression starts.  Rare first letters search fastest.
HINTS: dict[str, tuple[str, ...]] = {
    C.EMAIL_PATTERN: ("@",),
    C.NIN_PATTERN: ("-",),
    C.IPV4_PATTERN: (".",),
    C.IPV6_PATTERN: (":",),
    C.JWT_PATTERN: ("yJ",),
    C.API_KEY_PATTERN: ("k-", "_", "AKI"),
}

# Candidates of these rules must also pass a check.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda found: found.contains("@"),
    "jwt": lambda found: found.contains("."),
    "credit_card": luhn_valid,
    "high_entropy": is_high_entropy,
}

# Patterns that cannot match without a decimal digit.
NUMERIC_PATTERNS = (
    C.PHONE_PATTERN, C.NIN_PATTERN, C.CARD_PATTERN, C.IPV4_PATTERN, C.REF_CODE_PATTERN,
)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def has_digit(text: Column) -> Column:
    return text.rlike(C.DIGIT)


def has_long_token(text: Column) -> Column:
    """Necessary for a token that passes the entropy limit (plain white space only)."""
    return text.rlike(r"(?<!\S)\S{17}")


def may_match(text: Column, pattern: str) -> Column:
    """Cheap necessary condition for ``pattern``."""
    if pattern == C.LONG_TOKEN_PATTERN:
        return has_long_token(text)
    hints = HINTS.get(pattern)
    if not hints:
        return text.isNotNull()
    cond = F.contains(text, F.lit(hints[0]))
    for h in hints[1:]:
        cond = cond | F.contains(text, F.lit(h))
    return cond


def pattern_matches(text: Column, pattern: str) -> Column:
    """All matches of one pattern, left to right; null text -> empty."""
    return F.when(
        may_match(text, pattern),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
    ).otherwise(no_strings())


def tokens(text: Column) -> Column:
    """White-space-free tokens that are long enough to be looked at."""
    return F.regexp_extract_all(text, F.lit(C.TOKEN_PATTERN), F.lit(0))


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(C.SENTENCE_PATTERN), F.lit(0))


def matches(text: Column, rule: str, rules: RuleSet | None = None) -> Column:
    """Matched strings of one rule, before any overlap is settled."""
    if rule == "confidential":
        words = keyword_pattern((rules or rule_set()).keywords)
        return F.when(
            text.rlike(words),
            F.filter(sentences(text), lambda s: s.rlike(words)),
        ).otherwise(no_strings())
    found = []
    for p in PATTERNS[rule]:
        one = pattern_matches(text, p)
        if p in NUMERIC_PATTERNS:
            one = F.when(has_digit(text), one).otherwise(no_strings())
        found.append(one)
    out = F.concat(*found) if len(found) > 1 else found[0]
    check = CHECKS.get(rule)
    return F.filter(out, check) if check else out


def has_rule(text: Column, rule: str, rules: RuleSet | None = None) -> Column:
    """Does the rule match anywhere?  Stops at the first hit where it can."""
    if rule == "confidential" or rule in CHECKS:
        hit = F.size(matches(text, rule, rules)) > 0
    else:
        hit = F.lit(False)
        for p in PATTERNS[rule]:
            one = may_match(text, p) & text.rlike(p)
            hit = hit | (has_digit(text) & one if p in NUMERIC_PATTERNS else one)
    return F.coalesce(hit, F.lit(False))


def has_any(text: Column, rules: RuleSet) -> Column:
    """Any chosen rule matches; used to drop clean rows before span work."""
    hit = F.lit(False)
    for r in rules.rules:
        hit = hit | has_rule(text, r, rules)
    return hit


def match_count(text: Column, rule: str, rules: RuleSet | None = None) -> Column:
    return F.size(matches(text, rule, rules)).cast("bigint")
