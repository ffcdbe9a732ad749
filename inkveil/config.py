"""Plan-time configuration: which rules run, in which tie order, which keywords."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from inkveil.constants import (
    CATEGORIES,
    CONFIDENTIAL_KEYWORDS,
    DEFAULT_RULES,
    RULE_ORDER,
)


@dataclass(frozen=True)
class RuleSet:
    """Chosen rules, listed in tie order.  Only these get into a plan."""

    rules: tuple[str, ...] = DEFAULT_RULES
    keywords: tuple[str, ...] = CONFIDENTIAL_KEYWORDS

    def __bool__(self) -> bool:
        return bool(self.rules)


def parse_keywords(raw: str | None) -> tuple[str, ...]:
    """Comma list -> trimmed, non-blank phrases."""
    return tuple(k.strip() for k in (raw or "").split(",") if k.strip())


def rule_set(
    rules: Iterable[str] = DEFAULT_RULES,
    keywords: Iterable[str] | str | None = None,
    keyword_mode: str = "replace",
    order: Iterable[str] = RULE_ORDER,
) -> RuleSet:
    """Build a RuleSet.

    ``keywords`` takes the place of the default phrases (``keyword_mode="replace"``)
    or joins them (``"extend"``).  ``order`` settles ties between rules that match
    exactly the same characters, e.g. put ``credit_card`` before ``phone``.
    """
    chosen = set(rules)
    unknown = chosen - set(RULE_ORDER)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    if keyword_mode not in ("replace", "extend"):
        raise ValueError("keyword_mode is 'replace' or 'extend'")
    order = tuple(order)
    ranked = order + tuple(r for r in RULE_ORDER if r not in order)
    own = parse_keywords(keywords) if isinstance(keywords, str) else tuple(keywords or ())
    if not own:
        words = CONFIDENTIAL_KEYWORDS
    elif keyword_mode == "extend":
        words = CONFIDENTIAL_KEYWORDS + tuple(k for k in own if k not in CONFIDENTIAL_KEYWORDS)
    else:
        words = own
    return RuleSet(tuple(r for r in ranked if r in chosen), words)


ALL_RULES = rule_set(RULE_ORDER)


def rules_from_switches(switches: Mapping[str, object] | None, **kwargs) -> RuleSet:
    """``{"redact_email": True, …}`` -> RuleSet; nothing switched on -> empty set."""
    switches = switches or {}
    chosen = [r for r in RULE_ORDER if switches.get(f"redact_{r}")]
    return rule_set(chosen, keywords=switches.get("redact_custom_keywords") or None, **kwargs)


@dataclass(frozen=True)
class AnonymiseConfig:
    """One job: what to redact, what to strip, whether to encrypt."""

    rules: RuleSet = field(default_factory=RuleSet)
    categories: tuple[str, ...] = CATEGORIES
    encrypt: bool = False
    legacy_gate: bool = False
    join_units: bool = False    # packages: find matches across text runs
