"""Span algebra: match offsets, union of rules, overlap resolution, rewriting.

A span is ``struct<s:int, e:int, prio:int, rule:string>`` with code-point offsets,
end exclusive.  Running totals over an array are folded in blocks: appending to one
growing array copies it every time, which is quadratic for a text with very many
matches; block by block the copying stays near-linear, so whole long texts are fine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.config import RuleSet
from inkveil.functions import detect
from inkveil.functions.detect import let

SPAN_TYPE = "struct<s:int,e:int,prio:int,rule:string>"
BLOCK = 256

def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN_TYPE}>")


def _no_steps() -> Column:
    return F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")


def _no_entries() -> Column:
    return F.array().cast(
        "array<struct<prio:int,rule:string,steps:array<struct<gap:int,len:int,ok:boolean>>>>"
    )


def _state(at: Column, out: Column) -> Column:
    return F.struct(at.alias("at"), out.alias("out"))


def _fold(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold ``items`` into spans with a running position, block by block.

    ``step(state, item) -> state`` over ``state = struct<at:int, out:array<span>>``.
    """

    def block(acc: Column, b: Column) -> Column:
        part = F.aggregate(
            F.slice(items, b * BLOCK + 1, F.lit(BLOCK)),
            _state(acc["at"], no_spans()),
            step,
        )
        return let(part, lambda p: _state(p["at"], F.concat(acc["out"], p["out"])))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    return F.when(F.size(items) == 0, no_spans()).otherwise(
        F.aggregate(blocks, _state(F.lit(0), no_spans()), block)["out"]
    )


def _push(state: Column, span: Column) -> Column:
    return F.concat(state["out"], F.array(span))


def _located(prio: int, rule: str, steps: Column) -> Column:
    """Candidates of one pattern as distances: the gap before each, its length, its verdict."""
    return F.struct(
        F.lit(prio).alias("prio"), F.lit(rule).alias("rule"), steps.alias("steps")
    )


def pattern_steps(
    text: Column, pattern: str, check: Callable[[Column], Column] | None = None,
) -> Column:
    """Distances of all matches of one pattern that cannot match the empty string.

    The pieces between matches (``split``) and the matches themselves alternate, so
    their lengths add up to offsets.  Rows without a match never reach the split.
    """

    def measure(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return F.zip_with(gaps, found, lambda g, m: F.struct(
            F.length(g).alias("gap"), F.length(m).alias("len"),
            (check(m) if check else F.lit(True)).alias("ok"),
        ))

    def usable(found: Column) -> Column:
        return F.exists(found, check) if check else F.size(found) > 0

    return let(
        detect.pattern_matches(text, pattern),
        lambda found: F.when(usable(found), measure(found)).otherwise(_no_steps()),
    )


def sentence_steps(text: Column, words: str) -> Column:
    """Distances of sentences; they touch, so there are no gaps."""
    return F.when(
        text.rlike(words),
        F.transform(detect.sentences(text), lambda x: F.struct(
            F.lit(0).alias("gap"), F.length(x).alias("len"), x.rlike(words).alias("ok"),
        )),
    ).otherwise(_no_steps())


def all_spans(text: Column, rules: RuleSet) -> Column:
    """Union of the chosen rules' spans, each left to right; overlaps are still in.

    Patterns that need a digit share one look for it.
    """
    entries, numeric = [], []
    for prio, rule in enumerate(rules.rules):
        if rule == "confidential":
            words = detect.keyword_pattern(rules.keywords)
            entries.append(_located(prio, rule, sentence_steps(text, words)))
            continue
        for p in detect.PATTERNS[rule]:
            group = numeric if p in detect.NUMERIC_PATTERNS else entries
            group.append(_located(prio, rule, pattern_steps(text, p, detect.CHECKS.get(rule))))
    located = F.array(*entries) if entries else _no_entries()
    if numeric:
        located = F.concat(located, F.when(
            detect.has_digit(text), F.array(*numeric)
        ).otherwise(_no_entries()))

    def spans(entry: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["len"]
            span = F.struct(
                start.alias("s"), end.alias("e"),
                entry["prio"].alias("prio"), entry["rule"].alias("rule"),
            )
            return _state(end, F.when(x["ok"], _push(acc, span)).otherwise(acc["out"]))

        return _fold(entry["steps"], step)

    return F.flatten(F.transform(
        F.filter(located, lambda e: F.size(e["steps"]) > 0), spans
    ))


def resolve(spans: Column) -> Column:
    """Earliest start first, then longest, then rule order; drop what overlaps a kept one."""
    keyed = F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("back"), x["prio"].alias("prio"),
        x["rule"].alias("rule"),
    ))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(
            x["s"].alias("s"), (-x["back"]).alias("e"), x["prio"].alias("prio"),
            x["rule"].alias("rule"),
        )
        return F.when(
            x["s"] >= acc["at"], _state(-x["back"], _push(acc, span))
        ).otherwise(acc)

    return F.when(F.size(spans) <= 1, spans).otherwise(
        let(F.sort_array(keyed), lambda ks: _fold(ks, step))
    )


def find_spans(text: Column, rules: RuleSet) -> Column:
    """Kept spans of a text; null text -> empty."""
    return let(all_spans(text, rules), resolve)


def redact_spans(text: Column, spans: Column) -> Column:
    """Put the label in place of each kept span.

    ``substring`` walks the text from its start, so many spans are handled block by
    block on the stretch of text that the block covers.
    """

    def label(span: Column) -> Column:
        # a span without a rule is the rest of one that began in an earlier unit
        return F.when(span["rule"].isNull(), F.lit("")).otherwise(F.lit(C.REDACTED_LABEL))

    def pieces(chunk: Column, base: Column, part: Column) -> Column:
        begin = lambda i: F.when(i == 0, base).otherwise(F.get(part, i - 1)["e"])
        return F.array_join(F.transform(part, lambda x, i: F.concat(
            F.substring(chunk, begin(i) - base + 1, x["s"] - begin(i)), label(x)
        )), "")

    def block(b: Column) -> Column:
        part = F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))
        base = F.when(b == 0, F.lit(0)).otherwise(F.get(spans, b * BLOCK - 1)["e"])
        return let(F.struct(part.alias("part"), base.alias("base")), lambda v: let(
            F.substring(
                text, v["base"] + 1,
                F.try_element_at(v["part"], F.lit(-1))["e"] - v["base"],
            ),
            lambda chunk: pieces(chunk, v["base"], v["part"]),
        ))

    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
    tail = F.substring(text, F.try_element_at(spans, F.lit(-1))["e"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(F.array_join(F.transform(blocks, block), ""), tail)
    )


def count_spans(spans: Column, rules: RuleSet) -> Column:
    """``map<rule, n>`` of the kept spans; rules without a span are left out."""
    if not rules:
        return F.create_map().cast("map<string,bigint>")
    names = F.array(*[F.lit(r) for r in rules.rules])
    counts = F.transform(names, lambda r: F.size(
        F.filter(spans, lambda x: x["rule"] == r)).cast("bigint"))
    return F.when(F.size(spans) == 0, F.create_map().cast("map<string,bigint>")).otherwise(
        F.map_filter(F.map_from_arrays(names, counts), lambda _, n: n > 0)
    )


def redact(text: Column, rules: RuleSet) -> Column:
    """Redacted text in one expression."""
    if not rules:
        return text
    return let(find_spans(text, rules), lambda sp: redact_spans(text, sp))


def rule_counts(text: Column, rules: RuleSet) -> Column:
    """Redaction counts in one expression."""
    return let(find_spans(text, rules), lambda sp: count_spans(sp, rules))


def joined_spans(texts: Column, rules: RuleSet) -> Column:
    """Kept spans of an array of units, found on the units put together.

    Gives one span array per unit.  A match that runs over several units appears in each
    of them; only its first piece carries the rule, the others have none.
    """
    sizes = F.transform(texts, lambda t: F.length(t))

    def place(acc: Column, size: Column) -> Column:
        end = acc["at"] + size
        unit = F.struct(acc["at"].alias("s"), end.alias("e"),
                        F.lit(0).alias("prio"), F.lit("unit").alias("rule"))
        return _state(end, _push(acc, unit))

    def cut(spans: Column, unit: Column) -> Column:
        inside = F.filter(spans, lambda x: (x["s"] < unit["e"]) & (x["e"] > unit["s"]))
        return F.transform(inside, lambda x: F.struct(
            (F.greatest(x["s"], unit["s"]) - unit["s"]).alias("s"),
            (F.least(x["e"], unit["e"]) - unit["s"]).alias("e"),
            x["prio"].alias("prio"),
            F.when(x["s"] >= unit["s"], x["rule"]).alias("rule"),
        ))

    return let(find_spans(F.array_join(texts, ""), rules), lambda spans: F.transform(
        _fold(sizes, place), lambda unit: cut(spans, unit)))
