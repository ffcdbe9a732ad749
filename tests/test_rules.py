"""Every rule on its own sentences: matched strings, texts and counts."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkveil.config import ALL_RULES, parse_keywords, rule_set, rules_from_switches
from inkveil.constants import CONFIDENTIAL_KEYWORDS, DEFAULT_RULES, RULE_ORDER
from inkveil.functions import detect, spans as S
from inkveil.operators.redaction import with_redaction

GOLDEN = [
    # rule, text, matches
    ("email", "Write to ann.lee@mail.example.org today", ["ann.lee@mail.example.org"]),
    ("email", "a@b.co,c@d.co", ["a@b.co", "c@d.co"]),
    ("email", "no-at.example.org and a@b", []),
    ("email", "éva@b.com", []),
    ("email", "é.va@b.com", [".va@b.com"]),
    ("email", "ann@b.comé", []),
    ("phone", "Ring +44-712-345-678 now", ["44-712-345-678"]),
    ("phone", "Ring (555) 123-4567 now", ["555) 123-4567"]),
    ("phone", "code 12345678 or 1234567", ["12345678"]),
    ("phone", "run 1234567890123456 end", ["1234567890123456"]),
    ("phone", "run 12345678901234567 end", []),
    ("phone", "٠٧١٢٣٤٥٦٧٨", ["٠٧١٢٣٤٥٦٧٨"]),
    ("phone", "𝐀12345678", []),
    ("phone", "a 071 234 5678 b", ["071 234 5678"]),
    ("nin", "Id 47-120934-558201-63.", ["47-120934-558201-63"]),
    ("nin", "Id 47-120934-5582017-63.", ["47-120934-5582017-63"]),
    ("nin", "Id 47-120934-55820171-63.", []),
    ("credit_card", "Paid by 4111 1111 1111 1111 today", ["4111 1111 1111 1111"]),
    ("credit_card", "Paid by 4111-1111-1111-1112 today", []),
    ("credit_card", "4111 1111 1111 1111 22", ["4111 1111 1111 1111"]),
    ("credit_card", "41111111111111112 4111111111111111", ["4111111111111111"]),
    ("credit_card", "٤١١١١١١١١١١١١١١١", ["٤١١١١١١١١١١١١١١١"]),
    ("ip", "At 192.168.001.1 and 256.1.1.1", ["192.168.001.1"]),
    ("ip", "Host fe80::1, ::1 and 2001:db8::8a2e:370:7334", ["fe80::1", "::1", "2001:db8::8a2e:370:7334"]),
    ("ip", "1:2:3:4:5:6:7:8 fe80::a1%eth0", ["1:2:3:4:5:6:7:8", "fe80::a1%eth0"]),
    ("ip", "std::vector add::foo 12:30", []),
    ("ip", "::ffff:10.0.0.1", ["10.0.0.1", "::ffff"]),
    ("jwt", "t eyJhbGci.eyJzdWIi.sig-_x end", ["eyJhbGci.eyJzdWIi.sig-_x"]),
    ("jwt", "t eyJhbGci.eyJzdWIi end", []),
    ("api_key", "k sk-abc123def456 and AKIAABCDEFGH", ["sk-abc123def456", "AKIAABCDEFGH"]),
    ("api_key", "ask-abc123def456 sk-short", []),
    ("ref_code", "See MOX/BUD/2026/014 and AB-c1-2020-07", ["MOX/BUD/2026/014", "AB-c1-2020-07"]),
    ("ref_code", "See M/BUD/2026/014 and MOX/BUD/26/014", []),
    ("currency", "Pay USD 1,000.50 or KES5, not XUSD 4", ["USD 1,000.50", "KES5"]),
    ("currency", "Pay USD\u00a012.345", ["USD\u00a012"]),
    ("currency", "USDT 5, 5 USD.", []),
    ("high_entropy", "login Qw7!zX4@vB9#nM2$kJ5%hG8^", ["Qw7!zX4@vB9#nM2$kJ5%hG8^"]),
    ("high_entropy", "hex 0123456789abcdef0123456789abcdef", []),
    ("high_entropy", "abcdefghijklmnop", []),
    ("high_entropy", "abcdefghijklmnopq", ["abcdefghijklmnopq"]),
    ("high_entropy", "abcdefghi\u00a0jklmnopq", []),
    ("confidential", "One. This is Confidential! Tail secret", [" This is Confidential!"]),
    ("confidential", "My PIN is set.\nThe pine tree.", ["My PIN is set."]),
    ("confidential", "non-disclosure applies. ndas do not.", ["non-disclosure applies."]),
]


@pytest.fixture(scope="module")
def found(spark, texts):
    df = texts([t for _, t, _ in GOLDEN])
    cols = [detect.matches(F.col("text"), r).alias(r) for r in RULE_ORDER]
    return {row.id: row for row in df.select("id", *cols).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden_matches(found, i):
    rule, _, want = GOLDEN[i]
    assert sorted(found[i][rule]) == sorted(want)


def test_predicates_agree_with_matches(spark, texts):
    df = texts([t for _, t, _ in GOLDEN] + [None, ""])
    pairs = []
    for r in RULE_ORDER:
        pairs += [detect.has_rule(F.col("text"), r).alias("has_" + r),
                  (F.coalesce(F.size(detect.matches(F.col("text"), r)), F.lit(0)) > 0).alias("n_" + r)]
    any_rule = detect.has_any(F.col("text"), ALL_RULES).alias("any")
    for row in df.select(*pairs, any_rule).collect():
        for r in RULE_ORDER:
            assert row["has_" + r] == row["n_" + r], r
        assert row["any"] == any(row["n_" + r] for r in RULE_ORDER)


def test_entropy(spark, texts):
    rows = ["", "   ", "aaaaa", "abab", "  abcd ", None, "kT5!wZ8#rN3@yL6"]
    out = [r[0] for r in texts(rows).orderBy("id").select(detect.shannon_entropy(F.col("text"))).collect()]
    assert out[:5] == [0.0, 0.0, 0.0, 1.0, 2.0] and out[5] is None and 3.0 < out[6] < 4.0


def test_luhn(spark, texts):
    rows = ["4111111111111111", "5555 5555-5555 4444", "1234567890123456", "1234", "1" * 20,
            "0" * 13, "0" * 12, "x4111111111111111y", "٤١١١١١١١١١١١١١١١"]
    out = [r[0] for r in texts(rows).orderBy("id").select(detect.luhn_valid(F.col("text"))).collect()]
    assert out == [True, True, False, False, False, True, False, True, True]


def _redacted(texts, rows, rules):
    out = with_redaction(texts(rows), "text", rules).orderBy("id").collect()
    return [(r.redacted, r.counts) for r in out]


def test_counts_and_text(texts):
    got = _redacted(texts, ["Mail x@y.org or ring +1-555-867-5309"], rule_set(["email", "phone"]))
    assert got == [("Mail [REDACTED] or ring +[REDACTED]", {"email": 1, "phone": 1})]


def test_unchanged_rows(texts):
    rows = ["Nothing to see", "", None, "\n\n", "[REDACTED] stays", "cost $5 \\1 $0 C:\\x"]
    assert _redacted(texts, rows, ALL_RULES) == [(r, {}) for r in rows]
    assert _redacted(texts, ["a@b.com"], rule_set([])) == [("a@b.com", {})]


def test_replacement_characters_survive(texts):
    got = _redacted(texts, ["pay $1 \\2 a@b.com $0 \\E"], rule_set(["email"]))
    assert got[0][0] == "pay $1 \\2 [REDACTED] $0 \\E"


def test_positions_at_both_ends_and_adjacent(texts):
    got = _redacted(texts, ["a@b.com", "a@b.com c@d.com", "x\na@b.com"], rule_set(["email"]))
    assert [g[0] for g in got] == ["[REDACTED]", "[REDACTED] [REDACTED]", "x\n[REDACTED]"]


def test_code_point_offsets(texts):
    row = texts(["😀é a@b.com"]).select(S.find_spans(F.col("text"), rule_set(["email"])).alias("s")).first()
    assert [(x.s, x.e, x.rule) for x in row.s] == [(3, 10, "email")]


def test_tie_goes_to_phone_unless_cards_come_first(texts):
    text = ["4111111111111111 at 123.123.123.123"]
    assert _redacted(texts, text, rule_set())[0][1] == {"phone": 2}
    first = rule_set(order=("credit_card", "ip"))
    assert _redacted(texts, text, first)[0][1] == {"credit_card": 1, "ip": 1}


def test_longest_span_covers_what_is_inside(texts):
    got = _redacted(texts, ["The secret is 12345678 here."], ALL_RULES)
    assert got == [("[REDACTED]", {"confidential": 1})]


def test_dots_of_a_mail_end_sentences(texts):
    # "secret a@b." is a sentence of its own; it starts first and swallows the mail's head
    got = _redacted(texts, ["A secret a@b.com is out."], rule_set(["email", "confidential"]))
    assert got == [("[REDACTED]com is out.", {"confidential": 1})]


def test_keywords_replace_or_extend(texts):
    rows = ["The bluebird plan is done.", "This is secret."]
    own = rule_set(["confidential"], keywords="bluebird, , falcon ")
    assert [g[1] for g in _redacted(texts, rows, own)] == [{"confidential": 1}, {}]
    both = rule_set(["confidential"], keywords=["bluebird"], keyword_mode="extend")
    assert [g[1] for g in _redacted(texts, rows, both)] == [{"confidential": 1}] * 2


def test_keyword_with_punctuation(texts):
    own = rule_set(["confidential"], keywords=["c++", "driver's"])
    got = _redacted(texts, ["We use c++x now.", "The driver's seat.", "drivers seat."], own)
    assert [bool(g[1]) for g in got] == [True, True, False]


def test_switches():
    assert rules_from_switches(None).rules == ()
    assert rules_from_switches({"redact_ip": True, "redact_email": 1, "redact_jwt": False}).rules == ("email", "ip")
    assert rules_from_switches({"redact_custom_keywords": "x"}).rules == ()
    assert rule_set().rules == DEFAULT_RULES
    assert len(CONFIDENTIAL_KEYWORDS) == 48
    assert parse_keywords(" a, ,b c ,") == ("a", "b c")
    with pytest.raises(ValueError):
        rule_set(["nope"])


def test_column_functions_match_staged_form(texts):
    df = texts([t for _, t, _ in GOLDEN])
    one = df.select("id", S.redact(F.col("text"), ALL_RULES).alias("redacted"),
                    S.rule_counts(F.col("text"), ALL_RULES).alias("counts"))
    two = with_redaction(df, "text", ALL_RULES).select("id", "redacted", "counts")
    assert sorted(one.collect()) == sorted(two.collect())


def test_email_equals_a_plain_scan_on_random_runs(texts):
    """The long-run form gives what a scan from every boundary gives."""
    rng = random.Random(5)
    plain = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", re.ASCII)
    rows = ["".join(rng.choice(["a", "B7", ".", "-", "+", "%", "_", "@", "@b.co", " ", "a.", "x" * 40, "-" * 40])
                    for _ in range(rng.randint(1, 60))) for _ in range(400)]
    df = texts(rows)
    got = {r["id"]: r for r in df.select(
        "id", detect.matches(F.col("text"), "email").alias("m"), detect.has_rule(F.col("text"), "email").alias("has"),
        F.transform(S.find_spans(F.col("text"), rule_set(["email"])), lambda s: F.struct(s["s"], s["e"])).alias("s")).collect()}
    for i, row in enumerate(rows):
        found = list(plain.finditer(row))
        assert got[i]["m"] == [m[0] for m in found] and got[i]["has"] == bool(found)
        assert [tuple(s) for s in got[i]["s"]] == [m.span() for m in found]


def test_long_runs_and_unspaced_text_stay_linear(texts):
    cjk = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(80_000))
    df = texts(["a." * 200_000 + " ann@mail.example.org", "%2B-" * 100_000 + "@", cjk])
    df.select(detect.matches(F.col("text"), "email"), detect.shannon_entropy(F.lit("ab"))).collect()  # compile
    start = time.perf_counter()
    got = df.select(detect.matches(F.col("text"), "email").alias("m"),
                    detect.shannon_entropy(F.when(F.col("id") == 2, F.col("text"))).alias("e")).collect()
    assert time.perf_counter() - start < 10
    assert [r["m"] for r in got] == [["ann@mail.example.org"], [], []]
    want = -sum(n / len(cjk) * math.log2(n / len(cjk)) for n in Counter(cjk).values())
    assert got[2]["e"] == pytest.approx(want)
