"""Span algebra on many spans and on random ones."""

import random

from pyspark.sql import functions as F

from inkveil.config import ALL_RULES, rule_set
from inkveil.constants import REDACTED_LABEL
from inkveil.functions import spans as S
from inkveil.operators.redaction import scan, with_redaction


def test_more_matches_than_one_block(texts):
    n = 3 * S.BLOCK + 7
    words = [f"user{i}@mail{i}.org" for i in range(n)]
    row = with_redaction(texts([" é ".join(words)]), "text", rule_set(["email"])).first()
    assert row.counts == {"email": n}
    assert row.redacted == " é ".join([REDACTED_LABEL] * n)


def test_exactly_one_block(texts):
    for n in (S.BLOCK - 1, S.BLOCK, S.BLOCK + 1):
        text = " ".join(["a@b.co"] * n) + " tail"
        row = with_redaction(texts([text]), "text", rule_set(["email"])).first()
        assert row.redacted == " ".join([REDACTED_LABEL] * n) + " tail"


def test_many_sentences(texts):
    n = 2 * S.BLOCK + 5
    text = "".join(f"Line {i} is {'secret' if i % 2 else 'open'}. " for i in range(n))
    row = scan(texts([text]), "text", rule_set(["confidential"])).first()
    got = [text[x.s:x.e] for x in row.spans]
    assert got == [(" " if i else "") + f"Line {i} is secret." for i in range(n) if i % 2]


def test_long_text_without_terminator_is_fast(texts):
    row = scan(texts(["word " * 200_000 + "secret"]), "text", rule_set(["confidential"])).first()
    assert row.spans == []


def _kept(spans):
    """Plain definition: walk in order, keep what starts at or after the last kept end."""
    last, out = 0, []
    for s, e, p in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if s >= last:
            out.append((s, e, p))
            last = e
    return out


def test_resolve_random_spans(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        size = rng.choice([0, 1, 2, 5, 20, 400])
        items = []
        for _ in range(size):
            s = rng.randrange(0, 60 if size < 100 else 3000)
            items.append((s, s + rng.randrange(1, 12), rng.randrange(0, 4)))
        rows.append((i, items))
    df = spark.createDataFrame(
        [(i, [(s, e, p, str(p)) for s, e, p in items]) for i, items in rows],
        f"id int, spans array<{S.SPAN_TYPE}>")
    got = {r.id: [(x.s, x.e, x.prio) for x in r.k]
           for r in df.select("id", S.resolve(F.col("spans")).alias("k")).collect()}
    assert got == {i: _kept(items) for i, items in rows}


def test_text_outside_spans_is_kept(texts):
    rows = ["a@b.co 12345678 x", "USD 5 and 10.0.0.1 and secret things. Done.", "plain"]
    for r in with_redaction(scan(texts(rows), "text", ALL_RULES), "text", ALL_RULES).collect():
        cut = sum(x.e - x.s for x in r.spans)
        assert len(r.redacted) == len(r.text) - cut + len(REDACTED_LABEL) * len(r.spans)
        assert sum(r.counts.values()) == len(r.spans)


def test_partitioning_does_not_matter(spark, texts):
    df = texts([f"mail m{i}@x.org and 10.0.0.{i % 256}" for i in range(200)])
    one = scan(df.coalesce(1), "text", ALL_RULES).collect()
    many = scan(df.repartition(7), "text", ALL_RULES).collect()
    assert sorted(one) == sorted(many)


def test_joined_units(spark):
    df = spark.createDataFrame([(["mail a@", "b.", "com now", "", "x 10.0.", "0.1"],), ([],)], "u array<string>")
    rows = df.select("u", S.joined_spans(F.col("u"), ALL_RULES).alias("s")).select(
        F.zip_with("u", "s", S.redact_spans).alias("r"),
        S.count_spans(F.flatten("s"), ALL_RULES).alias("c")).collect()
    assert rows[0].r == ["mail [REDACTED]", "", " now", "", "x [REDACTED]", ""]
    assert rows[0].c == {"email": 1, "ip": 1}
    assert rows[1].r == [] and rows[1].c == {}
