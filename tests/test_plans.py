"""Shape of the plans: no Python, no needless shuffle, every pattern once."""

import pytest
from pyspark.sql import functions as F

from inkveil.config import ALL_RULES, rule_set
from inkveil.constants import EMAIL_PATTERN
from inkveil.functions.detect import PATTERNS
from inkveil.operators import redaction, reports
from inkveil.session import small_side, spread

DATA = "/root/testdata/sf0.001"


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_redaction_is_one_projection_in_the_jvm(docs):
    plan = _physical(redaction.with_redaction(docs.select("doc_id", "text"), "text", ALL_RULES))
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_every_pattern_is_scanned_once(docs):
    out = redaction.with_redaction(docs.select("doc_id", "text"), "text", ALL_RULES)
    patterns = sum(len(p) for p in PATTERNS.values()) + 1   # and the sentences
    assert _physical(out).count("regexp_extract_all") == patterns
    exploded = redaction.explode_spans(redaction.scan(docs, "text", ALL_RULES), ["doc_id"])
    assert _physical(exploded).count("regexp_extract_all") == patterns


def test_only_chosen_rules_are_in_the_plan(docs):
    plan = _physical(redaction.with_redaction(docs, "text", rule_set(["email"])))
    assert EMAIL_PATTERN in plan and plan.count("regexp_extract_all") == 1


def test_counts_are_combined_before_the_shuffle(docs):
    out = reports.merge_counts(reports.counts_by_row(docs, "text", ALL_RULES, ["lang"]), ["lang"])
    plan = _physical(out)
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2


def test_top_k_needs_no_full_sort(docs):
    out = reports.top_exposed(reports.counts_by_row(docs, "text", ALL_RULES, ["doc_id"]), "doc_id", 5)
    assert "TakeOrderedAndProject" in _physical(out)


def test_spread_only_where_tasks_are_few(spark, docs):
    slots = spark.sparkContext.defaultParallelism
    assert "Exchange RoundRobin" in _physical(spread(docs))
    wide = spark.range(0, 100, 1, slots)
    assert "Exchange" not in _physical(spread(wide))


def test_size_check_before_broadcast(spark):
    assert small_side(spark.range(10), 10) is not None
    assert small_side(spark.range(11), 10) is None
