"""Counts and reports.

All group-bys here are sums and counts: Spark combines them inside each task before
the shuffle, so a language or source that holds most rows costs a few rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.config import RuleSet
from inkveil.operators.redaction import scan
from inkveil.functions import spans as S


def counts_by_row(df: DataFrame, column: str, rules: RuleSet, keys: list[str]) -> DataFrame:
    """Long form ``(keys…, rule, n)``; rows without a span disappear."""
    return (
        scan(df, column, rules, "_spans")
        .select(*keys, F.explode_outer(S.count_spans(F.col("_spans"), rules)).alias("rule", "n"))
        .filter("rule IS NOT NULL")
    )


def merge_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Key-wise sum of long-form counts."""
    return counts.groupBy(*keys, "rule").agg(F.sum("n").alias("n"))


def summary_line(counts: Column) -> Column:
    """``n item(s) redacted (rule: n, …)``, rules by name; null if nothing was."""
    parts = F.transform(
        F.array_sort(F.map_entries(F.map_filter(counts, lambda _, n: n > 0))),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")),
    )
    total = total_redactions(counts)
    return F.when(total > 0, F.concat(
        total.cast("string"), F.lit(" item(s) redacted ("),
        F.array_join(parts, ", "), F.lit(")"),
    ))


def total_redactions(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, n: a + n)


def profile(counts: DataFrame, group: str, doc_id: str) -> DataFrame:
    """Documents touched and spans by group × rule, with subtotals (null = all)."""
    return counts.rollup(group, "rule").agg(
        F.count_distinct(doc_id).alias("docs"), F.sum("n").alias("spans"),
    )


def top_exposed(counts: DataFrame, doc_id: str, k: int) -> DataFrame:
    """The ``k`` documents with most redactions (a top-k: heaps, no full sort)."""
    return (
        counts.groupBy(doc_id).agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), doc_id).limit(k)
    )


def residual_audit(df: DataFrame, redacted: str, rules: RuleSet) -> DataFrame:
    """What the same rules still find in redacted text."""
    return (
        counts_by_row(df, redacted, rules, [])
        .groupBy("rule").agg(F.count("*").alias("docs"), F.sum("n").alias("spans"))
    )


def batch_status(results: DataFrame) -> DataFrame:
    return results.groupBy("success").agg(F.count("*").alias("n"))


def split_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(succeeded, failed)."""
    return results.filter("success"), results.filter("NOT success")


def distinct_values(meta: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Distinct non-blank values per key, one row each (a set, never one big array)."""
    return meta.filter(F.col(value) != "").select(*keys, value).distinct()
