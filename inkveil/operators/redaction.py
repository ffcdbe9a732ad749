"""Redaction of table columns.

The spans of a column are computed in one projection and read by the next one, so
each rule scans a text once, however many outputs are derived from the spans.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.config import RuleSet
from inkveil.functions import spans as S


def scan(df: DataFrame, column: str, rules: RuleSet, into: str = "spans") -> DataFrame:
    """Add the kept spans of ``column``."""
    return (
        df.withColumn(into, S.all_spans(F.col(column), rules))
        .withColumn(into, S.resolve(F.col(into)))
    )


def with_redaction(
    df: DataFrame, column: str, rules: RuleSet,
    into: str = "redacted", counts: str | None = "counts",
) -> DataFrame:
    """Add redacted text and, per row, ``map<rule, n>``; nothing chosen -> unchanged."""
    if not rules:
        out = df.withColumn(into, F.col(column))
        return out if counts is None else out.withColumn(counts, S.count_spans(S.no_spans(), rules))
    out = scan(df, column, rules, "_spans").withColumn(
        into, S.redact_spans(F.col(column), F.col("_spans"))
    )
    if counts is not None:
        out = out.withColumn(counts, S.count_spans(F.col("_spans"), rules))
    return out.drop("_spans")


def redact_columns(df: DataFrame, columns: Iterable[str], rules: RuleSet) -> DataFrame:
    """Redact several text columns in place."""
    order = df.columns
    for c in columns:
        df = with_redaction(df, c, rules, into=c, counts=None)
    return df.select(*order)


def explode_spans(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row per span.

    The outer form plus a filter on its result: the plain form would let the optimiser
    copy the whole span expression into a size filter and scan every text again.
    """
    return df.select(*keys, F.explode_outer(spans).alias("_x")).filter("_x IS NOT NULL").select(
        *keys,
        F.col("_x.rule").alias("rule"),
        F.col("_x.s").cast("bigint").alias("s"),
        F.col("_x.e").cast("bigint").alias("e"),
    )


def with_changed(df: DataFrame, before: str, after: str, into: str = "changed") -> DataFrame:
    """True where the text was altered; unchanged rows need no rewrite."""
    return df.withColumn(into, ~F.col(before).eqNullSafe(F.col(after)))
