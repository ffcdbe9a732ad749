"""Policy-driven strip of key/value metadata, reports and audits.

The policy is a small table.  It is broadcast only after its size is known; a larger one
is joined by shuffle, with the rows of hot keys salted, because one key may hold a large
share of all rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.plans.policies import ANY, DEFAULT_POLICY, PolicyRow, active
from inkveil.session import BROADCAST_MAX_ROWS, small_side

META_KEY = ("path", "kind", "surface", "key", "ordinal")
#: A key is hot if it holds more than one in HOT of all rows, so there are fewer hot keys than HOT;
#: its rows are dealt to a number of tasks in proportion.
HOT, SALTS = 64, 128


def policy_frame(
    spark: SparkSession, policy: Iterable[PolicyRow] = DEFAULT_POLICY,
    categories: Iterable[str] = C.CATEGORIES,
) -> DataFrame:
    """The rows that the chosen categories switch on, one per (kind, surface, key)."""
    rows = [(r.kind, r.surface, r.key, ",".join(r.categories), r.action)
            for r in active(policy, categories)]
    return spark.createDataFrame(
        rows, "kind string, surface string, key string, category string, action string")


def _join(meta: DataFrame, policy: DataFrame, on: list[str], small: bool) -> DataFrame:
    if small:
        return meta.join(F.broadcast(policy), on, "left")
    hot = F.broadcast(hot_keys(meta, on))
    salts = F.coalesce("_salts", F.lit(1))
    spread_out = (policy.join(hot, on, "left")
                  .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts"))
    salted = (meta.join(hot, on, "left")
              .withColumn("_salt", F.pmod(F.xxhash64("path", "ordinal", "value"), salts).cast("int")).drop("_salts"))
    return salted.join(spread_out, [*on, "_salt"], "left").drop("_salt")


def hot_keys(meta: DataFrame, on: list[str]) -> DataFrame:
    """(*on, _salts): keys with more than one in HOT of all rows and the tasks that share their rows.

    Rows are counted by key inside each task first; the few keys are found when the join runs.
    """
    counts = meta.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = meta.agg(F.count(F.lit(1)).alias("_total")).scalar()
    return (counts.withColumn("_total", total).filter(F.col("_n") * HOT > F.col("_total"))
            .select(*on, F.ceil(F.col("_n") * SALTS / F.col("_total")).cast("int").alias("_salts")))


def with_action(
    meta: DataFrame, policy: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Add ``category`` and ``action``; an exact key beats a whole-surface row."""
    exact = policy.filter(F.col("key") != ANY)
    whole = policy.filter(F.col("key") == ANY).select(
        "kind", "surface", F.col("category").alias("_category"), F.col("action").alias("_action"))
    small = small_side(policy, max_rows) is not None
    joined = _join(meta, exact, ["kind", "surface", "key"], small)
    joined = _join(joined, whole, ["kind", "surface"], small)
    return joined.select(
        *meta.columns,
        F.coalesce("category", "_category").alias("category"),
        F.coalesce("action", "_action").alias("action"),
    )


def _new_value(action: Column, value: Column) -> Column:
    has = value.isNotNull() & (value != "")
    return (
        F.when(action == "blank", F.when(value.isNotNull(), F.lit("")))
        .when(action == "epoch", F.when(has, F.lit(C.EPOCH_DATE)).otherwise(value))
        .when(action == "one", F.when(has, F.lit("1")).otherwise(value))
        .when(action == "visible", F.lit("visible"))
        .when(action.isin("null", "drop"), F.lit(None).cast("string"))
        .otherwise(value)
    )


def plan_strip(meta: DataFrame, policy: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Every row with its old value, new value and action (null = no policy row)."""
    return with_action(meta, policy, max_rows).withColumn("old_value", F.col("value")).withColumn(
        "value", _new_value(F.col("action"), F.col("old_value")))


def strip(meta: DataFrame, policy: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Metadata after the strip: same columns, dropped rows gone."""
    return plan_strip(meta, policy, max_rows).filter(
        F.col("action").isNull() | (F.col("action") != "drop")).select(*meta.columns)


def removed_report(planned: DataFrame) -> DataFrame:
    """Old values that were really changed."""
    return planned.filter(
        F.col("action").isNotNull() & (F.col("old_value") != "")
        & ~F.col("old_value").eqNullSafe(F.col("value"))
    ).select(*META_KEY, "old_value", "action")


def bag_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind, surface, key, old_value, times): values that ``before`` holds more often than ``after``.

    One aggregation over both, without a join; the place of a value in its package does not matter.
    Empty and null values are no values.
    """
    keys = ["path", "kind", "surface", "key", "value"]
    both = before.select(*keys, F.lit(1).alias("n")).unionByName(after.select(*keys, F.lit(-1).alias("n")))
    return (both.filter(F.col("value") != "").groupBy(*keys).agg(F.sum("n").alias("times"))
            .filter("times > 0").withColumnRenamed("value", "old_value"))


def _diff_status(is_new: Column) -> Column:
    old_blank = F.coalesce(F.col("old_value") == "", F.lit(True))
    new_blank = F.coalesce(F.col("new_value") == "", F.lit(True))
    return (
        F.when(is_new, "added")
        .when(F.col("old_value").eqNullSafe(F.col("new_value")), "kept")
        .when(new_blank & ~old_blank, "cleared")
        .when(old_blank & new_blank, "kept")
        .otherwise("changed")
    )


def diff_planned(planned: DataFrame) -> DataFrame:
    """The diff of a planned strip: each row holds both values, so nothing is shuffled or joined."""
    dropped = F.coalesce(F.col("action") == "drop", F.lit(False))
    rows = planned.withColumn("new_value", F.when(~dropped, F.col("value")))
    return rows.select(*META_KEY, "old_value", "new_value", _diff_status(F.lit(False)).alias("status"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per key of two tables: kept, changed, cleared or added.  The key is unique in either table.

    Both tables meet in one aggregation by key, without a join; null keys are a key like others.
    """
    keys, value = list(META_KEY), F.struct("value")
    both = (before.select(*keys, value.alias("_old"), F.lit(None).cast("struct<value:string>").alias("_new"))
            .unionByName(after.select(*keys, F.lit(None).cast("struct<value:string>").alias("_old"), value.alias("_new"))))
    met = both.groupBy(*keys).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    rows = met.withColumn("old_value", F.col("_old.value")).withColumn("new_value", F.col("_new.value"))
    return rows.select(*keys, "old_value", "new_value", _diff_status(F.col("_old").isNull()).alias("status"))


def residual_metadata(
    after: DataFrame, policy: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Covered keys that still hold something a strip would change."""
    planned = plan_strip(after, policy, max_rows)
    return planned.filter(
        F.col("action").isNotNull() & (F.col("old_value") != "")
        & ~F.col("old_value").eqNullSafe(F.col("value"))
    ).select(*META_KEY, F.col("old_value").alias("value"))


def uncovered_keys(
    meta: DataFrame, policy: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Keys with values that no policy row covers, with their row counts."""
    free = with_action(meta, policy, max_rows).filter("action IS NULL")
    return free.filter(F.col("value") != "").groupBy("kind", "surface", "key").agg(
        F.count("*").alias("n"))
