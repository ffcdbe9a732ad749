"""Text-table scan and text units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil import constants as C


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One parquet table, only the named columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | ~text.rlike(rf"(?=\S)[^{C.SPACE_CHARS}]")


def explode_units(df: DataFrame, column: str, separator: str = "\n") -> DataFrame:
    """One row per unit; a match never crosses a unit.  ``unit_no`` starts at 0."""
    keep = [c for c in df.columns if c != column]
    return df.select(
        *keep,
        F.posexplode(F.split(column, f"\\Q{separator}\\E", -1)).alias("unit_no", column),
    )


def cell_units(df: DataFrame, ids: list[str]) -> DataFrame:
    """One row per string cell; cells of other types are no units."""
    cells = [c for c in string_columns(df) if c not in ids]
    return df.unpivot(ids, cells, "column", "text").filter(F.col("text").isNotNull())


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~is_blank(F.col(column)))
