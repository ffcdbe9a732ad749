"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_cleaned(
    df: DataFrame, folder: str, partition_by: list[str] | None = None,
    mode: str = "errorifexists", kind: str = "parquet",
) -> None:
    """Cleaned table as files of ``kind``, written by the executors; never overwrites by default.

    Tasks write their own files per partition value, so a large value is many files,
    not one hot task.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(folder)
