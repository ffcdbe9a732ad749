"""The same row expressions on a stream.

Redaction, counting and ``plans.batch.anonymise`` are stateless projections: a stream
needs no watermark and no state for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkveil.config import RuleSet
from inkveil.operators.redaction import with_redaction


def read_stream(
    spark: SparkSession, folder: str, schema, files_per_trigger: int = 1000,
    glob: str = "*.parquet",
) -> DataFrame:
    """Parquet files arriving in a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", glob).parquet(folder)
    )


def redact_stream(stream: DataFrame, column: str, rules: RuleSet) -> DataFrame:
    return with_redaction(stream, column, rules)


def write_available(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, then stop; restarts go on where the checkpoint ends."""
    return (
        stream.writeStream.format("parquet").option("path", folder)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
