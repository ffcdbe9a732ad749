"""Helpers shared by the operators: session, stored tables, Arrow maps, gapless ranks."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.session import spread, tune

# Bytes of ASCII white space; every other byte belongs to a word.
SPACE = b" \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: small Arrow batches bound a worker's memory."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="stored-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local one only where unset (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or _own_folder()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text as UTF-8 bytes, …) with enough tasks; columns besides these are left unread."""
    return spread(docs.select("doc_id", *more, F.col("text").cast("binary").alias("text")))


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """``function`` turns each Arrow batch into columns by name."""
    names = [f.name for f in _schema(df.sparkSession, schema)]
    kinds = _arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = function(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[n], type=t) for n, t in zip(names, kinds, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def _schema(spark: SparkSession, ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], ddl).schema


def _arrow(spark: SparkSession, ddl: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in _schema(spark, ddl)]


def gapless(df: DataFrame, keys: list[str], order: list[str], name: str, salts: int | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, … within each group of ``keys``, also where one group holds most rows.

    A group is dealt to ``salts`` parts by a hash of ``order``; a part is numbered by a window
    and starts where the parts before it end.  Only (keys, part) counts are joined back.
    """
    spark = df.sparkSession
    salts = salts or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part, start, n = f"__part_{name}", f"__start_{name}", f"__n_{name}"
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    return (dealt.withColumn(name, F.row_number().over(inside) - 1)
            .join(starts, [*keys, part])
            .withColumn(name, F.col(name) + F.col(start)).drop(part, start))
