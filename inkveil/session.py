"""Session helpers: defaults, checkpoint folder, scan parallelism, size checks."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it is known to hold at most this many rows.
BROADCAST_MAX_ROWS = 50_000


def tune(spark: SparkSession) -> SparkSession:
    """Settings the jobs rely on; sizes are left to the cluster's own defaults."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed by the two zip functions only; Spark serves the file to every executor.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the driver and all executors share, if the session names one."""
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared folder that the session names; ``fallback`` (tests) only where none is set.

    Returns None if there is no folder: callers then go on without a checkpoint.
    """
    folder = shared_folder(spark) or fallback
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's files, in the shared folder that the session names; local only where none is (tests)."""
    base = shared_folder(spark) or tempfile.mkdtemp(prefix="files-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once for several readers, its plan cut off.

    Column files in the shared folder that the session names, of which a reader opens only the
    columns it needs; where none is named (tests), blocks on the executors' disks, which Spark
    works out again if one is lost.
    """
    spark = df.sparkSession
    if shared_folder(spark):
        folder = run_folder(spark, "settled")
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)
    return df.persist(StorageLevel.DISK_ONLY)


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy projection enough tasks.

    A table that arrives as a handful of large row groups would run its regular
    expressions on a handful of cores.  Such a scan is dealt out once, round-robin
    (no key, so no hot partition).  A scan that already fills half the slots is left
    alone, so a large table is never shuffled for this.

    ``df`` is a scan or a projection of one: counting its partitions runs no job.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 <= slots:
        return df.repartition(slots)
    return df


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame | None:
    """``broadcast(df)`` if a bounded count proves it small, else None.

    The count stops after ``max_rows + 1`` rows, so the check itself stays cheap on
    a large table.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return None
