"""Binary files and their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.functions.display import base_name, extension


def file_extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty if there is none."""
    return F.lower(F.regexp_replace(extension(base_name(path)), r"^\.", ""))


def is_supported(path: Column) -> Column:
    return file_extension(path).isin(*C.KIND_BY_EXTENSION)


def file_kind(path: Column, content: Column | None = None) -> Column:
    """Kind by known extension, else by the first bytes, else null."""
    ext = file_extension(path)
    by_kind: dict[str, list[str]] = {}
    for e, k in C.KIND_BY_EXTENSION.items():
        by_kind.setdefault(k, []).append(e)
    kind: Column | None = None
    for k, exts in by_kind.items():
        cond = ext.isin(*exts)
        kind = F.when(cond, k) if kind is None else kind.when(cond, k)
    if content is not None:
        kind = kind.when(F.startswith(content, F.lit(C.PDF_MAGIC)), "pdf").when(
            F.startswith(content, F.lit(C.ZIP_MAGIC)), "docx")
    return kind


def binary_files(spark: SparkSession, folder: str, supported_only: bool = True) -> DataFrame:
    """All files below a folder.  ``content`` is read only if a query asks for it."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    )
    return files.filter(is_supported(F.col("path"))) if supported_only else files
