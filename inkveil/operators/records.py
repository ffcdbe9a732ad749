"""Metadata records that another extractor read from PDF files and images.

The records come as flat rows; here they become the same key/value table as package
metadata, so one policy, one diff and one audit serve all formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.operators.metadata import META_COLUMNS, records_to_meta


def _meta(path: Column, kind: str, surface: Column, key: Column, ordinal: Column,
          value: Column, value_type: str = "string") -> list[Column]:
    return [path.alias("path"), F.lit(kind).alias("kind"), surface.alias("surface"),
            key.alias("key"), ordinal.cast("int").alias("ordinal"), value.alias("value"),
            F.lit(value_type).alias("value_type")]


def pdf_records(df: DataFrame) -> DataFrame:
    """``path``, the info fields, three flags and ``annotation_authors`` as rows.

    Flags give a row only if they are set; annotation authors are a sorted set.
    """
    info = records_to_meta(
        df, F.col("path"), "pdf", "info", [*C.PDF_INFO_FIELDS, *C.PDF_DATE_FIELDS])
    flags = {"has_xmp": "xmp", "acroform": "form", "has_embedded_files": "embedded_file"}
    set_flags = df.select("path", *flags).unpivot(
        ["path"], list(flags), "key", "value").filter("value")
    surface = F.create_map(*[F.lit(x) for pair in flags.items() for x in pair])[F.col("key")]
    flag_rows = set_flags.select(*_meta(
        F.col("path"), "pdf", surface, F.col("key"), F.lit(0), F.lit("true"), "boolean"))
    authors = F.filter(F.array_sort(F.array_distinct("annotation_authors")), lambda a: a != "")
    annotations = df.select("path", F.posexplode_outer(authors).alias("i", "a")).filter(
        "a IS NOT NULL").select(*_meta(
            F.col("path"), "pdf", F.lit("annotation"), F.lit("T"), F.col("i"), F.col("a")))
    return info.select(*META_COLUMNS).unionByName(flag_rows).unionByName(annotations)


def image_records(df: DataFrame) -> DataFrame:
    """Raw tag maps (``exif``, ``info``, ``iptc``), ``icc_bytes`` and ``comment`` as rows.

    Only sensitive EXIF tags and the known text chunks are kept; IPTC codes get names.
    """

    def tags(column: str, surface: str, keep: tuple[str, ...] | None) -> Column:
        entries = F.map_entries(column)
        if keep:
            entries = F.filter(entries, lambda e: e["key"].isin(*keep))
        names = F.create_map(*[F.lit(x) for pair in C.IPTC_NAMES.items() for x in pair])
        key = (lambda e: F.coalesce(F.try_element_at(names, e["key"]), e["key"])) \
            if surface == "iptc" else (lambda e: e["key"])
        rows = F.transform(entries, lambda e: F.struct(
            F.lit(surface).alias("surface"), key(e).alias("key"),
            F.coalesce(e["value"], F.lit("")).alias("value")))
        return F.coalesce(rows, F.array().cast("array<struct<surface:string,key:string,value:string>>"))

    def one(surface: str, key: str, value: Column) -> Column:
        return F.filter(F.array(F.struct(
            F.lit(surface).alias("surface"), F.lit(key).alias("key"), value.alias("value"))),
            lambda r: r["value"].isNotNull())

    icc = F.concat(F.lit("present ("), F.col("icc_bytes").cast("string"), F.lit(" bytes)"))
    rows = F.concat(
        tags("exif", "exif", C.SENSITIVE_EXIF), tags("info", "png_text", C.PNG_TEXT_KEYS),
        tags("iptc", "iptc", None), one("icc_profile", "icc_profile", icc),
        one("comment", "jpeg_comment", F.col("comment")))
    return df.select("path", F.inline_outer(rows)).filter("surface IS NOT NULL").select(*_meta(
        F.col("path"), "image", F.col("surface"), F.col("key"), F.lit(0), F.col("value")))
