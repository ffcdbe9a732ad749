"""Display text and output names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil import constants as C


def display_value(value: Column) -> Column:
    """Null, ``None`` and blank show as a dash."""
    blank = value.isNull() | (value == "None") | ~value.rlike(rf"(?=\S)[^{C.SPACE_CHARS}]")
    return F.when(blank, F.lit(C.EMPTY_DISPLAY)).otherwise(value)


def display_list(values: Column) -> Column:
    """Comma join; an empty or missing list shows as a dash."""
    return F.when(
        values.isNull() | (F.size(values) == 0), F.lit(C.EMPTY_DISPLAY)
    ).otherwise(F.array_join(values, ", ", "None"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(name: Column) -> Column:
    """Name without its last extension; leading dots belong to the name."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def extension(name: Column) -> Column:
    """Last extension with its dot, as written; empty if there is none."""
    return F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)


def cleaned_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit(C.CLEANED_SUFFIX), extension(name))


def encrypted_name(name: Column) -> Column:
    return F.concat(stem(name), F.lit(C.ENCRYPTED_SUFFIX), extension(name))


def download_name(
    name: Column, encrypted: Column, suffix: str = C.DOWNLOAD_SUFFIX,
    overwrite: bool = False,
) -> Column:
    if overwrite:
        return name
    tag = F.when(encrypted, F.lit(C.ENCRYPTED_SUFFIX)).otherwise(F.lit(""))
    return F.concat(stem(name), F.lit(suffix), tag, extension(name))


def in_bundle(name: Column) -> Column:
    """Only cleaned or encrypted outputs ship; intermediates never do."""
    return name.rlike(C.BUNDLE_PATTERN)


def parse_keyword_list(raw: Column) -> Column:
    """Comma list -> array of trimmed, non-blank phrases."""
    pad = rf"^[{C.SPACE_CHARS}]+|[{C.SPACE_CHARS}]+$"
    return F.filter(
        F.transform(F.split(raw, ",", -1), lambda k: F.regexp_replace(k, pad, "")),
        lambda k: F.length(k) > 0,
    )
