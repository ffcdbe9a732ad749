"""XML part text: well-formedness, and edits that keep every other byte.

Edits are pattern replacements on the text of a part, keyed by local name with any
namespace prefix and either quote style.  Rewriting through a parser would rename
prefixes and reorder attributes; these do not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import xmltokens as T

_PREFIX = r"(?:[\w.-]++:)?"
_QUOTED = r"(?:\"[^\"]*+\"|'[^']*+')"
_ATTR = rf"\s++[^\s=>/\"']++\s*+=\s*+{_QUOTED}"


def _attr_named(name: str) -> str:
    return rf"\s++{_PREFIX}{name}\s*+=\s*+"


def _attrs_before(name: str) -> str:
    """All attributes ahead of the one called ``name``."""
    return rf"(?:(?!{_attr_named(name)}){_ATTR})*+"


def xml_error(xml: Column) -> Column:
    """Why a part must not be read, or null.  No entity is ever expanded."""
    bad = F.from_xml(
        xml, "_corrupt_record string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )["_corrupt_record"]
    return (
        F.when(xml.isNull(), F.lit(None).cast("string"))
        .when(xml.rlike(r"<!DOCTYPE"), F.lit("document type declaration"))
        .when(bad.isNotNull(), F.lit("malformed XML"))
    )


def escape(text: Column, quotes: bool = False) -> Column:
    """Text as XML character data, with ``quotes`` also as an attribute value."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if quotes else [])
    for raw, safe in pairs:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _any(names: str | Iterable[str]) -> str:
    names = [names] if isinstance(names, str) else list(names)
    return names[0] if len(names) == 1 else "(?:" + "|".join(names) + ")"


def set_attribute(xml: Column, element: str | Iterable[str], attribute: str, value: str) -> Column:
    """Overwrite an attribute that is present, on every such element."""
    pattern = (
        rf"(<{_PREFIX}{_any(element)}{_attrs_before(attribute)}{_attr_named(attribute)}){_QUOTED}"
    )
    return F.regexp_replace(xml, pattern, f'$1"{value}"')


def drop_attribute(xml: Column, element: str | Iterable[str], attribute: str) -> Column:
    pattern = (
        rf"(<{_PREFIX}{_any(element)}{_attrs_before(attribute)}){_attr_named(attribute)}{_QUOTED}"
    )
    return F.regexp_replace(xml, pattern, "$1")


def drop_element(xml: Column, element: str | Iterable[str]) -> Column:
    """Remove an element with its content (it never holds another of its own name)."""
    pattern = (
        rf"(?s)<({_PREFIX}{_any(element)})(?:{_ATTR})*+\s*+(?:/>|>.*?</\1\s*+>)"
    )
    return F.regexp_replace(xml, pattern, "")


def set_text(xml: Column, element: str | Iterable[str], value: str = "") -> Column:
    """Overwrite the content of an element, whatever it holds; an empty element stays empty."""
    pattern = rf"(<({_PREFIX}{_any(element)})(?:{_ATTR})*+\s*+>)(?:[^<]++|<(?!/\2\s*+>))++(</\2\s*+>)"
    return F.regexp_replace(xml, pattern, f"$1{value}$3")


def drop_children(xml: Column) -> Column:
    """Keep the root element, without its content."""
    pattern = (
        rf"(?s)\A((?:\s*+<\?.*?\?>|\s*+<!--.*?-->)*+\s*+<([\w.:-]++)(?:{_ATTR})*+)"
        rf"\s*+>.*</\2\s*+>\s*\z"
    )
    return F.regexp_replace(xml, pattern, "$1></$2>")


def drop_relationship(xml: Column, rel_id: Column) -> Column:
    """Remove the relationship with this id (null id -> unchanged)."""
    head = rf"<{_PREFIX}Relationship{_attrs_before('Id')}{_attr_named('Id')}[\"']"
    tail = rf"[\"'](?:{_ATTR})*+\s*+(?:/>|>\s*+</{_PREFIX}Relationship\s*+>)"
    pattern = F.concat(F.lit(head + "\\Q"), rel_id, F.lit("\\E" + tail))
    return F.when(rel_id.isNull(), xml).otherwise(F.regexp_replace(xml, pattern, F.lit("")))


# Opens a run: a text element (also of inline cells), or the stored text of a formula cell.
_FORMULA = rf"<{_PREFIX}f(?:{_ATTR})*+\s*+(?:/>|>[^<]*+</{_PREFIX}f\s*+>)\s*+"
_TEXT_CELL = rf"<{_PREFIX}c{_attrs_before('t')}{_attr_named('t')}(?:\"str\"|'str')(?:{_ATTR})*+\s*+>\s*+"
_OPEN = rf"<{_PREFIX}t(?:{_ATTR})*+\s*+>|{_TEXT_CELL}(?:{_FORMULA})?<{_PREFIX}v(?:{_ATTR})*+\s*+>"
_RUN = rf"({_OPEN})([^<]++)(</{_PREFIX}[tv]\s*+>)"


def _groups(xml: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(xml, F.lit(pattern), F.lit(group))


def _interleave(xml: Column, pattern: str, pieces: Column) -> Column:
    """``xml`` with its matches of ``pattern`` replaced, in order, by ``pieces``."""
    gaps = F.split(xml, pattern, -1)
    return F.array_join(F.zip_with(
        gaps, pieces, lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")


def plain_runs(xml: Column) -> Column:
    """Marked sections become ordinary text and comments go, so that runs hold text only."""
    return T.plain(xml)


def run_texts(xml: Column) -> Column:
    """Texts of all runs, document order; ``xml`` comes from ``plain_runs``."""
    return F.transform(_groups(xml, _RUN, 2), T.unescape)


def text_runs(xml: Column) -> Column:
    """All run texts of a part as it stands, document order; never fails on a part."""
    return run_texts(plain_runs(xml))


def replace_runs(xml: Column, old: Column, new: Column) -> Column:
    """Put the ``new`` texts in place; tags, unchanged texts and all between keep their bytes."""
    runs = F.arrays_zip(
        _groups(xml, _RUN, 1).alias("open"), _groups(xml, _RUN, 2).alias("raw"),
        _groups(xml, _RUN, 3).alias("close"), old.alias("old"), new.alias("new"))
    pieces = F.transform(runs, lambda r: F.concat(
        r["open"], F.when(r["old"] == r["new"], r["raw"]).otherwise(escape(r["new"])), r["close"]))
    return _interleave(xml, _RUN, pieces)
