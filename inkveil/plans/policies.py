"""Strip policies as data: which key belongs to which category, and what happens to it.

Actions on a metadata row:
``blank`` -> ''   ``drop`` -> row goes   ``epoch`` -> fixed date   ``one`` -> '1'
``visible`` -> 'visible'   ``null`` -> null
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from inkveil import constants as C

ANY = "*"


@dataclass(frozen=True)
class PolicyRow:
    kind: str
    surface: str
    key: str                       # ANY = every key of the surface
    categories: tuple[str, ...]    # applied if one of them is chosen
    action: str


def _core(kind: str, strings: Iterable[str], dates: Iterable[str]) -> list[PolicyRow]:
    people = {"author", "creator", "last_modified_by", "lastModifiedBy"}
    rows = [
        PolicyRow(kind, "core", k, ("author",) if k in people else ("software",), "blank")
        for k in strings
    ]
    rows += [PolicyRow(kind, "core", k, ("dates",), "drop") for k in dates]
    rows += [PolicyRow(kind, "core", k, ("software",), "one") for k in C.CORE_INTEGERS]
    return rows


DEFAULT_POLICY: tuple[PolicyRow, ...] = (
    # text documents
    *_core("docx", C.DOCX_CORE_STRINGS.values(), C.DOCX_CORE_DATES.values()),
    PolicyRow("docx", "comments", "author", ("author",), "blank"),
    PolicyRow("docx", "comments", "initials", ("author",), "blank"),
    PolicyRow("docx", "comments", "date", ("author",), "epoch"),
    PolicyRow("docx", "tracked_changes", "author", ("author",), "blank"),
    PolicyRow("docx", "tracked_changes", "date", ("author",), "epoch"),
    PolicyRow("docx", "app", ANY, ("author",), "blank"),
    PolicyRow("docx", "template", ANY, ("author", "software"), "drop"),
    PolicyRow("docx", "document_variables", ANY, ("author", "software"), "drop"),
    PolicyRow("docx", "mail_merge", ANY, ("author", "software"), "drop"),
    PolicyRow("docx", "threaded_comments", "author", ("author",), "blank"),
    PolicyRow("docx", "threaded_comments", "provision_id", ("author",), "drop"),
    PolicyRow("docx", "people", ANY, ("author",), "blank"),
    PolicyRow("docx", "custom_xml", ANY, ("author",), "drop"),
    # workbooks
    *_core("xlsx", C.XLSX_CORE_STRINGS, C.XLSX_CORE_DATES),
    PolicyRow("xlsx", "custom_properties", ANY, ("author", "dates", "software"), "drop"),
    PolicyRow("xlsx", "hidden_sheets", ANY, ("author", "dates", "software"), "visible"),
    PolicyRow("xlsx", "threaded_comments", "author", ("author",), "blank"),
    PolicyRow("xlsx", "people", ANY, ("author",), "blank"),
    PolicyRow("xlsx", "custom_xml", ANY, ("author",), "drop"),
    PolicyRow("xlsx", "connections", ANY, ("software",), "drop"),
    PolicyRow("xlsx", "external_links", ANY, ("software",), "drop"),
    PolicyRow("xlsx", "defined_names", ANY, ("software",), "drop"),
    # PDF records
    PolicyRow("pdf", "info", "Author", ("author",), "blank"),
    *(PolicyRow("pdf", "info", k, ("dates",), "blank") for k in C.PDF_DATE_FIELDS),
    *(PolicyRow("pdf", "info", k, ("software",), "blank")
      for k in C.PDF_INFO_FIELDS if k != "Author"),
    PolicyRow("pdf", "xmp", ANY, ("software",), "null"),
    *(PolicyRow("pdf", "annotation", k, ("author",), "blank") for k in ("T", "Subj", "CA", "RC")),
    *(PolicyRow("pdf", "form", k, ("author", "software"), "blank") for k in ("TU", "TM")),
    PolicyRow("pdf", "form", "NeedAppearances", ("author", "software"), "drop"),
    *(PolicyRow("pdf", "embedded_file", k, ("dates",), "blank")
      for k in ("CreationDate", "ModDate", "Description")),
    # image records: any category clears everything
    *(PolicyRow("image", s, ANY, C.CATEGORIES, "drop")
      for s in ("exif", "png_text", "iptc", "comment", "icc_profile")),
)

_LEGACY = {
    ("docx", "core"): ("author", "dates", "software"),
    ("xlsx", "core"): ("author", "dates", "software"),
}


def legacy_gate(policy: Iterable[PolicyRow] = DEFAULT_POLICY) -> tuple[PolicyRow, ...]:
    """Core fields go as a whole with any one of author, dates or software.

    Workbook dates go with dates or software only.
    """
    out = []
    for r in policy:
        gate = _LEGACY.get((r.kind, r.surface), r.categories)
        if r.kind == "xlsx" and r.surface == "core" and r.action == "drop":
            gate = ("dates", "software")
        out.append(replace(r, categories=gate))
    return tuple(out)


def active(policy: Iterable[PolicyRow], categories: Iterable[str]) -> list[PolicyRow]:
    """Rows switched on by the chosen categories."""
    chosen = set(categories)
    unknown = chosen - set(C.CATEGORIES)
    if unknown:
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    return [r for r in policy if chosen.intersection(r.categories)]
