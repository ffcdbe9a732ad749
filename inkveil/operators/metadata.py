"""Metadata inventory: package parts -> one key/value table.

``parts``  (path, kind, part, ordinal, xml, error)
``meta``   (path, kind, surface, key, ordinal, value, value_type)

Every part is parsed once: a projection picks the extractor by part name and yields an
array of rows.  Only three things need other parts of the same package and are settled
on the small rows, not on XML: relationship look-ups (equi-joins) and sets that span
several parts (distinct + rank, per package).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.functions import xmltokens as T
from inkveil.functions.xmltext import xml_error
from inkveil.session import settled

META_COLUMNS = ("path", "kind", "surface", "key", "ordinal", "value", "value_type")

_XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
_VARIANTS = (
    "lpwstr", "lpstr", "bstr", "i1", "i2", "i4", "i8", "int", "ui1", "ui2", "ui4",
    "ui8", "uint", "r4", "r8", "decimal", "bool", "filetime", "date",
)

# column -> (parts it reads, schema of the part)
_PARSED = {
    "core": ("part = 'docProps/core.xml'", ", ".join(f"{f} string" for f in (
        *C.DOCX_CORE_STRINGS, *C.DOCX_CORE_DATES, *C.CORE_INTEGERS))),
    "app": ("part = 'docProps/app.xml'", ", ".join(f"{f} string" for f in C.APP_FIELDS)),
    "custom": ("part = 'docProps/custom.xml'", "property array<struct<_name:string,"
               + ",".join(f"{v}:string" for v in _VARIANTS) + ">>"),
    "comments": ("part = 'word/comments.xml'",
                 "comment array<struct<_author:string,_initials:string,_date:string>>"),
    "settings": ("part = 'word/settings.xml'",
                 "attachedTemplate struct<_id:string>, "
                 "docVars struct<docVar:array<struct<_name:string,_val:string>>>, "
                 "mailMerge struct<dataSource:array<struct<fileName:string,"
                 "connectString:string>>,headerSource:struct<fileName:string>>"),
    "rels": ("part = 'word/_rels/settings.xml.rels' OR part LIKE 'xl/externalLinks/_rels/%.rels'",
             "Relationship array<struct<_Id:string,_Target:string>>"),
    "workbook": ("part = 'xl/workbook.xml'",
                 "sheets struct<sheet:array<struct<_name:string,_state:string>>>, "
                 "definedNames struct<definedName:array<struct<_name:string,_VALUE:string>>>"),
    "connections": ("part = 'xl/connections.xml'",
                    "connection array<struct<_name:string,_description:string,"
                    "dbPr:struct<_connection:string>>>"),
    "pivot": ("part LIKE 'xl/pivotCache/%.xml'",
              "cacheSource struct<worksheetSource:struct<_ref:string,_sheet:string,_name:string>>"),
}

# Surfaces that only help to resolve others.
_TEMPLATE_REF, _REL, _LINK_PART, _LINK_REL = "_template_ref", "_rel", "_link_part", "_link_rel"
_HELPERS = (_TEMPLATE_REF, _REL, _LINK_PART, _LINK_REL)
# Surfaces whose values form a sorted set per package.
_SETS = ("threaded_comments", "custom_xml")
# a custom item that a strip has emptied is no metadata any more
_CUSTOM_ITEM = f"lower(part) LIKE '{C.CUSTOM_XML_PREFIX}%.xml'"


def _row(surface: str, key: str, ordinal: str, value: str, value_type: str = "string") -> str:
    return (
        f"named_struct('surface', '{surface}', 'key', {key}, 'ordinal', CAST({ordinal} AS INT), "
        f"'value', CAST({value} AS STRING), 'value_type', '{value_type}')"
    )


def _each(items: str, row: str, keep: str = "r.value <> ''") -> str:
    """Rows over an array (element ``x``, position ``i``), blank ones dropped."""
    return f"filter(transform({items}, (x, i) -> {row}), r -> {keep})"


def _iso(value: str) -> str:
    stamp = f"date_format(try_to_timestamp({value}), \"yyyy-MM-dd'T'HH:mm:ss\")"
    return f"coalesce({stamp}, {value})"


def _core(names: dict[str, str], dates: dict[str, str], missing_integer: str) -> str:
    rows = [_row("core", f"'{key}'", "0", f"coalesce(core.{el}, '')") for el, key in names.items()]
    rows += [_row("core", f"'{key}'", "0", _iso(f"nullif(core.{el}, '')"), "timestamp")
             for el, key in dates.items()]
    rows += [_row("core", f"'{f}'", "0", f"coalesce(nullif(core.{f}, ''), {missing_integer})", "int")
             for f in C.CORE_INTEGERS]
    return f"array({', '.join(rows)})"


# columns of attribute values, read from the tags of a part without its comments and sections
_TRACKED_PART, _CHILD_PARTS = "part = 'word/document.xml'", (
    "part LIKE '%/threadedComments/%' OR part IN ('word/people.xml', 'xl/people.xml')")
_CHILD_ATTRIBUTES = ("author", "provisionId", "name", "id")


def _tag_columns(xml: Column) -> list[Column]:
    """The tags that ``_attribute_columns`` reads, cut once per part, and whether a custom item holds text."""
    plain = T.plain(xml)
    return [
        F.when(F.expr(_TRACKED_PART), T.tags_named(plain, C.TRACKED_CHANGE_TAGS)).alias("_tracked"),
        F.when(F.expr(f"{_CHILD_PARTS} OR {_CUSTOM_ITEM}"), T.child_tags(plain)).alias("_children"),
        F.when(F.expr(_CUSTOM_ITEM), F.trim(F.regexp_replace(plain, "(?s)<[^>]*+>", "")) != "").alias("_has_text"),
    ]


def _attribute_columns() -> list[Column]:
    def values(tags: str, name: str) -> Column:
        return F.filter(F.transform(tags, lambda t: T.attribute(t, name)), lambda v: v != "")

    return [
        *(F.when(F.expr(_TRACKED_PART), values("_tracked", a)).alias(f"tracked_{a}") for a in ("author", "date")),
        *(F.when(F.expr(_CHILD_PARTS), values("_children", a)).alias(f"child_{a}") for a in _CHILD_ATTRIBUTES),
        F.when(F.expr(_CUSTOM_ITEM), (F.size("_children") > 0) | F.col("_has_text")).alias("custom_held"),
    ]


def author_list(parts: DataFrame) -> DataFrame:
    """(path, part, authors) of comment parts: with duplicates, document order, as one display line.

    A part without authors, or one that must not be read, has an empty line.
    """
    xml = T.plain(F.when(F.col("error").isNull(), F.col("xml")))
    authors = F.filter(F.transform(T.tags_named(xml, ["comment"]), lambda t: T.attribute(t, "author")), lambda a: a != "")
    return parts.filter("part = 'word/comments.xml'").select(
        "path", "part", F.coalesce(F.array_join(authors, ", "), F.lit("")).alias("authors"))


_MM = "settings.mailMerge"
_LAST = "try_element_at(filter(transform({0}.dataSource, x -> x.{1}), v -> v <> ''), -1)"
_BASE = r"regexp_extract(part, '([^/]+?)(\\.rels)?$', 1)"

# condition on the part -> SQL for its rows
_ROWS: list[tuple[str, str]] = [
    ("part = 'docProps/core.xml' AND kind = 'xlsx'", _core(
        {f: f for f in C.XLSX_CORE_STRINGS}, {f: f for f in C.XLSX_CORE_DATES}, "NULL")),
    ("part = 'docProps/core.xml'", "filter("
     + _core(C.DOCX_CORE_STRINGS, C.DOCX_CORE_DATES, "NULL")
     + ", r -> r.value_type <> 'int' OR r.value IS NOT NULL)"),  # no revision is no row
    ("part = 'docProps/app.xml'", "array(" + ", ".join(
        _row("app", f"'{key}'", "0", f"nullif(app.{el}, '')") for el, key in C.APP_FIELDS.items()
    ) + ")"),
    ("part = 'docProps/custom.xml'", _each(
        "custom.property", _row("custom_properties", "x._name", "i", "coalesce("
        + ", ".join(f"x.{v}" for v in _VARIANTS) + ", '')"), "r.key <> ''")),
    ("part = 'word/comments.xml'", "concat(" + ", ".join(
        _each("comments.comment", _row("comments", f"'{a}'", "i", f"x._{a}", t))
        for a, t in (("author", "string"), ("initials", "string"), ("date", "timestamp"))) + ")"),
    ("part = 'word/document.xml'", "concat(" + ", ".join(
        _each(f"array_sort(array_distinct(tracked_{a}))",
              _row("tracked_changes", f"'{a}'", "i", "x", t))
        for a, t in (("author", "string"), ("date", "timestamp"))) + ")"),
    ("part = 'word/settings.xml'", "concat("
     + "filter(array(" + _row(_TEMPLATE_REF, "settings.attachedTemplate._id", "0", "NULL")
     + "), r -> r.key <> ''), "
     # a name given twice keeps its last value
     + "filter(" + _each("settings.docVars.docVar", _row(
         "document_variables", "x._name", "i", "coalesce(x._val, '')"), "r.key <> ''")
     + ", r -> r.ordinal = size(settings.docVars.docVar) - array_position(reverse("
     + "transform(settings.docVars.docVar, d -> d._name)), r.key)), "
     + "array(" + ", ".join((
         _row("mail_merge", "'data_source'", "0", _LAST.format(_MM, "fileName")),
         _row("mail_merge", "'header_source'", "0", f"nullif({_MM}.headerSource.fileName, '')"),
         _row("mail_merge", "'connect_string'", "0", _LAST.format(_MM, "connectString")),
     )) + "))"),
    ("part = 'word/_rels/settings.xml.rels'",
     _each("rels.Relationship", _row(_REL, "x._Id", "i", "x._Target"), "r.key <> ''")),
    ("part LIKE 'word/threadedComments/%'", "concat("
     + _each("child_author", _row("threaded_comments", "'author'", "i", "x")) + ", "
     + _each("child_provisionId", _row("threaded_comments", "'provision_id'", "i", "x"))
     + ")"),
    ("part LIKE 'xl/threadedComments/%.xml'",
     _each("child_author", _row("threaded_comments", "'author'", "i", "x"))),
    ("part = 'word/people.xml'", "concat("
     + _each("child_name", _row("people", "'name'", "i", "x")) + ", "
     + _each("child_id", _row("people", "'id'", "i", "x")) + ")"),
    ("part = 'xl/people.xml'", _each("child_name", _row("people", "'name'", "i", "x"))),
    ("part = 'xl/workbook.xml'", "concat("
     + _each("filter(workbook.sheets.sheet, x -> x._state <> 'visible')",
             _row("hidden_sheets", "'sheet'", "i", "x._name")) + ", "
     + _each("workbook.definedNames.definedName", _row(
         "defined_names", "x._name", "i", "trim(coalesce(x._VALUE, ''))"), "r.key <> ''") + ")"),
    ("part = 'xl/connections.xml'", "concat(" + ", ".join(
        _each("connections.connection", _row("connections", f"'{k}'", "i", v))
        for k, v in (("name", "x._name"), ("description", "x._description"),
                     ("connection", "x.dbPr._connection"))) + ")"),
    ("part LIKE 'xl/pivotCache/%.xml'", _each(
        "array(pivot.cacheSource.worksheetSource)", _row(
            "pivot_sources", _BASE, "i", "concat(nullif(x._sheet, ''), '!', "
            "coalesce(nullif(x._ref, ''), nullif(x._name, '')))"))),
    ("part LIKE 'xl/externalLinks/_rels/%.xml.rels'", _each(
        "rels.Relationship", _row(_LINK_REL, _BASE, "i", "x._Target"))),
    ("part LIKE 'xl/externalLinks/%.xml'", f"array({_row(_LINK_PART, _BASE, '0', 'NULL')})"),
    (f"lower(part) LIKE '{C.CUSTOM_XML_PREFIX}%'",
     f"CASE WHEN coalesce(custom_held, true) THEN array({_row('custom_xml', chr(39) + 'part' + chr(39), '0', 'part')}) END"),
]

# surface -> parts that feed it, so that one surface reads only its own parts
_SOURCES = {
    "core": ["docProps/core.xml"], "app": ["docProps/app.xml"],
    "custom_properties": ["docProps/custom.xml"], "comments": ["word/comments.xml"],
    "tracked_changes": ["word/document.xml"],
    "template": ["word/settings.xml", "word/_rels/settings.xml.rels"],
    "document_variables": ["word/settings.xml"], "mail_merge": ["word/settings.xml"],
    "threaded_comments": ["word/threadedComments/%", "xl/threadedComments/%"],
    "people": ["word/people.xml", "xl/people.xml"],
    "hidden_sheets": ["xl/workbook.xml"], "defined_names": ["xl/workbook.xml"],
    "connections": ["xl/connections.xml"], "pivot_sources": ["xl/pivotCache/%"],
    "external_links": ["xl/externalLinks/%"], "custom_xml": None,
}
SURFACES = tuple(_SOURCES)


def check_parts(parts: DataFrame) -> DataFrame:
    """Add an error to XML parts that must not be parsed."""
    return parts.withColumn(
        "error", F.coalesce(F.col("error"), xml_error(F.col("xml")))
    )


def _only(parts: DataFrame, surfaces: Iterable[str]) -> DataFrame:
    cond: Column | None = None
    for s in surfaces:
        if _SOURCES[s] is None:
            one = F.lower("part").startswith(C.CUSTOM_XML_PREFIX)
        else:
            one = F.lit(False)
            for p in _SOURCES[s]:
                one = one | (F.col("part").like(p) if "%" in p else F.col("part") == p)
        cond = one if cond is None else cond | one
    return parts.filter(cond)


def part_rows(parts: DataFrame) -> DataFrame:
    """Rows of every part on its own, helpers included; unreadable parts give none."""
    xml = F.expr("CASE WHEN error IS NULL THEN xml END")
    parsed = [
        F.when(F.expr(cond), F.from_xml(xml, schema, _XML)).alias(name)
        for name, (cond, schema) in _PARSED.items()
    ]
    arms = " ".join(f"WHEN {cond} THEN {rows}" for cond, rows in _ROWS)
    return (
        parts.select("path", "kind", "part", "ordinal", "error", *parsed, *_tag_columns(xml))
        .select("*", *_attribute_columns())
        .select("path", "kind", F.inline_outer(F.expr(
            f"CASE WHEN error IS NOT NULL THEN NULL {arms} END")))
        .filter("surface IS NOT NULL")
    )


def _look_up(rows: DataFrame, left: str, right: str, surface: str, key: Column) -> DataFrame:
    """Inner equi-join of references and relationships of the same package."""
    refs = rows.filter(F.col("surface") == left).select("path", "kind", "key").distinct()
    targets = rows.filter((F.col("surface") == right) & (F.col("value") != "")).select(
        "path", "key", "ordinal", "value")
    return refs.join(targets, ["path", "key"]).select(
        "path", "kind", F.lit(surface).alias("surface"), key.alias("key"),
        "ordinal", "value", F.lit("string").alias("value_type"))


def inventory(
    parts: DataFrame, surfaces: Iterable[str] = SURFACES, settle: bool = False,
) -> DataFrame:
    """Metadata of all packages as key/value rows; ``parts`` went through ``check_parts``.

    ``settle`` works the extracted rows out before the look-ups read them again, so a large corpus
    is parsed once (see ``session.settled``).
    """
    surfaces = tuple(surfaces)
    rows = part_rows(_only(parts, surfaces))
    if settle:
        rows = settled(rows)
    pieces = []
    plain = [s for s in surfaces if s not in (*_SETS, "template", "external_links")]
    if plain:
        pieces.append(rows.filter(F.col("surface").isin(plain)))
    sets = [s for s in surfaces if s in _SETS]
    if sets:
        # one package's entries: its small extracted rows
        rank = Window.partitionBy("path", "surface", "key").orderBy("value")
        pieces.append(
            rows.filter(F.col("surface").isin(sets)).drop("ordinal").distinct()
            .withColumn("ordinal", (F.row_number().over(rank) - 1).cast("int")))
    if "template" in surfaces:
        first = _look_up(rows, _TEMPLATE_REF, _REL, "template", F.lit("template_path"))
        pieces.append(first.groupBy("path", "kind", "surface", "key", "value_type").agg(
            F.min_by("value", "ordinal").alias("value"), F.lit(0).alias("ordinal")))
    if "external_links" in surfaces:
        pieces.append(_look_up(rows, _LINK_PART, _LINK_REL, "external_links", F.col("key")))
    out = pieces[0].select(*META_COLUMNS)
    for p in pieces[1:]:
        out = out.unionByName(p.select(*META_COLUMNS))
    return out


def records_to_meta(
    df: DataFrame, path: Column, kind: str, surface: str, columns: Iterable[str],
) -> DataFrame:
    """Flat metadata records of another extractor (PDF, images, tables) as rows.

    Timestamps become ISO text; a null stays a row with a null value.
    """
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        if types[c].startswith("timestamp") or types[c] == "date":
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return F.col(c).cast("string")

    names = list(columns)
    value_type = F.create_map(*[F.lit(x) for c in names for x in (
        c, "timestamp" if types[c].startswith(("timestamp", "date")) else types[c])])
    flat = df.select(path.alias("path"), *[text(c).alias(c) for c in names])
    return flat.unpivot(["path"], names, "key", "value").select(
        "path", F.lit(kind).alias("kind"), F.lit(surface).alias("surface"), "key",
        F.lit(0).alias("ordinal"), "value", value_type[F.col("key")].alias("value_type"))
