"""DuckDB statements for the metadata queries: the planted columns, no XML."""

from __future__ import annotations

ORDER_PATH = "'order-' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.docx' ELSE '.xlsx' END"
TURN_PATH = "'turn-' || conv_id || '-' || turn || '.docx'"
SUPPLIER_PATH = "'supplier-' || s_suppkey || '.docx'"
PEOPLE_PATH = "'people-' || c_custkey || '.docx'"
BOOK_PATH = "'book-' || p_partkey || '.xlsx'"


def rows(table: str, path: str, surface: str, *items: tuple[str, str, str, str]) -> str:
    """One SELECT per (key, ordinal, value, condition)."""
    return " UNION ALL ".join(
        f"SELECT {path} AS path, '{surface}' AS surface, CAST({key} AS VARCHAR) AS key, "
        f"CAST({ordinal} AS BIGINT) AS ordinal, CAST({value} AS VARCHAR) AS value "
        f"FROM {table} WHERE {cond}"
        for key, ordinal, value, cond in items
    )


EVEN, ODD = "o_orderkey % 2 = 0", "o_orderkey % 2 = 1"
CREATED = "CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END"
REVISION = "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1 + o_orderkey % 9 AS VARCHAR) END"
TITLE = "'Order ' || o_orderkey || ' & more'"
CORE = rows(
    "orders", ORDER_PATH, "core",
    ("'title'", "0", TITLE, "true"),
    ("'author'", "0", "o_orderpriority", EVEN), ("'creator'", "0", "o_orderpriority", ODD),
    ("'last_modified_by'", "0", "'user' || o_custkey", EVEN),
    ("'lastModifiedBy'", "0", "'user' || o_custkey", ODD),
    *((f"'{k}'", "0", "''", "true") for k in (
        "category", "identifier", "keywords", "language", "subject", "version")),
    *((f"'{k}'", "0", "''", EVEN) for k in ("comments", "content_status")),
    *((f"'{k}'", "0", "''", ODD) for k in ("contentStatus", "description")),
    ("'revision'", "0", REVISION, f"({EVEN}) AND ({REVISION}) IS NOT NULL"), ("'revision'", "0", REVISION, ODD),
    ("'created'", "0", CREATED, "true"), ("'modified'", "0", "NULL", "true"),
    ("'last_printed'", "0", "NULL", EVEN), ("'lastPrinted'", "0", "NULL", ODD),
)

LINES = (
    "(SELECT *, CAST(i - 1 AS BIGINT) AS i0 FROM (SELECT conv_id, turn, role, "
    "unnest(string_split(text, chr(10))) AS line, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations))"
)
AUTHOR = "CASE WHEN i0 % 3 = 2 THEN '' ELSE role || ' ' || (i0 % 2) END"
TRACKED = (
    f"SELECT path, 'tracked_changes' AS surface, key, CAST(row_number() OVER ("
    f"PARTITION BY path, key ORDER BY value) - 1 AS BIGINT) AS ordinal, value FROM ("
    f"SELECT DISTINCT {TURN_PATH} AS path, 'author' AS key, role || ' ' || (i0 % 5) AS value "
    f"FROM {LINES} WHERE i0 % 3 < 2 UNION ALL "
    f"SELECT DISTINCT {TURN_PATH}, 'date', '2024-02-0' || (1 + i0 % 3) || 'T08:00:00Z' "
    f"FROM {LINES} WHERE i0 % 3 < 2)"
)
DOC_VARS = rows(
    "supplier", SUPPLIER_PATH, "document_variables",
    ("'owner'", "0", "s_name", "true"), ("'flag'", "1", "''", "true"),
    ("'nation'", "2", "s_nationkey", "true"),
)
MAIL_MERGE = rows(
    "supplier", SUPPLIER_PATH, "mail_merge",
    ("'data_source'", "0", "CASE WHEN s_suppkey % 2 = 0 THEN '\\\\srv\\' || s_name || '.csv' END", "true"),
    ("'header_source'", "0", "CASE WHEN s_suppkey % 2 = 0 THEN 'head-' || s_suppkey || '.csv' END", "true"),
    ("'connect_string'", "0", "NULL", "true"),
)
TEMPLATE = rows(
    "supplier", SUPPLIER_PATH, "template",
    ("'template_path'", "0",
     "'file:///C:/users/' || s_name || '/letter' || (1 + s_suppkey % 3) || '.dotx'",
     "s_suppkey % 3 <> 0"),
)
THREADED = (
    f"SELECT path, 'threaded_comments' AS surface, key, CAST(row_number() OVER ("
    f"PARTITION BY path, key ORDER BY value) - 1 AS BIGINT) AS ordinal, value FROM ("
    f"SELECT {PEOPLE_PATH} AS path, 'author' AS key, unnest([c_name, c_mktsegment, 'Z' || c_custkey]) AS value FROM customer "
    f"UNION ALL SELECT {PEOPLE_PATH}, 'provision_id', unnest(['p1-' || c_custkey, 'p2-' || c_custkey]) FROM customer)"
)
PEOPLE = rows(
    "customer", PEOPLE_PATH, "people",
    ("'name'", "0", "c_name", "true"), ("'name'", "1", "c_mktsegment", "true"),
    ("'id'", "0", "'P' || c_custkey", "true"),
)
APP = rows(
    "customer", "'customer-' || c_custkey || '.docx'", "app",
    ("'company'", "0", "c_mktsegment || ' & Sons'", "true"),
    ("'manager'", "0", "CASE WHEN c_custkey % 3 = 0 THEN c_name END", "true"),
)
HIDDEN = rows("part", BOOK_PATH, "hidden_sheets", ("'sheet'", "0", "p_brand", "p_partkey % 3 <> 1"))
NAMES = rows(
    "part", BOOK_PATH, "defined_names",
    ("'Area_' || p_size", "0", "'Data!$A$' || p_size", "true"), ("'Empty'", "1", "''", "true"),
)
CONNECTIONS = rows(
    "part", BOOK_PATH, "connections",
    ("'name'", "0", "p_name", "true"), ("'connection'", "0", "'Provider=X;User=' || p_brand", "true"),
)
PIVOT = rows(
    "part", BOOK_PATH, "pivot_sources",
    ("'pivotCacheDefinition1.xml'", "0",
     "p_type || '!' || CASE WHEN p_partkey % 3 = 0 THEN 'A1:B' || p_size ELSE 'Table1' END",
     "p_partkey % 3 < 2"),
)
LINKS = rows("part", BOOK_PATH, "external_links",
             ("'externalLink1.xml'", "0", "'file:///srv/' || p_brand || '.xlsx'", "true"))
CUSTOM = rows("part", BOOK_PATH, "custom_properties",
              ("'Client'", "0", "p_name", "true"), ("'Size'", "1", "p_size", "true"))
CUSTOM_XML = rows("part", BOOK_PATH, "custom_xml",
                  ("'part'", "0", "'customXML/item2.xml'", "true"),
                  ("'part'", "1", "'customXml/item1.xml'", "true"))
COMMENT_ROWS = (
    f"SELECT {TURN_PATH} AS path, 'comments' AS surface, 'author' AS key, i0 AS ordinal, {AUTHOR} AS value "
    f"FROM {LINES} WHERE i0 % 3 < 2"
)
COMMENT_REST = (
    f"SELECT {TURN_PATH} AS path, 'comments' AS surface, unnest(['initials', 'date']) AS key, i0 AS ordinal, "
    f"'x' AS value FROM {LINES}"
)
EVERYTHING = " UNION ALL ".join((
    CORE, APP, DOC_VARS, MAIL_MERGE, TEMPLATE, THREADED, PEOPLE, HIDDEN, NAMES, CONNECTIONS,
    PIVOT, LINKS, CUSTOM, CUSTOM_XML, COMMENT_ROWS, COMMENT_REST,
))

ISO = "%Y-%m-%dT%H:%M:%S"

PDF_PATH = "'order-' || o_orderkey || '.pdf'"
ANNOTATORS = "list_sort(['user' || o_custkey, 'Zoe', 'Ann'])"
PDF = rows(
    "orders", PDF_PATH, "info",
    ("'Author'", "0", "'user' || o_custkey", "true"), ("'Title'", "0", "o_orderpriority", "true"),
    ("'Subject'", "0", "NULL", "true"), ("'Creator'", "0", "'Writer'", "true"),
    ("'Producer'", "0", "''", "true"), ("'Keywords'", "0", "o_orderstatus", "true"),
    ("'CreationDate'", "0", "strftime(o_orderdate, '%Y%m%d')", "true"), ("'ModDate'", "0", "NULL", "true"),
) + " UNION ALL " + rows("orders", PDF_PATH, "xmp", ("'has_xmp'", "0", "'true'", "o_orderkey % 2 = 0")
) + " UNION ALL " + rows("orders", PDF_PATH, "form", ("'acroform'", "0", "'true'", "o_orderkey % 3 = 0")
) + " UNION ALL " + rows(
    "orders", PDF_PATH, "annotation", *(("'T'", str(i), f"{ANNOTATORS}[{i + 1}]", "true") for i in range(3)))
IMAGE_PATH = "'image-' || c_custkey || '.jpg'"
IMAGE = " UNION ALL ".join(rows("customer", IMAGE_PATH, s, *items) for s, items in {
    "exif": [("'Artist'", "0", "c_name", "true"), ("'GPSInfo'", "0", "c_nationkey", "true")],
    "png_text": [("'Author'", "0", "c_name", "true")],
    "iptc": [("'Byline'", "0", "c_name", "true"), ("'2#999'", "0", "c_mktsegment", "true")],
    "icc_profile": [("'icc_profile'", "0", "'present (' || c_custkey || ' bytes)'", "c_custkey % 2 = 0")],
    "comment": [("'jpeg_comment'", "0", "c_mktsegment", "c_custkey % 3 = 0")],
}.items())


def _table(table: str, key: str, *columns: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}/' || {key} AS path, '{table}' AS surface, '{c}' AS key, {v} AS value, "
        f"'{t}' AS value_type, '{act}' AS act FROM {table}" for c, v, t, act in columns)


META = " UNION ALL ".join((
    _table("customer", "c_custkey",
           ("c_name", "c_name", "string", "author:blank"),
           ("c_nationkey", "CAST(c_nationkey AS VARCHAR)", "int", "geo:drop"),
           ("c_mktsegment", "c_mktsegment", "string", "")),
    _table("orders", "o_orderkey",
           ("o_orderdate", f"strftime(o_orderdate, '{ISO}')", "timestamp", "dates:drop"),
           ("o_orderpriority", "o_orderpriority", "string", "")),
    _table("events", "event_id",
           ("ts", f"strftime(ts, '{ISO}')", "timestamp", "dates:epoch"),
           ("props", "props", "string", "software:blank")),
))


def stripped(*categories: str) -> str:
    """Rows after the strip, old value kept alongside."""
    on = ", ".join(f"'{c}'" for c in categories)
    return (
        f"SELECT path, surface, key, value AS old_value, act2, CASE act2 WHEN 'blank' THEN "
        f"CASE WHEN value IS NOT NULL THEN '' END WHEN 'epoch' THEN '1970-01-01T00:00:00Z' "
        f"ELSE value END AS value FROM (SELECT *, CASE WHEN split_part(act, ':', 1) IN ({on}) "
        f"THEN split_part(act, ':', 2) ELSE '' END AS act2 FROM ({META}))"
    )


def _after(*categories: str) -> str:
    return f"SELECT path, surface, key, value FROM ({stripped(*categories)}) WHERE act2 <> 'drop'"


ALL = ("author", "dates", "geo", "software")
PEOPLE_KEYS = "('author', 'creator', 'last_modified_by', 'lastModifiedBy')"
DATE_KEYS = "('created', 'modified', 'last_printed', 'lastPrinted')"
OTHER_NAMES = "['word/header1.xml', 'word/footer12.xml', 'word/charts/chart1.xml', 'word/styles.xml', 'customXml/item1.xml', 'docs/word/document.xml']"

ORACLES: dict[str, str] = {
    "meta_core_props": CORE,
    "meta_app_fields": APP,
    "meta_comment_authors": COMMENT_ROWS,
    "comment_author_list": (
        f"SELECT {TURN_PATH} AS path, coalesce(string_agg({AUTHOR}, ', ' ORDER BY i0) "
        f"FILTER (WHERE i0 % 3 < 2), '') AS authors FROM {LINES} GROUP BY conv_id, turn"),
    "meta_tracked_changes": TRACKED,
    "distinct_authors": (
        f"SELECT value, count(*) AS packages FROM ({TRACKED}) WHERE key = 'author' GROUP BY value"),
    "meta_template_path": TEMPLATE,
    "meta_doc_vars": DOC_VARS,
    "meta_mail_merge": MAIL_MERGE,
    "meta_threaded": THREADED,
    "meta_people": PEOPLE,
    "meta_hidden_sheets": HIDDEN,
    "meta_defined_names": NAMES,
    "meta_connections": CONNECTIONS,
    "meta_pivot_sources": PIVOT,
    "meta_external_links": LINKS,
    "meta_custom_properties": CUSTOM,
    "meta_custom_parts": CUSTOM_XML,
    "meta_inventory": (
        f"SELECT split_part(path, '.', 2) AS kind, surface, count(*) AS n, "
        f"count(DISTINCT path) AS packages, count(value) AS with_value "
        f"FROM ({EVERYTHING}) GROUP BY ALL"),
    "meta_unpivot": f"SELECT path, surface, key, value, value_type FROM ({META})",
    "meta_pdf_records": PDF,
    "meta_image_records": f"SELECT path, surface, key, value FROM ({IMAGE})",
    "record_strip": (
        f"SELECT path, surface, key, CASE WHEN key = 'Author' OR surface = 'annotation' THEN '' "
        f"ELSE value END AS value FROM ({PDF})"),
    "policy_strip": _after(*ALL),
    "policy_strip_salted": _after(*ALL),
    "policy_strip_skewed": (
        f"{_after(*ALL)} UNION ALL SELECT concat_ws('/', 'lineitem', l_orderkey, l_linenumber), 'lineitem', "
        f"'l_returnflag', CASE WHEN l_returnflag IS NOT NULL THEN '' END FROM lineitem"),
    "policy_strip_author_only": _after("author"),
    "policy_strip_dates_only": _after("dates"),
    "package_strip": (
        f"SELECT path, key, CASE WHEN key IN {PEOPLE_KEYS} THEN value "
        f"WHEN key = 'revision' AND value IS NOT NULL THEN '1' "
        f"WHEN value IS NULL THEN NULL ELSE '' END AS value "
        f"FROM ({CORE}) WHERE key NOT IN {DATE_KEYS}"),
    "package_strip_legacy": (
        f"SELECT path, key, CASE WHEN key IN {DATE_KEYS} THEN value "
        f"WHEN key = 'revision' AND value IS NOT NULL THEN '1' "
        f"WHEN value IS NULL THEN NULL ELSE '' END AS value FROM ({CORE}) "
        f"WHERE key NOT IN {DATE_KEYS} OR path LIKE '%.xlsx'"),
    "removed_report": (
        f"SELECT path, surface, key, old_value, act2 AS action FROM "
        f"({stripped('author', 'software')}) WHERE act2 <> '' AND old_value <> ''"),
    "before_after_diff": (
        f"SELECT path, surface, key, old_value, CASE WHEN act2 <> 'drop' THEN value END AS new_value, "
        f"CASE WHEN act2 = '' THEN 'kept' ELSE 'cleared' END AS status "
        f"FROM ({stripped('author', 'geo')})"),
    "before_after_diff_tables": (
        f"SELECT path, surface, key, CASE WHEN act2 <> 'drop' THEN value END AS old_value, old_value AS new_value, "
        f"CASE WHEN act2 = 'drop' THEN 'added' WHEN act2 = '' OR coalesce(old_value, '') = '' THEN 'kept' "
        f"ELSE 'changed' END AS status FROM ({stripped('author', 'geo')})"),
    "residual_metadata": (
        f"SELECT path, surface, key, value FROM ({META}) WHERE act <> '' AND act <> 'author:blank' "
        f"AND value <> ''"),
    "uncovered_keys": (
        f"SELECT surface, key, count(*) AS n FROM ({META}) WHERE act = '' AND value <> '' "
        f"GROUP BY surface, key"),
    "body_parts": (
        f"SELECT {TURN_PATH} AS path, 'word/document.xml' AS part FROM conversations UNION ALL "
        f"SELECT path, part FROM (SELECT {TURN_PATH} AS path, unnest({OTHER_NAMES}[1:3]) AS part FROM conversations)"),
    "part_text_runs": (
        f"SELECT {TURN_PATH} AS path, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i0) - 1 AS run_no, "
        f"line AS text FROM {LINES} WHERE line <> ''"),
    "part_substitution": (
        f"SELECT path, part, CAST(ordinal AS BIGINT) AS ordinal, "
        f"CASE WHEN part = 'word/header1.xml' THEN 'new' ELSE role END AS content FROM ("
        f"SELECT {TURN_PATH} AS path, role, unnest({OTHER_NAMES}) AS part, unnest(range(1, 7)) AS ordinal FROM conversations)"),
    "scrub_comments_part": (
        f"SELECT {TURN_PATH} AS path, i0 AS id, '' AS author, '' AS initials, "
        f"'1970-01-01T00:00:00Z' AS date FROM {LINES}"),
    "scrub_settings_part": (
        f"SELECT {SUPPLIER_PATH} AS path, 'word/settings.xml' AS part, false AS leaks, "
        f"true AS zoom_kept, '' AS rel_ids FROM supplier UNION ALL "
        f"SELECT {SUPPLIER_PATH}, 'word/_rels/settings.xml.rels', false, false, "
        f"CASE s_suppkey % 3 WHEN 0 THEN 'rId1,rId2,rId3' WHEN 1 THEN 'rId1,rId3' ELSE 'rId1,rId2' END FROM supplier"),
    "scrub_core_part": (
        f"SELECT path, key, CASE WHEN key = 'created' THEN NULL WHEN key <> 'revision' THEN '' "
        f"WHEN value IS NULL THEN value ELSE '1' END AS value FROM ({CORE}) "
        f"WHERE key IN ('title', 'creator', 'author', 'revision', 'created')"),
    "scrub_workbook_part": (
        f"SELECT {BOOK_PATH} AS path, 'Data:-,' || p_brand || ':visible' AS sheets, "
        f"false AS has_names FROM part"),
    "content_preserved": (
        f"SELECT {TURN_PATH} AS path, sha256(coalesce(string_agg(line, chr(10) ORDER BY i0) "
        f"FILTER (WHERE line <> ''), '')) AS digest, true AS preserved FROM {LINES} GROUP BY conv_id, turn"),
    "content_preserved_hidden": (
        f"SELECT {TURN_PATH} AS path, 'word/document.xml' AS part, sha256(coalesce(string_agg(line, chr(10) ORDER BY i0) "
        f"FILTER (WHERE line <> ''), '')) AS digest, true AS preserved FROM {LINES} GROUP BY conv_id, turn"),
    "part_tokens": (
        f"SELECT {TURN_PATH} AS path, 2 * count(*) FILTER (i0 % 3 = 1) AS n_comment, count(*) FILTER (i0 % 3 = 2) AS n_cdata, "
        f"CAST(2 AS BIGINT) AS n_instruction, count(*) AS n_runs, true AS round_trip FROM {LINES} GROUP BY conv_id, turn"),
    "hidden_text_runs": (
        f"SELECT {TURN_PATH} AS path, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i0) - 1 AS run_no, "
        f"line AS text FROM {LINES} WHERE line <> ''"),
    "scrub_hidden_body": (
        f"SELECT {TURN_PATH} AS path, 'tracked_changes' AS surface, 'date' AS key, CAST(0 AS BIGINT) AS ordinal, "
        f"'1970-01-01T00:00:00Z' AS value FROM conversations"),
}

# ------------------------------------------------- strips of whole packages

PACKAGE_META = " UNION ALL ".join((
    CORE, APP, DOC_VARS, MAIL_MERGE, TEMPLATE, THREADED, PEOPLE, HIDDEN, NAMES, CONNECTIONS, PIVOT, LINKS, CUSTOM, CUSTOM_XML))


def covered(*categories: str, legacy: bool = False) -> str:
    """Condition on the rows of PACKAGE_META that these categories change."""
    of = {
        "author": (f"(surface = 'core' AND key IN {PEOPLE_KEYS}) OR surface IN ('app', 'document_variables', 'mail_merge', "
                   "'template', 'threaded_comments', 'people', 'custom_xml')"),
        "software": (f"(surface = 'core' AND key NOT IN {PEOPLE_KEYS} AND key NOT IN {DATE_KEYS}) OR surface IN "
                     "('document_variables', 'mail_merge', 'template', 'defined_names', 'connections', 'external_links')"),
        "dates": f"(surface = 'core' AND key IN {DATE_KEYS})",
    }
    some = [of[c] for c in categories] + ["surface IN ('custom_properties', 'hidden_sheets')"]
    if legacy:
        some.append(f"(surface = 'core' AND (path LIKE '%.docx' OR key NOT IN {DATE_KEYS}))")
    return "(" + " OR ".join(some) + ") AND NOT (key = 'revision' AND value = '1')"


def removed(condition: str) -> str:
    return (f"SELECT path, surface, key, value AS old_value, count(*) AS times FROM ({PACKAGE_META}) "
            f"WHERE value <> '' AND {condition} GROUP BY ALL")


ORACLES |= {
    "package_removed": removed(covered("author", "dates", "software")),
    "package_removed_dates": removed(covered("dates")),
    "package_removed_legacy": removed(covered("author", legacy=True)),
    "package_residual": (
        f"SELECT path, surface, key, value FROM ({PACKAGE_META}) WHERE value <> '' "
        f"AND {covered('author', 'dates', 'software')} AND NOT ({covered('author')})"),
}
