"""Queries over metadata: inventory, strip, reports, part edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.functions import xmltokens as T
from inkveil.operators import metadata, parts as PT, policy as PO, records
from inkveil.plans.policies import DEFAULT_POLICY, PolicyRow, legacy_gate
from inkveil.session import spread
from inkveil.sources.tables import read_table
from workload import planted_parts as PP


def _meta(parts: DataFrame, *surfaces: str) -> DataFrame:
    return metadata.inventory(metadata.check_parts(parts), surfaces).select(
        "path", "surface", "key", F.col("ordinal").cast("bigint").alias("ordinal"), "value")


# --------------------------------------------------------------- inventory

def meta_core_props(spark, folder):
    return _meta(PP.core(spark, folder), "core")


def meta_app_fields(spark, folder):
    return _meta(PP.app(spark, folder), "app")


def meta_comment_authors(spark, folder):
    return _meta(PP.comments(spark, folder), "comments").filter("key = 'author'")


def comment_author_list(spark, folder):
    """Authors of a part with duplicates, document order, as one display line."""
    return metadata.author_list(metadata.check_parts(PP.comments(spark, folder))).select("path", "authors")


def meta_tracked_changes(spark, folder):
    return _meta(PP.body(spark, folder), "tracked_changes")


def distinct_authors(spark, folder):
    """Distinct tracked-change authors of the whole corpus with their package counts."""
    meta = metadata.inventory(
        metadata.check_parts(PP.body(spark, folder)), ["tracked_changes"])
    return meta.filter("key = 'author'").groupBy("value").agg(F.count("*").alias("packages"))


def meta_template_path(spark, folder):
    return _meta(PP.settings(spark, folder), "template")


def meta_doc_vars(spark, folder):
    return _meta(PP.settings(spark, folder), "document_variables")


def meta_mail_merge(spark, folder):
    return _meta(PP.settings(spark, folder), "mail_merge")


def meta_threaded(spark, folder):
    return _meta(PP.people(spark, folder), "threaded_comments")


def meta_people(spark, folder):
    return _meta(PP.people(spark, folder), "people")


def meta_hidden_sheets(spark, folder):
    return _meta(PP.workbook(spark, folder), "hidden_sheets")


def meta_defined_names(spark, folder):
    return _meta(PP.workbook(spark, folder), "defined_names")


def meta_connections(spark, folder):
    return _meta(PP.book_parts(spark, folder), "connections")


def meta_pivot_sources(spark, folder):
    return _meta(PP.book_parts(spark, folder), "pivot_sources")


def meta_external_links(spark, folder):
    return _meta(PP.book_parts(spark, folder), "external_links")


def meta_custom_properties(spark, folder):
    return _meta(PP.book_parts(spark, folder), "custom_properties")


def meta_custom_parts(spark, folder):
    return _meta(PP.book_parts(spark, folder), "custom_xml")


def _all_parts(spark, folder) -> DataFrame:
    out = None
    for build in (PP.core, PP.app, PP.settings, PP.people, PP.workbook, PP.book_parts, PP.comments):
        p = build(spark, folder)
        out = p if out is None else out.unionByName(p)
    return out


def meta_inventory(spark, folder):
    """All surfaces of all packages: rows and distinct values per surface and key."""
    meta = metadata.inventory(metadata.check_parts(_all_parts(spark, folder)), settle=True)
    return meta.groupBy("kind", "surface").agg(
        F.count("*").alias("n"), F.count_distinct("path").alias("packages"),
        F.count("value").alias("with_value"))


def meta_unpivot(spark, folder):
    return TABLE_META(spark, folder).select("path", "surface", "key", "value", "value_type")


# ------------------------------------- records of PDF and image extractors

def _pdf_rows(spark, folder) -> DataFrame:
    """What a PDF extractor returns, one record per order."""
    df = read_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                    "o_orderpriority", "o_orderstatus")
    return records.pdf_records(df.selectExpr(
        "concat('order-', o_orderkey, '.pdf') AS path",
        "concat('user', o_custkey) AS Author", "o_orderpriority AS Title",
        "CAST(NULL AS STRING) AS Subject", "'Writer' AS Creator", "'' AS Producer",
        "o_orderstatus AS Keywords", "date_format(o_orderdate, 'yyyyMMdd') AS CreationDate",
        "CAST(NULL AS STRING) AS ModDate", "o_orderkey % 2 = 0 AS has_xmp",
        "o_orderkey % 3 = 0 AS acroform", "false AS has_embedded_files",
        "array(concat('user', o_custkey), 'Zoe', 'Ann', 'Zoe') AS annotation_authors"))


def _image_rows(spark, folder) -> DataFrame:
    """Raw tags of an image reader, one record per customer."""
    df = read_table(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return records.image_records(df.selectExpr(
        "concat('image-', c_custkey, '.jpg') AS path",
        "map('Artist', c_name, 'GPSInfo', CAST(c_nationkey AS STRING), 'Orientation', '1') AS exif",
        "map('Author', c_name, 'gamma', '0.45') AS info",
        "map('2#080', c_name, '2#999', c_mktsegment) AS iptc",
        "CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS icc_bytes",
        "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS comment"))


def meta_pdf_records(spark, folder):
    return _pdf_rows(spark, folder).select(
        "path", "surface", "key", F.col("ordinal").cast("bigint").alias("ordinal"), "value")


def meta_image_records(spark, folder):
    return _image_rows(spark, folder).select("path", "surface", "key", "value")


def record_strip(spark, folder):
    """Default policy over PDF and image records, author only."""
    meta = _pdf_rows(spark, folder).unionByName(_image_rows(spark, folder))
    pol = PO.policy_frame(spark, DEFAULT_POLICY, ["author"])
    return PO.strip(meta, pol).select("path", "surface", "key", "value")


# ------------------------------------------------- the same over plain tables

def TABLE_META(spark, folder) -> DataFrame:
    """Columns of ordinary tables as metadata rows."""
    customer = read_table(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    orders = read_table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    events = read_table(spark, folder, "events", "event_id", "ts", "props")

    def path(prefix, key):
        return F.concat(F.lit(prefix + "/"), F.col(key).cast("string"))

    return (
        metadata.records_to_meta(customer, path("customer", "c_custkey"), "table", "customer",
                                 ["c_name", "c_nationkey", "c_mktsegment"])
        .unionByName(metadata.records_to_meta(
            orders, path("orders", "o_orderkey"), "table", "orders", ["o_orderdate", "o_orderpriority"]))
        .unionByName(metadata.records_to_meta(
            events, path("events", "event_id"), "table", "events", ["ts", "props"]))
    )


TABLE_POLICY = (
    PolicyRow("table", "customer", "c_name", ("author",), "blank"),
    PolicyRow("table", "customer", "c_nationkey", ("geo",), "drop"),
    PolicyRow("table", "orders", "o_orderdate", ("dates",), "drop"),
    PolicyRow("table", "events", "ts", ("dates",), "epoch"),
    PolicyRow("table", "events", "props", ("software",), "blank"),
)


def _policy(spark, *categories: str) -> DataFrame:
    return PO.policy_frame(spark, TABLE_POLICY, categories or C.CATEGORIES)


def _strip(*categories: str):
    def query(spark, folder):
        return PO.strip(TABLE_META(spark, folder), _policy(spark, *categories)).select(
            "path", "surface", "key", "value")
    return query


def policy_strip_salted(spark, folder):
    """The path for a policy too large to broadcast: salted shuffle join, same rows."""
    return PO.strip(TABLE_META(spark, folder), _policy(spark), max_rows=0).select(
        "path", "surface", "key", "value")


def removed_report(spark, folder):
    planned = PO.plan_strip(TABLE_META(spark, folder), _policy(spark, "author", "software"))
    return PO.removed_report(planned).select("path", "surface", "key", "old_value", "action")


def before_after_diff(spark, folder):
    planned = PO.plan_strip(TABLE_META(spark, folder), _policy(spark, "author", "geo"))
    return PO.diff_planned(planned).select("path", "surface", "key", "old_value", "new_value", "status")


def before_after_diff_tables(spark, folder):
    """Two tables that know nothing of each other: the stripped one first, so that dropped rows come back as added."""
    whole = TABLE_META(spark, folder)
    stripped = PO.strip(whole, _policy(spark, "author", "geo"))
    return PO.diff(stripped, whole).select("path", "surface", "key", "old_value", "new_value", "status")


def policy_strip_skewed(spark, folder):
    """One key holds over a third of all rows; joined by shuffle with salts for hot keys only."""
    lines = read_table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    path = F.concat_ws("/", F.lit("lineitem"), F.col("l_orderkey"), F.col("l_linenumber"))
    meta = TABLE_META(spark, folder).unionByName(
        metadata.records_to_meta(lines, path, "table", "lineitem", ["l_returnflag"]))
    rows = (*TABLE_POLICY, PolicyRow("table", "lineitem", "l_returnflag", ("software",), "blank"))
    return PO.strip(meta, PO.policy_frame(spark, rows), max_rows=0).select("path", "surface", "key", "value")


def residual_metadata(spark, folder):
    """Stripped by author only, audited by the whole policy."""
    after = PO.strip(TABLE_META(spark, folder), _policy(spark, "author"))
    return PO.residual_metadata(after, _policy(spark)).select("path", "surface", "key", "value")


def uncovered_keys(spark, folder):
    return PO.uncovered_keys(TABLE_META(spark, folder), _policy(spark)).select("surface", "key", "n")


def package_strip(spark, folder):
    """Default policy over package metadata (core properties), dates and software only."""
    meta = metadata.inventory(metadata.check_parts(PP.core(spark, folder)), ["core"])
    pol = PO.policy_frame(spark, DEFAULT_POLICY, ["dates", "software"])
    return PO.strip(meta, pol).select("path", "key", "value")


def package_strip_legacy(spark, folder):
    """The same fields under the gate that clears core properties as a whole."""
    meta = metadata.inventory(metadata.check_parts(PP.core(spark, folder)), ["core"])
    pol = PO.policy_frame(spark, legacy_gate(), ["author"])
    return PO.strip(meta, pol).select("path", "key", "value")


# --------------------------------------------------------------- part edits

def body_parts(spark, folder):
    every = PP.body(spark, folder).unionByName(PP.other_parts(spark, folder))
    return PT.body_parts(every).select("path", "part")


def part_text_runs(spark, folder):
    parts = metadata.check_parts(PP.body(spark, folder))
    return PT.text_runs(parts).select(
        "path", F.col("run_no").cast("bigint").alias("run_no"), "text")


def part_substitution(spark, folder):
    """Headers get new text, all other parts pass through."""
    every = PP.other_parts(spark, folder)
    new = every.filter("part = 'word/header1.xml'").select(
        "path", "part", F.lit("<w:hdr/>").alias("xml"))
    return PT.substitute(every, new).select(
        "path", "part", F.col("ordinal").cast("bigint").alias("ordinal"),
        F.expr("CASE WHEN xml = '<w:hdr/>' THEN 'new' "
               "ELSE regexp_extract(xml, '<w:t>([^<]*)</w:t>', 1) END").alias("content"))


def scrub_comments_part(spark, folder):
    """Comment attributes read back after the part text was scrubbed."""
    parts = PT.scrub(metadata.check_parts(PP.comments(spark, folder)), ["author"])
    x = F.from_xml("xml", "comment array<struct<_id:bigint,_author:string,_initials:string,_date:string>>",
                   {"ignoreNamespace": "true"})
    return parts.select("path", F.inline(x["comment"])).select(
        "path", F.col("_id").alias("id"), F.col("_author").alias("author"),
        F.col("_initials").alias("initials"), F.col("_date").alias("date"))


def scrub_settings_part(spark, folder):
    """Template, variables and mail merge gone; template relationship gone; rest kept."""
    parts = PT.scrub(metadata.check_parts(PP.settings(spark, folder)), ["software"])
    return parts.select(
        "path", "part",
        F.col("xml").rlike("attachedTemplate|docVar|mailMerge").alias("leaks"),
        F.col("xml").contains('<w:zoom w:percent="100"/>').alias("zoom_kept"),
        F.array_join(F.regexp_extract_all("xml", F.lit(r'Id="(rId\d)"'), F.lit(1)), ",").alias("rel_ids"))


def scrub_core_part(spark, folder):
    """Core properties read back after an all-category scrub of the part text."""
    parts = PT.scrub(metadata.check_parts(PP.core(spark, folder)))
    return metadata.inventory(parts, ["core"]).filter(
        "key IN ('title', 'creator', 'author', 'revision', 'created')").select("path", "key", "value")


def scrub_workbook_part(spark, folder):
    """Sheet states and defined names read back after the scrub."""
    parts = PT.scrub(metadata.check_parts(PP.workbook(spark, folder)))
    x = F.from_xml("xml", "sheets struct<sheet:array<struct<_name:string,_state:string>>>, "
                   "definedNames string", {"ignoreNamespace": "true"})
    return parts.select("path", x.alias("x")).select(
        "path", F.array_join(F.expr("transform(x.sheets.sheet, s -> concat(s._name, ':', coalesce(s._state, '-')))"), ",").alias("sheets"),
        F.col("x.definedNames").isNotNull().alias("has_names"))


def content_preserved(spark, folder):
    """Body text hashed before and after the strip of the same part."""
    parts = metadata.check_parts(PP.body(spark, folder))
    return PT.content_preserved(parts, PT.scrub(parts)).select("path", "digest", "preserved")


def content_preserved_hidden(spark, folder):
    """The same for parts whose comments, sections and instructions hold markup."""
    parts = metadata.check_parts(PP.hiding_body(spark, folder))
    return PT.content_preserved(parts, PT.scrub(parts))


def part_tokens(spark, folder):
    """Tokens of these parts by kind, and whether they join to the part again."""
    parts = metadata.check_parts(PP.hiding_body(spark, folder))
    kinds = ("comment", "cdata", "instruction")
    counts = PT.part_tokens(parts).groupBy("path").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds),
        F.count(F.when((F.col("kind") == "open") & (F.col("name") == "t"), 1)).alias("n_runs"))
    again = parts.select("path", (F.array_join(T.tokens(F.col("xml")), "") == F.col("xml")).alias("round_trip"))
    return counts.join(again, "path")


def hidden_text_runs(spark, folder):
    parts = metadata.check_parts(PP.hiding_body(spark, folder))
    return PT.text_runs(parts).select("path", F.col("run_no").cast("bigint").alias("run_no"), "text")


def scrub_hidden_body(spark, folder):
    """Tracked changes read back after a strip by author."""
    return _meta(PT.scrub(metadata.check_parts(PP.hiding_body(spark, folder)), ["author"]), "tracked_changes")


QUERIES = {
    "meta_core_props": meta_core_props,
    "meta_app_fields": meta_app_fields,
    "meta_comment_authors": meta_comment_authors,
    "comment_author_list": comment_author_list,
    "meta_tracked_changes": meta_tracked_changes,
    "distinct_authors": distinct_authors,
    "meta_template_path": meta_template_path,
    "meta_doc_vars": meta_doc_vars,
    "meta_mail_merge": meta_mail_merge,
    "meta_threaded": meta_threaded,
    "meta_people": meta_people,
    "meta_hidden_sheets": meta_hidden_sheets,
    "meta_defined_names": meta_defined_names,
    "meta_connections": meta_connections,
    "meta_pivot_sources": meta_pivot_sources,
    "meta_external_links": meta_external_links,
    "meta_custom_properties": meta_custom_properties,
    "meta_custom_parts": meta_custom_parts,
    "meta_inventory": meta_inventory,
    "meta_unpivot": meta_unpivot,
    "meta_pdf_records": meta_pdf_records,
    "meta_image_records": meta_image_records,
    "record_strip": record_strip,
    "policy_strip": _strip(),
    "policy_strip_author_only": _strip("author"),
    "policy_strip_dates_only": _strip("dates"),
    "policy_strip_salted": policy_strip_salted,
    "package_strip": package_strip,
    "package_strip_legacy": package_strip_legacy,
    "removed_report": removed_report,
    "before_after_diff": before_after_diff,
    "before_after_diff_tables": before_after_diff_tables,
    "policy_strip_skewed": policy_strip_skewed,
    "residual_metadata": residual_metadata,
    "uncovered_keys": uncovered_keys,
    "body_parts": body_parts,
    "part_text_runs": part_text_runs,
    "part_substitution": part_substitution,
    "scrub_comments_part": scrub_comments_part,
    "scrub_settings_part": scrub_settings_part,
    "scrub_core_part": scrub_core_part,
    "scrub_workbook_part": scrub_workbook_part,
    "content_preserved": content_preserved,
    "content_preserved_hidden": content_preserved_hidden,
    "part_tokens": part_tokens,
    "hidden_text_runs": hidden_text_runs,
    "scrub_hidden_body": scrub_hidden_body,
}
