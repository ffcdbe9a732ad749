"""Office-package parts written from the given tables, one part per row.

A package path carries the row's key, the values inside come from its columns.  The
DuckDB side never sees XML: it reads the same columns from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.xmltext import escape
from inkveil.session import spread
from inkveil.sources import tables

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
CORE = ('xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" '
        'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" '
        'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"')


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spread(tables.read_table(spark, folder, name, *columns))


def _part(df: DataFrame, path: str, part: str, xml: str) -> DataFrame:
    """``path`` and ``xml`` are SQL expressions; ``$name`` columns are pre-escaped."""
    return df.select(
        F.expr(path).alias("path"), F.lit(part).alias("part"), F.lit(0).alias("ordinal"),
        F.expr(xml).alias("xml"), F.lit(None).cast("string").alias("error"),
    ).select("path", F.element_at(F.split("path", "[.]"), -1).alias("kind"),
             "part", "ordinal", "xml", "error")


def core(spark: SparkSession, folder: str) -> DataFrame:
    """docProps/core.xml of a text document (even keys) or a workbook (odd keys)."""
    df = read_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                    "o_orderpriority", "o_orderstatus")
    xml = (
        f"concat('{HEAD}<cp:coreProperties {CORE}>', "
        "'<dc:title>Order ', o_orderkey, ' &amp; more</dc:title>', "
        "'<dc:creator>', o_orderpriority, '</dc:creator>', "
        "'<cp:lastModifiedBy>user', o_custkey, '</cp:lastModifiedBy>', "
        "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('<cp:revision>', 1 + o_orderkey % 9, '</cp:revision>') END, "
        "'<cp:category/>', "
        "CASE WHEN o_orderstatus = 'P' THEN '' ELSE concat("
        "'<dcterms:created xsi:type=\"dcterms:W3CDTF\">', "
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '</dcterms:created>') END, "
        "'</cp:coreProperties>')"
    )
    path = "concat('order-', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '.docx' ELSE '.xlsx' END)"
    return _part(df, path, "docProps/core.xml", xml)


def app(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    xml = (
        f"concat('{HEAD}<Properties xmlns=\"http://schemas.openxmlformats.org/officeDocument/2006/extended-properties\">', "
        "'<Application>Writer</Application><Company>', c_mktsegment, ' &amp; Sons</Company>', "
        "CASE WHEN c_custkey % 3 = 0 THEN concat('<Manager>', c_name, '</Manager>') "
        "WHEN c_custkey % 3 = 1 THEN '<Manager/>' ELSE '' END, '</Properties>')"
    )
    return _part(df, "concat('customer-', c_custkey, '.docx')", "docProps/app.xml", xml)


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return df.withColumn("lines", F.split(escape(F.col("text")), "\n", -1))


TURN_PATH = "concat('turn-', conv_id, '-', turn, '.docx')"


def comments(spark: SparkSession, folder: str) -> DataFrame:
    """One comment per line of a turn; every third has no author."""
    xml = (
        f"concat('{HEAD}<w:comments {W}>', array_join(transform(lines, (l, i) -> concat("
        "'<w:comment w:id=\"', i, '\" w:author=\"', "
        "CASE WHEN i % 3 = 2 THEN '' ELSE concat(role, ' ', i % 2) END, "
        "'\" w:date=\"2024-01-0', 1 + i % 9, 'T00:00:00Z\" w:initials=\"', upper(left(role, 1)), '\">"
        "<w:p><w:r><w:t xml:space=\"preserve\">', l, '</w:t></w:r></w:p></w:comment>')), ''), '</w:comments>')"
    )
    return _part(_turns(spark, folder), TURN_PATH, "word/comments.xml", xml)


def body(spark: SparkSession, folder: str) -> DataFrame:
    """The turn as document body: a paragraph per line, tracked changes by its role."""
    xml = (
        f"concat('{HEAD}<w:document {W}><w:body>', array_join(transform(lines, (l, i) -> concat("
        "'<w:p><w:', element_at(array('ins', 'del', 'moveTo'), 1 + i % 3), "
        "' w:id=\"', i, '\" w:author=\"', role, ' ', i % 5, '\" w:date=\"2024-02-0', 1 + i % 3, 'T08:00:00Z\">"
        "<w:r><w:t xml:space=\"preserve\">', l, '</w:t></w:r></w:', "
        "element_at(array('ins', 'del', 'moveTo'), 1 + i % 3), '></w:p>')), ''), "
        "'</w:body></w:document>')"
    )
    return _part(_turns(spark, folder), TURN_PATH, "word/document.xml", xml)


def hiding_body(spark: SparkSession, folder: str) -> DataFrame:
    """The turn as body again, with comments, a section and an instruction that hold markup.

    A line is a plain run in a tracked change, a run between two comments that hold the marks of a
    section, or a section of its own; an instruction and a comment hold a text element each.
    """
    df = _turns(spark, folder).withColumn("raw", F.split("text", "\n", -1))
    xml = (
        f"concat('{HEAD}<w:document {W}><w:body><?mark <w:t>no</w:t> ?>', array_join(transform(lines, (l, i) -> CASE i % 3 "
        "WHEN 0 THEN concat('<w:p><w:ins w:id=\"', i, '\" w:author=\"', role, '\" w:date=\"2024-02-01T08:00:00Z\">"
        "<w:r><w:t xml:space=\"preserve\">', l, '</w:t></w:r></w:ins></w:p>') "
        "WHEN 1 THEN concat('<w:p><!-- <![CDATA[ --><w:r><w:t>', l, '</w:t></w:r><!-- ]]> <w:t>no</w:t> --></w:p>') "
        "ELSE concat('<w:p><w:r><w:t><![CDATA[', raw[i], ']]></w:t></w:r></w:p>') END), ''), '</w:body></w:document>')"
    )
    return _part(df, TURN_PATH, "word/document.xml", xml)


def other_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of other names next to the body: header, footer, chart, style, media list."""
    df = _turns(spark, folder)
    names = ["word/header1.xml", "word/footer12.xml", "word/charts/chart1.xml",
             "word/styles.xml", "customXml/item1.xml", "docs/word/document.xml"]
    xml = f"concat('<w:hdr {W}><w:t>', role, '</w:t></w:hdr>')"
    out = None
    for i, name in enumerate(names):
        p = _part(df, TURN_PATH, name, xml).withColumn("ordinal", F.lit(i + 1))
        out = p if out is None else out.unionByName(p)
    return out


SUPPLIER_PATH = "concat('supplier-', s_suppkey, '.docx')"


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "supplier", "s_suppkey", "s_name", "s_nationkey")


def settings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings and their relationships; every third package has no template."""
    df = _suppliers(spark, folder)
    settings_xml = (
        f"concat('{HEAD}<w:settings {W} {R}>', "
        "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('<w:attachedTemplate r:id=\"rId', 1 + s_suppkey % 3, '\"/>') END, "
        "'<w:zoom w:percent=\"100\"/><w:docVars><w:docVar w:name=\"owner\" w:val=\"', s_name, '\"/>"
        "<w:docVar w:name=\"flag\"/><w:docVar w:name=\"nation\" w:val=\"', s_nationkey, '\"/>"
        "<w:docVar w:name=\"\" w:val=\"lost\"/></w:docVars>', "
        "CASE WHEN s_suppkey % 2 = 0 THEN concat('<w:mailMerge><w:dataSource><w:fileName>\\\\\\\\srv\\\\', s_name, "
        "'.csv</w:fileName></w:dataSource><w:headerSource><w:fileName>head-', s_suppkey, "
        "'.csv</w:fileName></w:headerSource></w:mailMerge>') ELSE '' END, '</w:settings>')"
    )
    rels_xml = (
        f"concat('{HEAD}<Relationships {RELS}>', array_join(transform(sequence(1, 3), i -> concat("
        "'<Relationship Id=\"rId', i, '\" Type=\"t', i, '\" Target=\"file:///C:/users/', s_name, '/letter', i, '.dotx\" TargetMode=\"External\"/>')), ''), "
        "'</Relationships>')"
    )
    return _part(df, SUPPLIER_PATH, "word/settings.xml", settings_xml).unionByName(
        _part(df, SUPPLIER_PATH, "word/_rels/settings.xml.rels", rels_xml))


CUSTOMER_PATH = "concat('people-', c_custkey, '.docx')"


def people(spark: SparkSession, folder: str) -> DataFrame:
    """People list and two parts of threaded comments that share one author."""
    df = read_table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    people_xml = (
        f"concat('<w:people {W} {R}><w:person w:name=\"', c_name, '\" r:id=\"P', c_custkey, '\"/>"
        "<w:person w:name=\"', c_mktsegment, '\"/></w:people>')"
    )
    out = _part(df, CUSTOMER_PATH, "word/people.xml", people_xml)
    for n, who in ((1, "c_mktsegment"), (2, "concat('Z', c_custkey)")):
        xml = (
            f"concat('<tc:list xmlns:tc=\"urn:tc\" {W}><tc:c w:author=\"', c_name, '\" provisionId=\"p{n}-', c_custkey, '\"/>"
            f"<tc:c w:author=\"', {who}, '\"/></tc:list>')"
        )
        out = out.unionByName(_part(df, CUSTOMER_PATH, f"word/threadedComments/t{n}.xml", xml))
    return out


BOOK_PATH = "concat('book-', p_partkey, '.xlsx')"


def _books(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")


def workbook(spark: SparkSession, folder: str) -> DataFrame:
    xml = (
        f"concat('{HEAD}<workbook {MAIN}><sheets><sheet name=\"Data\" sheetId=\"1\"/>"
        "<sheet name=\"', p_brand, '\" sheetId=\"2\" state=\"', "
        "element_at(array('hidden', 'visible', 'veryHidden'), CAST(1 + p_partkey % 3 AS INT)), '\"/></sheets>"
        "<definedNames><definedName name=\"Area_', p_size, '\"> Data!$A$', p_size, ' </definedName>"
        "<definedName name=\"Empty\"/></definedNames></workbook>')"
    )
    return _part(_books(spark, folder), BOOK_PATH, "xl/workbook.xml", xml)


def book_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Connections, pivot cache, external link with its relationships, custom properties."""
    df = _books(spark, folder)
    connections = (
        f"concat('<connections {MAIN}><connection id=\"1\" name=\"', p_name, '\"><dbPr connection=\"Provider=X;User=', p_brand, '\"/></connection>"
        "<connection id=\"2\"/></connections>')"
    )
    pivot = (
        f"concat('<pivotCacheDefinition {MAIN}><cacheSource type=\"worksheet\"><worksheetSource sheet=\"', p_type, '\" ', "
        "CASE p_partkey % 3 WHEN 0 THEN concat('ref=\"A1:B', p_size, '\"') WHEN 1 THEN 'name=\"Table1\"' ELSE '' END, "
        "'/></cacheSource></pivotCacheDefinition>')"
    )
    link = f"concat('<externalLink {MAIN}><externalBook/></externalLink>')"
    link_rels = (
        f"concat('<Relationships {RELS}><Relationship Id=\"rId1\" Target=\"file:///srv/', p_brand, '.xlsx\"/>"
        "<Relationship Id=\"rId2\" Target=\"\"/></Relationships>')"
    )
    custom = (
        "concat('<Properties xmlns=\"urn:p\" xmlns:vt=\"urn:vt\"><property fmtid=\"f\" pid=\"2\" name=\"Client\"><vt:lpwstr>', p_name, "
        "'</vt:lpwstr></property><property fmtid=\"f\" pid=\"3\" name=\"Size\"><vt:i4>', p_size, '</vt:i4></property></Properties>')"
    )
    out = _part(df, BOOK_PATH, "xl/connections.xml", connections)
    for name, xml in (
        ("xl/pivotCache/pivotCacheDefinition1.xml", pivot),
        ("xl/externalLinks/externalLink1.xml", link),
        ("xl/externalLinks/_rels/externalLink1.xml.rels", link_rels),
        ("docProps/custom.xml", custom),
        ("customXML/item2.xml", "concat('<root a=\"1\"><x>', p_name, '</x></root>')"),
        ("customXml/item1.xml", "concat('<root><x>', p_name, '</x></root>')"),
    ):
        out = out.unionByName(_part(df, BOOK_PATH, name, xml))
    return out
