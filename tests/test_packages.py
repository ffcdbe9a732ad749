"""Office packages written with the standard library, read back as tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkveil.config import AnonymiseConfig, rule_set
from inkveil.functions.crypto import key_frame
from inkveil.functions import xmltext as X
from inkveil.operators import metadata, parts as PT, policy as PO
from inkveil.plans.batch import anonymise_files, anonymise_packages, decrypt_body, edit_body
from inkveil.plans.policies import legacy_gate
from inkveil.sources import files, packages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
CORE = (
    '<cp:coreProperties xmlns:cp="urn:cp" xmlns:dc="urn:dc" xmlns:dcterms="urn:dt" xmlns:xsi="urn:x">'
    "<dc:title>Draft plan</dc:title><dc:creator>Ann Lee</dc:creator><dc:subject>Policy</dc:subject>"
    "<cp:category>Internal</cp:category><cp:lastModifiedBy>alee_ws</cp:lastModifiedBy><cp:revision>4</cp:revision>"
    '<dcterms:created xsi:type="dcterms:W3CDTF">2024-05-06T07:08:09Z</dcterms:created>'
    '<dcterms:modified xsi:type="dcterms:W3CDTF">2024-06</dcterms:modified></cp:coreProperties>'
)
DOCUMENT = (
    f"<?xml version='1.0'?><w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val=\"Heading1\"/></w:pPr>"
    "<w:ins w:id='1' w:author='Ann Lee' w:date='2024-01-01T00:00:00Z'><w:r><w:t>Mail ann@example.org</w:t></w:r></w:ins>"
    '<w:del w:author="Bob &amp; Co" w:id="2"><w:r><w:t xml:space="preserve"> it&apos;s &lt;10.0.0.1&gt; </w:t></w:r></w:del>'
    "<w:r><w:t>split a@b</w:t></w:r><w:r><w:t>.com</w:t></w:r><w:r><w:t/></w:r>"
    "<w:r><w:t><![CDATA[raw <c@d.org>]]></w:t></w:r></w:p></w:body></w:document>"
)
SETTINGS = (
    f'<w:settings {W} {R}><w:attachedTemplate r:id="rId7"/><w:docVars><w:docVar w:name="a" w:val="1"/>'
    '<w:docVar w:name="b"/><w:docVar w:val="x"/><w:docVar w:name="a" w:val="2"/></w:docVars>'
    "<w:mailMerge><w:dataSource><w:fileName>list.csv</w:fileName></w:dataSource></w:mailMerge><w:zoom w:percent='90'/></w:settings>"
)
RELS = (
    '<Relationships xmlns="urn:rels"><Relationship Id="rId1" Target="x.xml"/>'
    "<Relationship Target='file:///srv/letterhead.dotx' Id='rId7' TargetMode='External'/></Relationships>"
)
COMMENTS = (
    f'<w:comments {W}><w:comment w:id="0" w:author="Jane K." w:initials="JK" w:date="2024-02-02T00:00:00Z">'
    "<w:p><w:r><w:t>fine</w:t></w:r></w:p></w:comment><w:comment w:id=\"1\" w:author=\"\"/></w:comments>"
)
DOCX = {
    "[Content_Types].xml": "<Types/>", "docProps/core.xml": CORE,
    "docProps/app.xml": '<Properties xmlns="urn:p"><Company>Acme</Company><Manager>Max</Manager></Properties>',
    "word/document.xml": DOCUMENT, "word/comments.xml": COMMENTS, "word/settings.xml": SETTINGS,
    "word/_rels/settings.xml.rels": RELS,
    "word/people.xml": f'<w:people {W} {R}><w:person w:name="Ann Lee" r:id="S::ann"/></w:people>',
    "word/threadedComments/t1.xml": f'<l {W}><c w:author="Zoe" provisionId="p1"/><c w:author="Ann"/></l>',
    "word/threadedComments/t2.xml": f'<l {W}><c w:author="Ann"/></l>',
    "word/header1.xml": f"<w:hdr {W}><w:r><w:t>Tel 12345678</w:t></w:r></w:hdr>",
    "customXml/item1.xml": '<root a="1"><secret>v</secret></root>',
    "word/media/image1.png": b"\x89PNG\x00\xff",
}
XLSX = {
    "docProps/core.xml": CORE,
    "docProps/custom.xml": '<Properties xmlns:vt="urn:vt"><property name="Client" pid="2"><vt:lpwstr>Acme</vt:lpwstr></property></Properties>',
    "xl/workbook.xml": '<workbook><sheets><sheet name="S1" sheetId="1"/><sheet name="Hid" sheetId="2" state="veryHidden"/></sheets>'
                       '<definedNames><definedName name="N"> S1!$A$1 </definedName></definedNames></workbook>',
    "xl/connections.xml": '<connections><connection id="1" name="db" description="d"><dbPr connection="Server=x"/></connection></connections>',
    "xl/pivotCache/p1.xml": '<p><cacheSource><worksheetSource sheet="S1" name="T"/></cacheSource></p>',
    "xl/externalLinks/externalLink1.xml": "<externalLink/>",
    "xl/externalLinks/_rels/externalLink1.xml.rels": '<Relationships><Relationship Id="r" Target="//srv/b.xlsx"/></Relationships>',
    "xl/people.xml": '<people xmlns:m="urn:m"><person m:name="Ann Lee"/></people>',
    "xl/threadedComments/t1.xml": '<l xmlns:m="urn:m"><c m:author="Zoe"/></l>',
    "xl/sharedStrings.xml": "<sst><si><t>call 12345678</t></si></sst>",
}


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    good = _zip(DOCX)
    (root / "good.docx").write_bytes(good)
    (root / "sub" / "book.XLSX").write_bytes(_zip(XLSX))
    (root / "plain.docx").write_bytes(_zip({"word/document.xml": f"<w:document {W}/>"}))
    (root / "notzip.docx").write_bytes(b"this is not a zip")
    (root / "cut.docx").write_bytes(good[: len(good) // 2])
    (root / "badxml.docx").write_bytes(_zip({**DOCX, "word/document.xml": "<w:document><w:body>"}))
    (root / "doctype.docx").write_bytes(_zip(
        {**DOCX, "word/comments.xml": '<!DOCTYPE x [<!ENTITY e "boom">]><x>&e;</x>'}))
    (root / "big.docx").write_bytes(_zip({**DOCX, "word/media/huge.bin": b"0" * 200_000}))
    (root / "noext").write_bytes(b"%PDF-1.7")
    (root / "pack").write_bytes(good)
    (root / "note.txt").write_bytes(b"hello")
    return str(root)


CAPS = packages.Caps(entry_bytes=100_000, package_bytes=1_000_000, entries=100, flush_bytes=1_000)


@pytest.fixture(scope="module")
def parts(spark, folder, tmp_path_factory):
    found = files.binary_files(spark, folder)
    checked = metadata.check_parts(packages.unzip_parts(found, CAPS))
    out = str(tmp_path_factory.mktemp("parts") / "table")
    checked.withColumn("path", F.regexp_extract("path", "([^/]+)$", 1)).write.parquet(out)
    return spark.read.parquet(out)


def _values(meta, path, surface, key=None):
    rows = meta.filter((F.col("path") == path) & (F.col("surface") == surface))
    rows = rows.filter(F.col("key") == key) if key else rows
    return [(r.key, r.value) for r in rows.orderBy("ordinal", "key").collect()]


def test_inventory_of_files(spark, folder):
    every = files.binary_files(spark, folder, supported_only=False)
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in every.select(
        "path", files.file_kind(F.col("path"), F.col("content")).alias("kind")).collect()}
    assert kinds["noext"] == "pdf" and kinds["pack"] == "docx" and kinds["note.txt"] is None
    assert kinds["book.XLSX"] == "xlsx" and kinds["notzip.docx"] == "docx"
    assert files.binary_files(spark, folder).count() == 8


def test_any_mix_of_kinds(spark, folder):
    """One run over packages, PDF files, images, unknown and broken files: every file has its own record."""
    found = files.binary_files(spark, folder, supported_only=False).withColumn(
        "path", F.regexp_extract("path", "([^/]+)$", 1)).select("path", "content")
    more = spark.createDataFrame(
        [("a.png", b"\x89PNG"), ("empty.docx", b"PK\x05\x06" + bytes(18)), ("none.docx", None), ("b.pdf", b"%PDF-1.4")],
        "path string, content binary")
    columns = "path string, kind string, surface string, key string, ordinal int, value string, value_type string"
    read = spark.createDataFrame([
        ("noext", "pdf", "info", "Author", 0, "Ann", "string"), ("noext", "pdf", "info", "Title", 0, "", "string"),
        ("noext", "pdf", "form", "acroform", 0, "true", "boolean"), ("a.png", "image", "exif", "Artist", 0, "Bo", "string"),
        ("elsewhere.pdf", "pdf", "info", "Author", 0, "Cy", "string"),
    ], columns)
    texts = spark.createDataFrame(
        [("noext", "mail a@b.co"), ("noext", None), ("a.png", "mail a@b.co"), ("elsewhere.pdf", "x@y.zz")],
        "path string, text string")
    config = AnonymiseConfig(rules=rule_set())
    run = anonymise_files(found.unionByName(more), config, records=read, texts=texts, caps=CAPS)
    got = {r.path: r for r in run.report.collect()}
    assert len(got) == 15 and "elsewhere.pdf" not in got
    pdf, png = got["noext"], got["a.png"]
    assert pdf.success and pdf.kind == "pdf" and pdf.output_path == "noext_cleaned" and pdf.text_status == "redacted"
    assert (pdf.before, pdf.removed, pdf.after) == ({"info": 1, "form": 1}, {"info": 1}, {"form": 1})
    assert pdf.redaction == {"email": 1} and got["b.pdf"].text_status == "no_text" and got["b.pdf"].before == {}
    assert png.success and png.removed == {"exif": 1} and png.after == {} and png.redaction == {}
    assert png.text_status == "no_text_rules"
    assert got["note.txt"].error == "Unsupported file: note.txt" and got["note.txt"].kind is None
    assert "no entries" in got["empty.docx"].error and not got["none.docx"].success
    good = got["good.docx"]
    assert good.success and good.kind == "docx" and good.redaction["email"] >= 1 and good.text_status == "redacted"
    assert good.removed["comments"] == good.before["comments"] == 3 and good.after["comments"] == 1
    assert got["pack"].before == good.before and got["book.XLSX"].before["hidden_sheets"] == 1
    assert [r.before for r in got.values() if not r.success] == [None] * 8
    assert {r.text for r in run.texts.collect()} == {"mail [REDACTED]", None}
    same = {r.path: r for r in run.results.collect()}
    assert {p: r.success for p, r in same.items()} == {p: r.success for p, r in got.items()}
    # without records nothing is claimed of PDF files and images
    bare = {r.path: r for r in anonymise_files(more, config).report.collect()}
    assert bare["a.png"].error == bare["b.pdf"].error == "no metadata records given"
    empty = anonymise_files(more.limit(0), config, records=read.limit(0))
    assert empty.report.collect() == [] and empty.results.collect() == []


def test_errors_are_rows(parts):
    errors = {(r.path, r.part): r.error for r in packages.part_errors(parts).collect()}
    assert ("notzip.docx", None) in errors and ("cut.docx", None) in errors
    assert errors[("badxml.docx", "word/document.xml")] == "malformed XML"
    assert errors[("doctype.docx", "word/comments.xml")] == "document type declaration"
    assert "larger" in errors[("big.docx", "word/media/huge.bin")]
    assert {p for p, _ in errors} == {"notzip.docx", "cut.docx", "badxml.docx", "doctype.docx", "big.docx"}


def test_entry_and_package_caps(spark, folder):
    one = files.binary_files(spark, folder).filter("path LIKE '%good.docx'")
    few = packages.unzip_parts(one, packages.Caps(entries=3)).collect()
    assert len(few) == 1 and "entries" in few[0].error
    small = packages.unzip_parts(one, packages.Caps(package_bytes=600)).collect()
    assert any(r.error for r in small) and sum(len(r.xml or "") for r in small) <= 600


def test_docx_inventory(parts):
    meta = metadata.inventory(parts).cache()
    core = dict(_values(meta, "good.docx", "core"))
    assert core["author"] == "Ann Lee" and core["last_modified_by"] == "alee_ws"
    assert core["title"] == "Draft plan" and core["category"] == "Internal" and core["revision"] == "4"
    assert core["created"] == "2024-05-06T07:08:09" and core["modified"] == "2024-06-01T00:00:00"
    assert core["last_printed"] is None and core["keywords"] == "" and len(core) == 15
    assert dict(_values(meta, "good.docx", "app")) == {"company": "Acme", "manager": "Max"}
    assert _values(meta, "good.docx", "comments", "author") == [("author", "Jane K.")]
    assert [v for _, v in _values(meta, "good.docx", "tracked_changes", "author")] == ["Ann Lee", "Bob & Co"]
    assert _values(meta, "good.docx", "template") == [("template_path", "file:///srv/letterhead.dotx")]
    assert dict(_values(meta, "good.docx", "document_variables")) == {"a": "2", "b": ""}
    assert dict(_values(meta, "good.docx", "mail_merge")) == {
        "data_source": "list.csv", "header_source": None, "connect_string": None}
    assert [v for _, v in _values(meta, "good.docx", "threaded_comments", "author")] == ["Ann", "Zoe"]
    assert _values(meta, "good.docx", "people") == [("id", "S::ann"), ("name", "Ann Lee")]
    assert _values(meta, "good.docx", "custom_xml") == [("part", "customXml/item1.xml")]
    assert meta.filter("path = 'plain.docx' AND value <> ''").count() == 0
    book = {s: _values(meta, "book.XLSX", s) for s in metadata.SURFACES}
    assert dict(book["core"])["creator"] == "Ann Lee" and len(book["core"]) == 15
    assert book["hidden_sheets"] == [("sheet", "Hid")] and book["custom_properties"] == [("Client", "Acme")]
    assert book["defined_names"] == [("N", "S1!$A$1")]
    assert dict(book["connections"]) == {"name": "db", "description": "d", "connection": "Server=x"}
    assert book["pivot_sources"] == [("p1.xml", "S1!T")]
    assert book["external_links"] == [("externalLink1.xml", "//srv/b.xlsx")]
    assert book["people"] == [("name", "Ann Lee")]
    assert book["threaded_comments"] == [("author", "Zoe")]
    meta.unpersist()


def test_checkpointed_inventory_is_the_same(parts):
    a = metadata.inventory(parts, settle=True)
    b = metadata.inventory(parts)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def run(parts):
    rules = rule_set(["email", "phone", "ip"])
    return anonymise_packages(parts, AnonymiseConfig(rules=rules))


def _part(df, path, part):
    return df.filter((F.col("path") == path) & (F.col("part") == part)).first().xml


def test_body_is_redacted_in_place(run):
    xml = _part(run.parts, "good.docx", "word/document.xml")
    assert "<w:t>Mail [REDACTED]</w:t>" in xml and "ann@example.org" not in xml
    assert '<w:t xml:space="preserve"> it\'s &lt;[REDACTED]&gt; </w:t>' in xml
    assert "raw &lt;[REDACTED]&gt;" in xml and "CDATA" not in xml
    assert "<w:t>split a@b</w:t>" in xml and '<w:pStyle w:val="Heading1"/>' in xml
    assert "w:author=\"\"" in xml and "Ann Lee" not in xml and "Bob" not in xml
    assert 'w:date="1970-01-01T00:00:00Z"' in xml
    assert "Tel [REDACTED]" in _part(run.parts, "good.docx", "word/header1.xml")
    assert "call [REDACTED]" in _part(run.parts, "book.XLSX", "xl/sharedStrings.xml")


def test_other_parts_keep_their_bytes(run, parts):
    assert _part(run.parts, "good.docx", "[Content_Types].xml") == "<Types/>"
    assert bytes(run.parts.filter("part LIKE '%image1.png'").first().content) == DOCX["word/media/image1.png"]
    settings = _part(run.parts, "good.docx", "word/settings.xml")
    assert "<w:zoom w:percent='90'/>" in settings
    assert not any(x in settings for x in ("attachedTemplate", "docVar", "mailMerge"))
    rels = _part(run.parts, "good.docx", "word/_rels/settings.xml.rels")
    assert "rId7" not in rels and '<Relationship Id="rId1" Target="x.xml"/>' in rels
    assert _part(run.parts, "good.docx", "customXml/item1.xml") == '<root a="1"></root>'
    assert run.parts.filter("path = 'good.docx'").count() == len(DOCX)


def test_metadata_is_gone_afterwards(run):
    left = run.after.filter("value <> ''").select("path", "surface", "key", "value").collect()
    allowed = {("core", "revision", "1"), ("comments", "date", "1970-01-01T00:00:00Z"),
               ("tracked_changes", "date", "1970-01-01T00:00:00Z"), ("pivot_sources", "p1.xml", "S1!T"),
               ("custom_xml", "part", "customXml/item1.xml")}
    assert {(r.surface, r.key, r.value) for r in left} <= allowed


def test_result_rows(run):
    rows = {r.path: r for r in run.results.collect()}
    assert rows["good.docx"].success and rows["good.docx"].output_path == "good_cleaned.docx"
    assert rows["good.docx"].redactions == 4 and rows["book.XLSX"].redactions == 1
    assert {p for p, r in rows.items() if not r.success} == {
        "notzip.docx", "cut.docx", "badxml.docx", "doctype.docx", "big.docx"}
    assert rows["notzip.docx"].error.startswith("BadZipFile") and rows["notzip.docx"].output_path is None
    assert rows["plain.docx"].redactions == 0
    counts = {(r.path, r.rule): r.n for r in run.counts.collect()}
    assert counts[("good.docx", "email")] == 2 and counts[("good.docx", "ip")] == 1


def test_removed_values(run):
    removed = {(r.surface, r.key): r.old_value for r in run.removed.filter("path = 'good.docx'").collect()}
    assert removed[("comments", "author")] == "Jane K." and removed[("core", "author")] == "Ann Lee"
    assert removed[("template", "template_path")].endswith("letterhead.dotx")


def test_zip_and_unzip_again(run, spark):
    packed = packages.zip_parts(run.parts)
    again = metadata.check_parts(packages.unzip_parts(packed))
    a = again.select("path", "part", "xml", "content").filter("path = 'good.docx'")
    b = run.parts.select("path", "part", "xml", "content").filter("path = 'good.docx'")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_only_some_categories(parts):
    rules = rule_set([])
    only_dates = anonymise_packages(parts, AnonymiseConfig(rules=rules, categories=("dates",)))
    xml = _part(only_dates.parts, "good.docx", "docProps/core.xml")
    assert "Ann Lee" in xml and "created" not in xml and "modified" not in xml.replace("lastModifiedBy", "")
    assert _part(only_dates.parts, "good.docx", "word/document.xml") == DOCUMENT
    software = anonymise_packages(parts, AnonymiseConfig(rules=rules, categories=("software",)))
    assert "Jane K." in _part(software.parts, "good.docx", "word/comments.xml")
    assert 'name="N"' not in _part(software.parts, "book.XLSX", "xl/workbook.xml")
    none = anonymise_packages(parts, AnonymiseConfig(rules=rules, categories=()))
    assert _part(none.parts, "good.docx", "docProps/core.xml") == CORE


def test_legacy_gate_clears_core_as_a_whole(spark, parts):
    meta = metadata.inventory(parts, ["core"]).filter("path IN ('good.docx', 'book.XLSX')")
    out = PO.strip(meta, PO.policy_frame(spark, legacy_gate(), ["dates"]))
    assert {r.value for r in out.filter("value_type = 'string'").collect()} == {""}
    author = PO.strip(meta, PO.policy_frame(spark, legacy_gate(), ["author"]))
    left = {(r.path, r.key) for r in author.filter("value_type = 'timestamp'").collect()}
    assert ("book.XLSX", "created") in left and ("good.docx", "created") not in left


def test_encrypted_package_reads_back(spark, parts):
    key, _ = key_frame(spark, "pw")
    config = AnonymiseConfig(rules=rule_set(["email"]), encrypt=True)
    out = anonymise_packages(parts, config, key)
    xml = _part(out.parts, "good.docx", "word/document.xml")
    assert "⧙ENC:" in xml and "Mail" not in xml and '<w:pStyle w:val="Heading1"/>' in xml
    assert out.results.filter("path = 'good.docx'").first().output_path == "good_encrypted.docx"
    # to files and back, with the salt that travels in the package
    key, manifest = key_frame(spark, "pw", b"0123456789abcdef")
    out = anonymise_packages(parts, config, key)
    packed = packages.zip_parts(packages.add_salt(out.parts, manifest))
    again = metadata.check_parts(packages.unzip_parts(packed)).cache()
    salts = {r.path: bytes(r.salt) for r in packages.package_salts(again).collect()}
    assert salts == {p: b"0123456789abcdef" for p in ("good.docx", "book.XLSX", "plain.docx")}
    right, _ = key_frame(spark, "pw", salts["good.docx"])
    plain = decrypt_body(packages.drop_salt(again), right)
    body = _part(plain, "good.docx", "word/document.xml")
    assert "<w:t>Mail [REDACTED]</w:t>" in body and "⧙ENC:" not in body
    wrong, _ = key_frame(spark, "no", salts["good.docx"])
    assert _part(decrypt_body(again, wrong), "good.docx", "word/document.xml") == _part(
        again, "good.docx", "word/document.xml")


def test_oversize_package_is_an_error_row(run):
    rows = {r.path: r for r in packages.zip_parts(
        run.parts, packages.Caps(package_bytes=1500)).collect()}
    assert rows["plain.docx"].error is None and rows["plain.docx"].content
    assert rows["good.docx"].content is None and "larger" in rows["good.docx"].error


def test_units_can_be_joined(parts):
    config = AnonymiseConfig(rules=rule_set(["email", "ip"]), join_units=True)
    out = anonymise_packages(parts, config)
    xml = _part(out.parts, "good.docx", "word/document.xml")
    assert "<w:t>split [REDACTED]</w:t></w:r><w:r><w:t></w:t>" in xml
    assert "<w:t>Mail [REDACTED]</w:t>" in xml
    counts = {r.rule: r.n for r in out.counts.filter("path = 'good.docx'").collect()}
    assert counts == {"email": 3, "ip": 1}


def test_text_runs_are_units(parts):
    runs = PT.text_runs(parts.filter("path = 'good.docx'")).orderBy("part", "run_no").collect()
    assert [r.text for r in runs if r.part == "word/document.xml"] == [
        "Mail ann@example.org", " it's <10.0.0.1> ", "split a@b", ".com", "raw <c@d.org>"]


def test_attribute_edits_handle_quotes_and_prefixes(spark):
    df = spark.createDataFrame([(
        "<x:comment x:id=\"1\" x:author='A > B' x:date=\"d\"/><commentEx author=\"keep\"/>"
        "<comment author = \"C 'c'\" z=\"author='no'\"></comment>",)], "xml string")
    one = df.select(X.set_attribute(F.col("xml"), "comment", "author", "").alias("x")).first().x
    assert one == ("<x:comment x:id=\"1\" x:author=\"\" x:date=\"d\"/><commentEx author=\"keep\"/>"
                   "<comment author = \"\" z=\"author='no'\"></comment>")
    two = df.select(X.drop_attribute(F.col("xml"), "comment", "author").alias("x")).first().x
    assert two == ("<x:comment x:id=\"1\" x:date=\"d\"/><commentEx author=\"keep\"/>"
                   "<comment z=\"author='no'\"></comment>")


def test_element_edits(spark):
    df = spark.createDataFrame([(
        "<?xml version=\"1.0\"?><!-- c --><r a=\"1\"><p:v x=\"/>\"><q/>t</p:v><v/><vs>k</vs><t>old</t></r>",)],
        "xml string")
    get = lambda c: df.select(c.alias("x")).first().x
    assert get(X.drop_element(F.col("xml"), "v")).endswith("<r a=\"1\"><vs>k</vs><t>old</t></r>")
    assert get(X.set_text(F.col("xml"), "t")).endswith("<t></t></r>")
    assert get(X.drop_children(F.col("xml"))).endswith("<!-- c --><r a=\"1\"></r>")


HIDDEN = ('<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator><![CDATA[Jane Doe]]></dc:creator>'
          "<cp:lastModifiedBy>Ja<!--x-->ne</cp:lastModifiedBy><dc:title></dc:title></cp:coreProperties>")
SETTINGS = '<w:settings xmlns:w="w"><!-- old: <w:docVars> --><w:zoom/><w:docVars><w:docVar/></w:docVars></w:settings>'


def test_strip_reaches_hidden_values_and_keeps_parts_whole(spark):
    from xml.etree import ElementTree

    rows = [("a.docx", "docx", "docProps/core.xml", 0, None, HIDDEN, None),
            ("a.docx", "docx", "word/settings.xml", 1, None, SETTINGS, None)]
    from inkveil.operators import parts as PT
    got = {r["part"]: r["xml"] for r in PT.scrub(spark.createDataFrame(rows, packages.PART_SCHEMA)).collect()}
    for xml in got.values():
        ElementTree.fromstring(xml)
    assert "Jane" not in got["docProps/core.xml"] and "ne</" not in got["docProps/core.xml"]
    assert "zoom" in got["word/settings.xml"] and "docVar" not in got["word/settings.xml"]


@pytest.mark.parametrize("tail", ["junk", "<b/>", "<!-- open", "<?open", "<"])
def test_parts_are_read_to_their_end(tail):
    assert packages._text("a.xml", b"<a/>" + tail.encode())[1] == "malformed XML"


@pytest.mark.parametrize("encoding", ["utf-16", "iso-8859-1", "utf-8-sig"])
def test_encodings_survive(encoding):
    name = "utf-8" if encoding == "utf-8-sig" else encoding
    text = f'<?xml version="1.0" encoding="{name}"?><a>é</a>'
    data = text.encode(encoding)
    xml, error = packages._text("a.xml", data)
    assert (xml, error) == (text, None)
    assert packages._bytes("a.xml", xml, data) == data  # untouched: byte for byte
    edited = packages._bytes("a.xml", xml.replace("é", "ö"), data)
    assert packages._text("a.xml", edited) == (packages._decode(edited), None) and "ö" in packages._decode(edited)


SHEET = (
    '<worksheet xmlns="urn:m"><sheetData><row r="1">'
    '<c r="A1" t="inlineStr"><is><t>mail jane@example.org</t></is></c>'
    '<c r="B1" s="1" t="str"><f>CONCAT("a","b")</f><v>bob@example.org &amp; co</v></c>'
    "<c r='C1' t='str'><v>kim@example.org</v></c>"
    '<c r="D1"><f>1+1</f><v>2</v></c><c r="E1" t="s"><v>0</v></c><c r="F1" t="e"><v>#N/A</v></c>'
    "</row></sheetData></worksheet>"
)


def test_all_text_cells_of_a_sheet(spark):
    parts = spark.createDataFrame(
        [("b.xlsx", "xlsx", "xl/worksheets/sheet1.xml", 0, SHEET, None)],
        "path string, kind string, part string, ordinal int, xml string, error string")
    config = AnonymiseConfig(rules=rule_set(["email"]))
    red = SHEET.replace("jane@example.org", "[REDACTED]").replace("bob@example.org", "[REDACTED]").replace(
        "kim@example.org", "[REDACTED]")
    row = edit_body(parts, config).first()
    assert row.xml == red and row.counts["email"] == 3
    key, _ = key_frame(spark, "pw", b"0123456789abcdef")
    locked = edit_body(parts, AnonymiseConfig(rules=rule_set([]), encrypt=True), key).drop("counts")
    xml = locked.first().xml
    assert xml.count("⧙ENC:") == 3 and "example.org" not in xml and "<v>2</v>" in xml and '<c r="E1" t="s"><v>0</v>' in xml
    assert decrypt_body(locked, key).first().xml == SHEET
