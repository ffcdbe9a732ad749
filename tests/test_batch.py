"""The whole job over tables, its reports, sinks and the streaming form."""

import pytest
from pyspark.sql import functions as F

from inkveil.config import ALL_RULES, AnonymiseConfig, rule_set
from inkveil.functions import display
from inkveil.functions.crypto import key_frame
from inkveil.operators import reports
from inkveil.operators.redaction import redact_columns, with_changed, with_redaction
from inkveil.plans import batch
from inkveil.sources import sinks, tables
from inkveil.streaming import streams

META = {"owner": ("author", "blank"), "made": ("dates", "drop")}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([
        ("in/a.docx", "mail a@b.co", "Ann", "2024"), ("in/b.pdf", "ring 12345678", "", None),
        ("in/c.png", "a@b.co stays", "Cy", "2023"), ("in/d.exe", "x", "Di", "2022"),
        ("in/e.xlsx", None, "Ed", "2021"), ("in/f.XLSX", "plain", "Flo", "2020"),
    ], "file string, text string, owner string, made string")


def _run(docs, config, **kw):
    out = batch.anonymise(docs, config, file="file", text="text", meta=META, **kw)
    return {r.file: r for r in out.collect()}


def test_result_records(docs):
    got = _run(docs, AnonymiseConfig(rules=rule_set()))
    a = got["a.docx"]
    assert a.success and a.output_path == "a_cleaned.docx" and a.output_text == "mail [REDACTED]"
    assert a.before == {"owner": "Ann", "made": "2024"} and a.after == {"owner": "", "made": None}
    assert a.removed == {"owner": "Ann", "made": "2024"} and a.redaction == {"email": 1}
    assert got["b.pdf"].removed == {} and got["b.pdf"].encryption == "off"
    assert got["c.png"].output_text == "a@b.co stays" and got["c.png"].text_status == "no_text_rules"


def test_bad_rows_do_not_stop_the_batch(docs):
    got = _run(docs, AnonymiseConfig(rules=rule_set()))
    assert not got["d.exe"].success and got["d.exe"].error == "Unsupported file: in/d.exe"
    assert not got["e.xlsx"].success and got["e.xlsx"].before is None
    frame = batch.anonymise(docs, AnonymiseConfig(), file="file", text="text")
    assert {r.success: r.n for r in reports.batch_status(frame).collect()} == {True: 4, False: 2}
    good, bad = reports.split_results(frame)
    assert (good.count(), bad.count()) == (4, 2)


def test_categories_and_rules_off(docs):
    got = _run(docs, AnonymiseConfig(rules=rule_set([]), categories=("dates",)))
    assert got["a.docx"].after == {"owner": "Ann", "made": None}
    assert got["a.docx"].output_text == "mail a@b.co" and got["a.docx"].redaction == {}


def test_encryption_says_what_it_skipped(spark, docs):
    key, _ = key_frame(spark, "pw", b"s" * 16)
    got = _run(docs, AnonymiseConfig(rules=rule_set(), encrypt=True), key=key)
    assert got["a.docx"].encryption == "encrypted" and got["a.docx"].output_path == "a_encrypted.docx"
    assert got["a.docx"].output_text.startswith("⧙ENC:")
    assert got["b.pdf"].encryption == "skipped_unsupported" and got["b.pdf"].output_path == "b_cleaned.pdf"
    assert got["f.XLSX"].output_path == "f_encrypted.XLSX"


def test_preview_reads_the_first_rows_only(docs):
    out = batch.preview(docs, 2, AnonymiseConfig(), file="file", text="text")
    assert out.count() == 2


def test_reports(spark, texts):
    df = texts(["a@b.co and 12345678", "a@b.co", "none"]).withColumn("lang", F.lit("en"))
    counts = reports.counts_by_row(df, "text", ALL_RULES, ["id", "lang"])
    merged = {(r.lang, r.rule): r.n for r in reports.merge_counts(counts, ["lang"]).collect()}
    assert merged == {("en", "email"): 2, ("en", "phone"): 1}
    lines = with_redaction(df, "text", ALL_RULES).orderBy("id").select(
        reports.summary_line(F.col("counts")).alias("l"), reports.total_redactions(F.col("counts")).alias("t")).collect()
    assert [r.l for r in lines] == ["2 item(s) redacted (email: 1, phone: 1)", "1 item(s) redacted (email: 1)", None]
    assert [r.t for r in lines] == [2, 1, 0]
    prof = {(r.lang, r.rule): (r.docs, r.spans) for r in reports.profile(counts, "lang", "id").collect()}
    assert prof[(None, None)] == (2, 3) and prof[("en", "email")] == (2, 2)
    assert [r.id for r in reports.top_exposed(counts, "id", 1).collect()] == [0]


def test_residual_audit_is_empty_after_one_rule(texts):
    rules = rule_set(["email"])
    out = with_redaction(texts(["a@b.co, x@y.org", "é@a.b a@b.cc"]), "text", rules, counts=None)
    assert reports.residual_audit(out, "redacted", rules).count() == 0


def test_changed_flag(texts):
    out = with_changed(with_redaction(texts(["a@b.co", "x", None]), "text", rule_set()), "text", "redacted")
    assert [r.changed for r in out.orderBy("id").collect()] == [True, False, False]


def test_several_columns_in_place(spark):
    df = spark.createDataFrame([("a@b.co", 5, "10.0.0.1")], "m string, n int, t string")
    out = redact_columns(df, ["m", "t"], rule_set())
    assert out.columns == df.columns and tuple(out.first()) == ("[REDACTED]", 5, "[REDACTED]")


def test_units(spark, texts):
    units = tables.explode_units(texts(["a\n\n b \n", "x"]), "text").orderBy("id", "unit_no").collect()
    assert [(r.id, r.unit_no, r.text) for r in units] == [
        (0, 0, "a"), (0, 1, ""), (0, 2, " b "), (0, 3, ""), (1, 0, "x")]
    blank = tables.drop_blank(texts(["", "  \t", None, "x", "\x1c"]), "text")
    assert [r.text for r in blank.collect()] == ["x"]
    cells = spark.createDataFrame([(1, "a", 2.0, None)], "id int, s string, d double, t string")
    assert [tuple(r) for r in tables.cell_units(cells, ["id"]).collect()] == [(1, "s", "a")]


def test_names(spark):
    df = spark.createDataFrame([("a.b.docx",), (".hidden",), ("noext",), ("x_nometa.pdf",)], "n string")
    got = [tuple(r) for r in df.select(
        display.cleaned_name(F.col("n")), display.in_bundle(display.cleaned_name(F.col("n"))),
        display.download_name(F.col("n"), F.lit(True))).collect()]
    assert got[0] == ("a.b_cleaned.docx", True, "a.b_anonymized_encrypted.docx")
    assert got[1] == (".hidden_cleaned", False, ".hidden_anonymized_encrypted")
    assert got[2][0] == "noext_cleaned" and got[3][0] == "x_nometa_cleaned.pdf"


def test_display(spark):
    df = spark.createDataFrame([(None,), ("None",), (" ",), ("v",)], "v string")
    assert [r[0] for r in df.select(display.display_value(F.col("v"))).collect()] == ["—", "—", "—", "v"]


def test_cleaned_sink(spark, texts, tmp_path):
    out = str(tmp_path / "clean")
    df = redact_columns(texts(["a@b.co", "x"]).withColumn("lang", F.lit("en")), ["text"], rule_set())
    sinks.write_cleaned(df, out, ["lang"])
    back = spark.read.parquet(out)
    assert {r.text for r in back.collect()} == {"[REDACTED]", "x"} and (tmp_path / "clean" / "lang=en").is_dir()
    with pytest.raises(Exception, match="exists"):
        sinks.write_cleaned(df, out, ["lang"])


def test_stream_gives_the_batch_result(spark, texts, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df = texts(["mail a@b.co", "ring 12345678", "plain", None])
    df.repartition(3).write.parquet(source)
    stream = streams.redact_stream(streams.read_stream(spark, source, df.schema, 1), "text", ALL_RULES)
    for _ in range(2):   # a second run finds nothing new
        streams.write_available(stream, sink, str(tmp_path / "cp")).awaitTermination()
    want = with_redaction(df, "text", ALL_RULES)
    got = spark.read.parquet(sink)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_whole_job_runs_on_a_stream(spark, docs, tmp_path):
    source = str(tmp_path / "in")
    docs.write.parquet(source)
    stream = batch.anonymise(streams.read_stream(spark, source, docs.schema), AnonymiseConfig(),
                             file="file", text="text", meta=META)
    streams.write_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
