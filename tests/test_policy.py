"""Policies, strip, diff and audits over key/value metadata."""

import pytest
from pyspark.sql import functions as F

from inkveil.operators import metadata, policy as PO, reports
from inkveil.plans.policies import ANY, DEFAULT_POLICY, PolicyRow, active, legacy_gate

COLUMNS = "path string, kind string, surface string, key string, ordinal int, value string, value_type string"


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([
        ("a.docx", "docx", "core", "author", 0, "Ann", "string"),
        ("a.docx", "docx", "core", "title", 0, "T", "string"),
        ("a.docx", "docx", "core", "created", 0, "2024-01-01T00:00:00", "timestamp"),
        ("a.docx", "docx", "core", "revision", 0, "7", "int"),
        ("a.docx", "docx", "core", "last_printed", 0, None, "timestamp"),
        ("a.docx", "docx", "comments", "date", 0, "2024", "timestamp"),
        ("a.docx", "docx", "document_variables", "x", 0, "1", "string"),
        ("b.pdf", "pdf", "info", "Author", 0, "Bob", "string"),
        ("b.pdf", "pdf", "info", "ModDate", 0, "D:2024", "string"),
        ("b.pdf", "pdf", "xmp", "packet", 0, "<x/>", "string"),
        ("b.pdf", "pdf", "form", "NeedAppearances", 0, "true", "boolean"),
        ("c.jpg", "image", "exif", "GPSInfo", 0, "1,2", "string"),
        ("c.jpg", "image", "frames", "n", 0, "1", "int"),
        ("d.xlsx", "xlsx", "hidden_sheets", "sheet", 0, "H", "string"),
    ], COLUMNS)


def _strip(spark, meta, *categories, **kw):
    out = PO.strip(meta, PO.policy_frame(spark, DEFAULT_POLICY, categories), **kw)
    return {(r.path, r.surface, r.key): r.value for r in out.collect()}


ALL = ("author", "dates", "geo", "software")


def test_all_categories(spark, meta):
    got = _strip(spark, meta, *ALL)
    assert got == {
        ("a.docx", "core", "author"): "", ("a.docx", "core", "title"): "",
        ("a.docx", "core", "revision"): "1", ("a.docx", "comments", "date"): "1970-01-01T00:00:00Z",
        ("b.pdf", "info", "Author"): "", ("b.pdf", "info", "ModDate"): "",
        ("b.pdf", "xmp", "packet"): None, ("c.jpg", "frames", "n"): "1",
        ("d.xlsx", "hidden_sheets", "sheet"): "visible",
    }


def test_one_category_at_a_time(spark, meta):
    before = {(r.path, r.surface, r.key): r.value for r in meta.collect()}
    geo = _strip(spark, meta, "geo")
    assert geo == {k: v for k, v in before.items() if k[1] != "exif"}
    author = _strip(spark, meta, "author")
    assert author[("a.docx", "core", "author")] == "" and author[("a.docx", "core", "title")] == "T"
    assert author[("b.pdf", "info", "ModDate")] == "D:2024"
    assert _strip(spark, meta) == before


def test_large_policy_takes_the_salted_join(spark, meta):
    assert _strip(spark, meta, *ALL, max_rows=0) == _strip(spark, meta, *ALL)
    plan = PO.strip(meta, PO.policy_frame(spark), max_rows=0)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_small_policy_is_broadcast(spark, meta):
    out = PO.strip(meta, PO.policy_frame(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_strip_twice_is_strip_once(spark, meta):
    pol = PO.policy_frame(spark)
    once = PO.strip(meta, pol)
    twice = PO.strip(once, pol)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert PO.residual_metadata(once, pol).count() == 0


def test_removed_holds_only_what_changed(spark, meta):
    planned = PO.plan_strip(meta, PO.policy_frame(spark, DEFAULT_POLICY, ["dates"]))
    rows = {(r.surface, r.key): (r.old_value, r.action) for r in PO.removed_report(planned).collect()}
    assert rows == {("core", "created"): ("2024-01-01T00:00:00", "drop"),
                    ("info", "ModDate"): ("D:2024", "blank"),
                    ("exif", "GPSInfo"): ("1,2", "drop"),   # images go with any category
                    ("hidden_sheets", "sheet"): ("H", "visible")}


def test_diff_states(spark):
    def frame(rows):
        return spark.createDataFrame(
            [("p", "k", "s", key, 0, v, "string") for key, v in rows], COLUMNS)
    before = frame([("kept", "1"), ("cleared", "1"), ("dropped", "1"), ("changed", "1"), ("null", None), ("blank", "")])
    after = frame([("kept", "1"), ("cleared", ""), ("changed", "2"), ("null", None), ("blank", None), ("new", "x")])
    got = {r.key: r.status for r in PO.diff(before, after).collect()}
    assert got == {"kept": "kept", "cleared": "cleared", "dropped": "cleared", "changed": "changed",
                   "null": "kept", "blank": "kept", "new": "added"}


def test_uncovered(spark, meta):
    got = {(r.surface, r.key): r.n for r in PO.uncovered_keys(meta, PO.policy_frame(spark)).collect()}
    assert got == {("frames", "n"): 1}


def test_exact_key_beats_whole_surface(spark, meta):
    rows = [PolicyRow("docx", "core", ANY, ("author",), "blank"),
            PolicyRow("docx", "core", "title", ("author",), "one")]
    got = PO.strip(meta, PO.policy_frame(spark, rows))
    values = {r.key: r.value for r in got.filter("surface = 'core'").collect()}
    assert values["title"] == "1" and values["author"] == "" and values["last_printed"] is None


def test_policy_rows():
    assert len({(r.kind, r.surface, r.key) for r in DEFAULT_POLICY}) == len(DEFAULT_POLICY)
    legacy = {(r.kind, r.surface, r.key): r for r in legacy_gate()}
    assert legacy[("docx", "core", "created")].categories == ("author", "dates", "software")
    assert legacy[("xlsx", "core", "created")].categories == ("dates", "software")
    with pytest.raises(ValueError):
        active(DEFAULT_POLICY, ["nope"])


def test_records_to_rows(spark):
    df = spark.sql("SELECT 'x.pdf' AS f, 'Ann' AS Author, CAST(NULL AS STRING) AS Title, "
                   "TIMESTAMP_NTZ'2024-01-02 03:04:05' AS ModDate, true AS has_xmp")
    out = metadata.records_to_meta(df, F.col("f"), "pdf", "info", ["Author", "Title", "ModDate", "has_xmp"])
    assert {(r.key, r.value, r.value_type) for r in out.collect()} == {
        ("Author", "Ann", "string"), ("Title", None, "string"),
        ("ModDate", "2024-01-02T03:04:05", "timestamp"), ("has_xmp", "true", "boolean")}


def test_distinct_values(meta):
    assert reports.distinct_values(meta, ["surface"]).filter("surface = 'info'").count() == 2


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_planned_diff_is_the_diff_of_both_tables(spark, meta):
    policy = PO.policy_frame(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    planned = PO.diff_planned(PO.plan_strip(meta, policy))
    apart = PO.diff(meta, PO.strip(meta, policy))
    assert rows(planned) == rows(apart)
    assert "Join" not in plan_of(PO.diff(meta, meta))
    assert "Aggregate" not in plan_of(planned)


def test_diff_of_empty_tables_and_null_keys(spark, meta):
    none = meta.limit(0)
    assert PO.diff(none, none).count() == 0
    assert {r.status for r in PO.diff(none, meta.filter("value <> ''")).collect()} == {"added"}
    odd = spark.createDataFrame([(None, "k", "s", None, 0, "1", "string")], COLUMNS)
    assert [r.status for r in PO.diff(odd, odd).collect()] == ["kept"]


def test_only_hot_keys_are_salted(spark):
    rows = [(f"p{i}", "k", "s", "hot" if i % 2 else f"cold{i}", 0, str(i), "string") for i in range(400)]
    rows.append(("p", "k", "s", None, 0, None, "string"))
    frame = spark.createDataFrame(rows, COLUMNS)
    keys = ["kind", "surface", "key"]
    assert [(r.key, r._salts) for r in PO.hot_keys(frame, keys).collect()] == [("hot", 64)]
    policy = PO.policy_frame(spark, [
        PolicyRow("k", "s", "hot", ("author",), "blank"), PolicyRow("k", "s", "cold2", ("author",), "drop")])
    small, large = (sorted(map(str, PO.strip(frame, policy, max_rows=n).collect())) for n in (1_000, 0))
    assert small == large and len(large) == 400
    assert PO.strip(frame.limit(0), policy, max_rows=0).count() == 0
