"""Steps that several results read are worked out once, and worker batches stay small whatever the input."""

import pytest
from pyspark.sql import functions as F

from inkveil import session
from inkveil.config import AnonymiseConfig, rule_set
from inkveil.operators import metadata
from inkveil.plans import batch
from inkveil.sources import packages
from workload import batch_queries


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    return tmp_path


def _part_rows(spark, rows):
    return spark.createDataFrame(rows, "path string, kind string, part string, ordinal int, content binary, xml string")


def test_packages_are_written_in_order_whatever_the_batches(spark):
    rows = [(f"p{p}.docx", "docx", f"word/{i:03}.xml", i, None, f"<a>{p}-{i}</a>") for i in range(300) for p in range(3)]
    rows += [(None, "docx", "x.xml", None, None, "<last/>"), (None, "docx", "y.bin", 0, bytearray(b"raw"), None)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "7")
    try:
        packed = packages.zip_parts(_part_rows(spark, rows)).collect()
        assert sorted(r.path or "" for r in packed) == ["", "p0.docx", "p1.docx", "p2.docx"]
        found = packages.unzip_parts(spark.createDataFrame(
            [(r.path or "null.docx", r.content) for r in packed], "path string, content binary")).collect()
    finally:
        spark.conf.unset(size)
    by_path = {}
    for r in sorted(found, key=lambda r: r.ordinal):
        by_path.setdefault(r.path, []).append((r.part, r.xml))
    assert by_path["p1.docx"] == [(f"word/{i:03}.xml", f"<a>1-{i}</a>") for i in range(300)]
    assert by_path["null.docx"] == [("y.bin", None), ("x.xml", "<last/>")]
    assert {r.error for r in found} == {None}


def test_batches_that_leave_a_worker_are_bounded_by_rows_too(spark):
    rows = [("p.docx", "docx", f"word/{i}.xml", i, None, "<a/>") for i in range(5_000)]
    packed = packages.zip_parts(_part_rows(spark, rows))
    sizes = packages.unzip_parts(packed).mapInArrow(
        lambda batches: (b.select(["ordinal"]) for b in batches), "ordinal int").count()
    assert sizes == 5_000
    made = list(packages._given(((i, "x") for i in range(5_000)), "n int, name string", 1 << 30))
    assert max(b.num_rows for b in made) <= 2_000 and sum(b.num_rows for b in made) == 5_000
    assert [b.num_rows for b in packages._given(((i, "x" * 10) for i in range(5)), "n int, name string", 20)] == [2, 2, 1]


def test_zip_and_unzip_need_no_pandas_groups(spark):
    packed = packages.zip_parts(_part_rows(spark, [("p.docx", "docx", "a.xml", 0, None, "<a/>")]))
    assert "FlatMapGroups" not in _plan(packed) and "MapInPandas" not in _plan(packages.unzip_parts(packed))


def test_settled_tables_are_columns_in_the_shared_folder(spark, shared):
    df = spark.createDataFrame([("a", 1, {"x": 2}), (None, None, None)], "s string, n int, m map<string,bigint>")
    kept = session.settled(df)
    assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert list(shared.rglob("*.parquet"))
    assert "parquet" in _plan(kept) and "LogicalRDD" not in _plan(kept)
    assert session.settled(df.filter("n = 7")).count() == 0


def _tables(spark, folder):
    rows = {
        "orders": "SELECT 1L AS o_orderkey, 2L AS o_custkey, DATE'2024-01-02' AS o_orderdate, 'HIGH' AS o_orderpriority, 'O' AS o_orderstatus",
        "customer": "SELECT 1L AS c_custkey, 'Ann' AS c_name, 'SHIPS' AS c_mktsegment",
        "supplier": "SELECT 1L AS s_suppkey, 'Sup' AS s_name, 3 AS s_nationkey",
        "part": "SELECT 1L AS p_partkey, 'bolt' AS p_name, 'B1' AS p_brand, 'T' AS p_type, 5 AS p_size",
    }
    for name, sql in rows.items():
        spark.sql(sql).write.parquet(f"{folder}/{name}.parquet")


def test_packages_of_a_run_are_built_and_checked_once(spark, shared):
    _tables(spark, f"{shared}/in")
    run = batch_queries._strip_run(spark, f"{shared}/in", "author")
    for result in (run.errors, run._good):
        assert "from_xml" not in _plan(result) and "orders.parquet" not in _plan(result)
    found = {(r.surface, r.key, r.old_value) for r in run.removed.collect()}
    assert ("core", "creator", "HIGH") in found and ("people", "name", "Ann") in found


def test_records_join_their_files_once(spark, shared):
    files = spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1.7"))], "path string, content binary")
    records = spark.createDataFrame(
        [("a.pdf", "pdf", "info", "Author", 0, "Ann", "string"), ("b.pdf", "pdf", "info", "Author", 0, "Bob", "string")],
        "path string, kind string, surface string, key string, ordinal int, value string, value_type string")
    run = batch.anonymise_files(files, AnonymiseConfig(rules=rule_set()), records=records)
    assert "Join" not in _plan(run._read) and [r.value for r in run._read.collect()] == ["Ann"]
    assert run.report.select("before", "removed").first().asDict() == {"before": {"info": 1}, "removed": {"info": 1}}


def test_tags_of_a_part_are_cut_once(spark):
    xml = '<people xmlns:w="u"><w:person w:name="A &amp; B" id="1"/><w:person w:name="" id="2"><x name="no"/></w:person></people>'
    parts = spark.createDataFrame(
        [("p.docx", "docx", "word/people.xml", 0, xml, None)], "path string, kind string, part string, ordinal int, xml string, error string")
    rows = metadata.part_rows(parts)
    assert _plan(rows).count("aggregate(") == 1
    assert sorted((r.key, r.value) for r in rows.collect()) == [("id", "1"), ("id", "2"), ("name", "A & B")]
    assert metadata.inventory(parts).filter(F.col("surface") == "people").count() == 3
