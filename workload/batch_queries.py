"""Queries over files, packages, encryption and the whole batch."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.config import ALL_RULES, AnonymiseConfig, RuleSet, rule_set
from inkveil.functions import crypto, display
from inkveil.operators import encryption, metadata, policy, reports
from inkveil.plans import batch
from inkveil.session import run_folder, settled, spread
from inkveil.sources import files, packages, sinks
from inkveil.sources.tables import read_table
from inkveil.streaming import streams
from workload import planted_parts as PP
from workload.text_queries import CUSTOM_KEYWORDS

# ------------------------------------------------------------------- files


def binary_inventory(spark, folder):
    """Turns written as one folder of text files per role, found again as binary files and read whole."""
    turns = read_table(spark, folder, "conversations", "role", "text")
    out = run_folder(spark, "binary")
    sinks.write_cleaned(turns.withColumn("text", F.coalesce("text", F.lit(""))), out, ["role"], kind="text")
    found = files.binary_files(spark, out, supported_only=False).filter(F.col("path").endswith(".txt"))
    return found.groupBy(
        F.regexp_extract("path", "role=([^/]*)/", 1).alias("role"), files.file_extension(F.col("path")).alias("ext"),
        files.is_supported(F.col("path")).alias("supported"),
    ).agg(F.sum("length").alias("n_bytes"), F.sum(F.length("content")).cast("bigint").alias("n_read"))


def stream_redact(spark, folder):
    """Turns redacted as they arrive: half of them, a stop, the other half, and the same checkpoint again."""
    turns = read_table(spark, folder, "conversations", "conv_id", "turn", "text")
    out = run_folder(spark, "stream")
    rules = rule_set(C.RULE_ORDER, keywords=CUSTOM_KEYWORDS)
    second = F.coalesce(F.col("conv_id") % 2 != 0, F.lit(False))
    for arrived in (~second, second):
        turns.filter(arrived).write.mode("append").parquet(f"{out}/in")
        stream = streams.redact_stream(streams.read_stream(spark, f"{out}/in", turns.schema), "text", rules)
        streams.write_available(stream, f"{out}/out", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/out").select(
        "conv_id", "turn", "redacted", reports.total_redactions(F.col("counts")).alias("n"))


FILE_NAME = (
    "concat(p_brand, '-', p_partkey, element_at(array('.pdf', '.DOCX', '.xlsx', '.jpeg', '.bin', '', '.txt', '.Png'), "
    "CAST(1 + p_partkey % 8 AS INT)))"
)
FILE_HEAD = (
    "element_at(array(X'255044462d312e37', X'504b030414000600', X'00'), CAST(1 + p_size % 3 AS INT))"
)


def detect_type(spark, folder):
    """Kind by name, else by first bytes."""
    df = read_table(spark, folder, "part", "p_partkey", "p_brand", "p_size").selectExpr(
        "p_partkey", f"{FILE_NAME} AS path", f"{FILE_HEAD} AS content")
    return df.select("p_partkey", files.file_kind(F.col("path"), F.col("content")).alias("kind"))


def output_names(spark, folder):
    name = F.expr(FILE_NAME)
    df = read_table(spark, folder, "part", "p_partkey", "p_brand", "p_size")
    return df.select(
        "p_partkey",
        display.cleaned_name(name).alias("cleaned"),
        display.encrypted_name(name).alias("encrypted"),
        display.download_name(name, F.col("p_size") % 2 == 0).alias("download"),
        display.download_name(name, F.col("p_size") % 2 == 0, overwrite=True).alias("original"))


def bundle_manifest(spark, folder):
    """Outputs that ship: cleaned and encrypted ones, never the intermediate."""
    df = read_table(spark, folder, "part", "p_partkey", "p_brand", "p_size")
    name = F.expr(FILE_NAME)
    names = F.array(name, display.cleaned_name(name), display.encrypted_name(name),
                    F.concat(display.stem(name), F.lit("_nometa"), display.extension(name)))
    return df.select("p_partkey", F.explode(names).alias("file")).filter(
        display.in_bundle(F.col("file")))


# ---------------------------------------------------------------- packages

def _with_bytes(parts: DataFrame) -> DataFrame:
    return parts.withColumn("content", F.lit(None).cast("binary"))


def _packages(spark: SparkSession, folder: str) -> DataFrame:
    """Real zip packages from the conversation parts; every tenth is cut short."""
    both = PP.body(spark, folder).unionByName(
        PP.comments(spark, folder).withColumn("ordinal", F.lit(1))).unionByName(
        PP.other_parts(spark, folder).withColumn("ordinal", F.col("ordinal") + 1))
    packed = packages.zip_parts(_with_bytes(both))
    cut = F.regexp_extract("path", r"^turn-(\d+)-", 1).cast("bigint") % 10 == 0
    return packed.withColumn("content", F.when(
        cut, F.expr("substring(content, 1, 40)")).otherwise(F.col("content")))


def package_parts(spark, folder):
    """Zip, unzip, list: every part once, cut packages as one error row."""
    parts = packages.unzip_parts(_packages(spark, folder))
    return parts.select(
        "path", F.coalesce("part", F.lit("")).alias("part"),
        F.coalesce(F.length("xml"), F.lit(0)).cast("bigint").alias("n_chars"),
        F.col("error").isNotNull().alias("failed"))


def package_errors(spark, folder):
    parts = metadata.check_parts(packages.unzip_parts(_packages(spark, folder)))
    return packages.part_errors(parts).select("path", F.col("part").isNull().alias("whole"))


PACKAGE_RULES = rule_set(C.RULE_ORDER, keywords=("that", "les", "der"))


def _package_run(spark, folder) -> batch.PackageRun:
    parts = settled(metadata.check_parts(PP.body(spark, folder).unionByName(
        PP.comments(spark, folder).withColumn("ordinal", F.lit(1)))))
    return batch.anonymise_packages(parts, AnonymiseConfig(rules=PACKAGE_RULES))


def anonymise_packages_text(spark, folder):
    """Body text read back from cleaned parts, run by run."""
    from inkveil.operators.parts import text_runs
    return text_runs(_package_run(spark, folder).parts).select(
        "path", F.col("run_no").cast("bigint").alias("run_no"), "text")


def anonymise_packages_results(spark, folder):
    return _package_run(spark, folder).results.select(
        "file", "success", "output_path", "redactions", "error")


def anonymise_packages_after(spark, folder):
    """Metadata read back from the cleaned parts."""
    after = _package_run(spark, folder).after
    return after.groupBy("surface", "key", "value").agg(F.count_distinct("path").alias("packages"))


def _strip_run(spark, folder, *categories: str, legacy: bool = False) -> batch.PackageRun:
    """All packages that hold metadata, stripped by the parts."""
    parts = None
    for build in (PP.core, PP.app, PP.settings, PP.people, PP.workbook, PP.book_parts):
        p = build(spark, folder)
        parts = p if parts is None else parts.unionByName(p)
    config = AnonymiseConfig(rules=rule_set([]), categories=categories or C.CATEGORIES, legacy_gate=legacy)
    return batch.anonymise_packages(settled(metadata.check_parts(parts)), config)


def _package_removed(*categories: str, legacy: bool = False):
    """Values of the packages that are gone from the cleaned parts."""
    def query(spark, folder):
        return _strip_run(spark, folder, *categories, legacy=legacy).removed.select(
            "path", "surface", "key", "old_value", "times")
    return query


def package_residual(spark, folder):
    """Cleaned by author only, audited by the whole policy."""
    after = _strip_run(spark, folder, "author").after
    return policy.residual_metadata(after, policy.policy_frame(spark)).select("path", "surface", "key", "value")


def _mixed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Text documents (every tenth cut short), workbooks, PDF files, images and notes, as bytes."""
    packed = packages.zip_parts(_with_bytes(
        PP.body(spark, folder).unionByName(PP.comments(spark, folder).withColumn("ordinal", F.lit(1)))
        .unionByName(PP.workbook(spark, folder))))
    cut = F.regexp_extract("path", r"^turn-(\d+)-", 1)
    packed = packed.select("path", F.when(cut.endswith("0"), F.expr("substring(content, 1, 40)")).otherwise(
        F.col("content")).alias("content"))
    for table, key, path, head in (
        ("orders", "o_orderkey", "concat('order-', o_orderkey, '.pdf')", "X'255044462d312e37'"),
        ("customer", "c_custkey", "concat('image-', c_custkey, '.jpg')", "X'ffd8ffe0'"),
        ("part", "p_partkey", "concat('note-', p_partkey, '.txt')", "X'00'"),
    ):
        packed = packed.unionByName(PP.read_table(spark, folder, table, key).selectExpr(
            f"{path} AS path", f"{head} AS content"))
    return packed


def _mixed_run(spark, folder) -> batch.PackageRun:
    from workload.metadata_queries import _image_rows, _pdf_rows
    texts = PP.read_table(spark, folder, "orders", "o_orderkey", "o_custkey").filter("o_orderkey % 2 = 0").selectExpr(
        "concat('order-', o_orderkey, '.pdf') AS path",
        "explode(array(concat('mail user', o_custkey, '@example.org'), 'nobody at all', '')) AS text")
    return batch.anonymise_files(
        _mixed_files(spark, folder), AnonymiseConfig(rules=rule_set()),
        records=_pdf_rows(spark, folder).unionByName(_image_rows(spark, folder)), texts=texts)


def mixed_batch_results(spark, folder):
    """The full record of every file of a mixed batch, maps as text."""
    return _mixed_run(spark, folder).report.select(
        "file", "kind", "success", "output_path", _flat("before").alias("before"), _flat("removed").alias("removed"),
        _flat("after").alias("after"), _flat("redaction").alias("redaction"), "text_status", "encryption", "error")


# -------------------------------------------------------------- encryption

PASSWORD, SALT = "correct horse battery staple", bytes(range(C.SALT_BYTES))


def _key(spark: SparkSession, password: str = PASSWORD) -> DataFrame:
    return crypto.key_frame(spark, password, SALT, "run-1")[0]


def _texts(spark, folder) -> DataFrame:
    """Turns, some blank and some that already carry the marker."""
    df = spread(read_table(spark, folder, "conversations", "conv_id", "turn", "text"))
    return df.withColumn("text", F.expr(TEXTS))


TEXTS = (
    "CASE WHEN turn % 5 = 4 THEN '  ' WHEN turn % 5 = 3 THEN concat('⧙ENC:', text) ELSE text END"
)


def encrypt_flags(spark, folder):
    """Which rows changed, and how the blank and marked ones came out."""
    df = _texts(spark, folder).withColumn("enc", F.col("text"))
    out = encryption.encrypt_columns(df, ["enc"], _key(spark))
    token = rf"\A{C.ENC_PREFIX}[A-Za-z0-9+/=]+{C.ENC_SUFFIX}\z"
    return out.select(
        "conv_id", "turn", F.col("enc").rlike(token).alias("is_token"),
        F.when(F.col("enc") == F.col("text"), F.col("enc")).alias("unchanged"))


def encrypt_roundtrip(spark, folder):
    enc = encryption.encrypt_columns(_texts(spark, folder), ["text"], _key(spark))
    return encryption.decrypt_columns(enc, ["text"], _key(spark)).select("conv_id", "turn", "text")


def decrypt_wrong_key(spark, folder):
    """The wrong password leaves every token as it is."""
    enc = encryption.encrypt_columns(_texts(spark, folder), ["text"], _key(spark))
    enc = enc.withColumn("enc", F.col("text"))
    out = encryption.decrypt_columns(enc, ["text"], _key(spark, "wrong"))
    return out.select("conv_id", "turn", (F.col("text") == F.col("enc")).alias("untouched"),
                      crypto.is_encrypted(F.col("text")).alias("marked"))


def is_encrypted(spark, folder):
    """Per conversation: does any turn carry the marker?"""
    return encryption.encrypted_documents(_texts(spark, folder), "conv_id")


def encrypt_units(spark, folder):
    """Line units encrypted and decrypted again, one salt for the run."""
    from inkveil.sources.tables import explode_units
    units = explode_units(
        spread(read_table(spark, folder, "conversations", "conv_id", "turn", "text")), "text")
    enc = encryption.encrypt_columns(units, ["text"], _key(spark))
    dec = enc.withColumn("plain", crypto.decrypt_text(F.col("text"), crypto.key_of(_key(spark))))
    return dec.select("conv_id", "turn", F.col("unit_no").cast("bigint").alias("unit_no"), "plain",
                      crypto.is_encrypted(F.col("text")).alias("marked"))


def encrypt_status(spark, folder):
    df = read_table(spark, folder, "part", "p_partkey", "p_brand", "p_size").selectExpr(
        "p_partkey", f"{FILE_NAME} AS path")
    return df.select("p_partkey", encryption.encrypt_status(
        files.file_kind(F.col("path"))).alias("status"))


# ------------------------------------------------------------------- batch

DOC_NAME = (
    "concat('in/doc-', doc_id, element_at(array('.docx', '.pdf', '.xlsx', '.png', '.dat'), "
    "CAST(1 + doc_id % 5 AS INT)))"
)
DOC_META = {"source": ("author", "blank"), "lang": ("geo", "drop"), "n_chars": ("software", "one")}


def _anonymised(spark, folder, rules: RuleSet = ALL_RULES) -> DataFrame:
    docs = spread(read_table(spark, folder, "documents", "doc_id", "lang", "source", "n_chars", "text"))
    docs = docs.withColumn("file", F.expr(DOC_NAME))
    config = AnonymiseConfig(rules=rules, categories=("author", "dates", "software"))
    return batch.anonymise(docs, config, file="file", text="text", meta=DOC_META)


def _flat(m: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("-")))), ";")


def anonymise_batch(spark, folder):
    """Whole result records, maps as text."""
    return _anonymised(spark, folder).select(
        "file", "success", "output_path", _flat("before").alias("before"),
        _flat("removed").alias("removed"), _flat("after").alias("after"),
        _flat("redaction").alias("redaction"), "text_status", "output_text", "error")


def batch_errors(spark, folder):
    failed = reports.split_results(_anonymised(spark, folder, rule_set()))[1]
    return failed.select("file", "error")


def batch_status(spark, folder):
    return reports.batch_status(_anonymised(spark, folder, rule_set()))


QUERIES = {
    "binary_inventory": binary_inventory,
    "stream_redact": stream_redact,
    "detect_type": detect_type,
    "output_names": output_names,
    "bundle_manifest": bundle_manifest,
    "package_parts": package_parts,
    "package_errors": package_errors,
    "anonymise_packages_text": anonymise_packages_text,
    "anonymise_packages_results": anonymise_packages_results,
    "anonymise_packages_after": anonymise_packages_after,
    "package_removed": _package_removed(),
    "package_removed_dates": _package_removed("dates"),
    "package_removed_legacy": _package_removed("author", legacy=True),
    "package_residual": package_residual,
    "mixed_batch_results": mixed_batch_results,
    "encrypt_flags": encrypt_flags,
    "encrypt_roundtrip": encrypt_roundtrip,
    "decrypt_wrong_key": decrypt_wrong_key,
    "is_encrypted": is_encrypted,
    "encrypt_units": encrypt_units,
    "encrypt_status": encrypt_status,
    "anonymise_batch": anonymise_batch,
    "batch_errors": batch_errors,
    "batch_status": batch_status,
}
