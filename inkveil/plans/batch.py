"""The whole job: inspect, strip, redact, encrypt, report; one row per document.

``anonymise`` works on a table with a text column and metadata columns; it is one
projection, so it needs no shuffle and runs on a stream as well.
``anonymise_packages`` works on the parts of office packages.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.config import AnonymiseConfig
from inkveil.functions import crypto, display, spans as S, xmltext as X
from inkveil.operators import metadata, parts as PT, policy as PO, redaction, reports
from inkveil.operators.encryption import encrypt_status
from inkveil.plans.policies import DEFAULT_POLICY, PolicyRow, legacy_gate
from inkveil.session import settled, small_side
from inkveil.sources.files import file_kind
from inkveil.sources.packages import Caps, part_errors, unzip_parts


# ------------------------------------------------------------ plain tables

def strip_column(value: Column, action: str | None) -> Column:
    """Policy action on an ordinary column; a dropped value becomes null."""
    text = value.cast("string")
    return {
        None: text,
        "blank": F.when(text.isNotNull(), F.lit("")),
        "drop": F.lit(None).cast("string"),
        "null": F.lit(None).cast("string"),
        "epoch": F.when(text.isNotNull(), F.lit(C.EPOCH_DATE)),
        "one": F.when(text.isNotNull(), F.lit("1")),
    }[action]


def _as_map(values: Mapping[str, Column]) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def anonymise(
    df: DataFrame, config: AnonymiseConfig, file: str, text: str,
    meta: Mapping[str, tuple[str, str]] | None = None, key: DataFrame | None = None,
    content: str | None = None,
) -> DataFrame:
    """One result row per input row.

    ``meta`` maps a metadata column to its (category, action).  A row that cannot be
    handled is a row with ``success = false`` and an error; the batch goes on.
    """
    meta = meta or {}
    chosen = {c: (act if cat in config.categories else None) for c, (cat, act) in meta.items()}
    after = {c: strip_column(F.col(c), act) for c, act in chosen.items()}
    kind = file_kind(F.col(file), F.col(content) if content else None)
    error = (
        F.when(kind.isNull(), F.concat(F.lit("Unsupported file: "), F.col(file)))
        .when(F.col(text).isNull(), F.lit("no readable text"))
    )
    df = df.withColumns({"_kind": kind, "_error": error})
    # images carry no text: the rules pass them by
    readable = F.col("_error").isNull() & (F.col("_kind") != "image")
    df = df.withColumn("_text", F.when(readable, F.col(text)))
    df = redaction.with_redaction(df, "_text", config.rules, into="_redacted", counts="redaction")
    output = F.when(F.col("_kind") == "image", F.col(text)).otherwise(F.col("_redacted"))
    encrypting = config.encrypt and key is not None
    if encrypting:
        can = F.col("_kind").isin(*C.ENCRYPTABLE_KINDS)
        output = F.when(can, crypto.encrypt_text(output, crypto.key_of(key))).otherwise(output)
        name = F.when(can, display.encrypted_name(display.base_name(F.col(file)))).otherwise(
            display.cleaned_name(display.base_name(F.col(file))))
        encryption = encrypt_status(F.col("_kind"))
    else:
        name = display.cleaned_name(display.base_name(F.col(file)))
        encryption = F.lit("off")
    ok = F.col("_error").isNull()
    before_map, after_map = _as_map({c: F.col(c) for c in meta}), _as_map(after)
    removed = F.map_filter(before_map, lambda k, v: (v != "") & ~v.eqNullSafe(after_map[k]))
    rule_status = (
        F.lit("no_text_rules") if not config.rules
        else F.when(F.col("_kind") == "image", "no_text_rules").otherwise("redacted")
    )
    return df.select(
        display.base_name(F.col(file)).alias("file"),
        ok.alias("success"),
        F.when(ok, name).alias("output_path"),
        F.when(ok, before_map).alias("before"),
        F.when(ok, removed).alias("removed"),
        F.when(ok, after_map).alias("after"),
        F.when(ok, F.col("redaction")).alias("redaction"),
        F.when(ok, rule_status).alias("text_status"),
        F.when(ok, encryption).alias("encryption"),
        F.when(ok, output).alias("output_text"),
        F.col("_error").alias("error"),
    )


def preview(df: DataFrame, n: int, config: AnonymiseConfig, **kwargs) -> DataFrame:
    """Before and after of the first ``n`` rows, nothing written."""
    return anonymise(df.limit(n), config, **kwargs)


# --------------------------------------------------------- office packages

def decrypt_body(parts: DataFrame, key: DataFrame) -> DataFrame:
    """Decrypt the text runs of body parts; with a wrong key every part stays as it is."""
    body = F.col("error").isNull() & _is_body()
    no_texts = F.array().cast("array<string>")
    df = parts.withColumn("_old", F.when(body, X.run_texts(F.col("xml"))).otherwise(no_texts))
    df = df.withColumn("_key", crypto.key_of(key)).withColumn("_new", F.transform(
        "_old", lambda t: crypto.decrypt_text(t, F.col("_key"))))
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return df.withColumn("xml", F.when(same, F.col("xml")).otherwise(
        X.replace_runs(F.col("xml"), F.col("_old"), F.col("_new")))).select(*parts.columns)


class PackageRun:
    """Results of a run over files of any mix; each one is a lazy DataFrame, planned on demand.

    ``parts`` is a stored table of ``sources.packages.unzip_parts`` that went through
    ``metadata.check_parts``: several results are read from it, and its error column alone tells
    the failed files.  A package with an unreadable part is reported and left out of the cleaned
    parts.  PDF files and images have one row without a part; what an extractor read from them
    comes as ``records`` (rows of ``operators.records``) and ``texts`` (path, text; any number of
    rows per PDF file).  Without ``records`` they are reported as failed, never as cleaned.
    """

    def __init__(
        self, parts: DataFrame, config: AnonymiseConfig, key: DataFrame | None = None,
        policy: tuple[PolicyRow, ...] | None = None,
        records: DataFrame | None = None, texts: DataFrame | None = None,
    ):
        self._parts, self._config, self._key = parts, config, key
        self._policy = policy or (legacy_gate() if config.legacy_gate else DEFAULT_POLICY)
        self._records, self._given_texts = records, texts

    @cached_property
    def _others(self) -> DataFrame:
        """(path, kind) of the readable files that are no packages."""
        return self._parts.filter(
            F.col("error").isNull() & ~F.col("kind").isin(*C.PACKAGE_KINDS)).select("path", "kind").distinct()

    @cached_property
    def errors(self) -> DataFrame:
        """``(path, part, error)``"""
        found = part_errors(self._parts)
        if self._records is not None:
            return found
        return found.unionByName(self._others.select(
            "path", F.lit(None).cast("string").alias("part"), F.lit("no metadata records given").alias("error")))

    @cached_property
    def _good(self) -> DataFrame:
        bad = self.errors.select("path").distinct()
        few = small_side(bad)
        return self._parts.filter("part IS NOT NULL").join(bad if few is None else few, "path", "left_anti")

    @cached_property
    def _rows(self) -> DataFrame:
        """The policy as a table."""
        return PO.policy_frame(self._parts.sparkSession, self._policy, self._config.categories)

    @cached_property
    def _read(self) -> DataFrame | None:
        """Records of files that are in the run, joined once for all results; their kind is the file's own."""
        if self._records is None:
            return None
        columns = metadata.META_COLUMNS
        return settled(self._records.drop("kind").join(self._others, "path").select(*columns))

    @cached_property
    def before(self) -> DataFrame:
        """Metadata rows as found."""
        found = metadata.inventory(self._good, settle=True)
        return found if self._read is None else found.unionByName(self._read)

    @cached_property
    def removed(self) -> DataFrame:
        """Values that are in ``before`` and no longer in ``after``, with the action that covers them."""
        return PO.with_action(PO.bag_difference(self.before, self.after), self._rows).drop("category")

    @cached_property
    def residual(self) -> DataFrame:
        """What the cleaned parts still hold of the keys that the policy covers."""
        return PO.residual_metadata(self.after, self._rows)

    @cached_property
    def _edited(self) -> DataFrame:
        return settled(edit_body(
            PT.scrub(self._good, self._config.categories, self._policy), self._config, self._key))

    @cached_property
    def parts(self) -> DataFrame:
        """Cleaned parts; ``sources.packages.zip_parts`` makes packages of them."""
        return self._edited.drop("counts")

    @cached_property
    def _texts(self) -> DataFrame | None:
        """(path, text, counts) of the PDF files in the run, redacted."""
        if self._given_texts is None:
            return None
        mine = self._others.filter("kind = 'pdf'").select("path")
        return redaction.with_redaction(
            self._given_texts.select("path", "text").join(mine, "path", "left_semi"),
            "text", self._config.rules, into="text")

    @cached_property
    def texts(self) -> DataFrame:
        """(path, text): the given texts of PDF files, redacted."""
        if self._texts is None:
            return self._others.limit(0).select("path", F.lit(None).cast("string").alias("text"))
        return self._texts.select("path", "text")

    @cached_property
    def after(self) -> DataFrame:
        """Metadata rows read back from the cleaned parts, and records as the policy leaves them."""
        found = metadata.inventory(self.parts, settle=True)
        return found if self._read is None else found.unionByName(PO.strip(self._read, self._rows))

    @cached_property
    def counts(self) -> DataFrame:
        """``(path, rule, n)``"""
        found = self._edited.select("path", F.explode_outer("counts").alias("rule", "n"))
        if self._texts is not None:
            found = found.unionByName(self._texts.select("path", F.explode_outer("counts").alias("rule", "n")))
        return reports.merge_counts(found.filter("rule IS NOT NULL"), ["path"])

    def _output_name(self, name: Column, kind: Column) -> Column:
        if self._config.encrypt and self._key is not None:
            return F.when(kind.isin(*C.ENCRYPTABLE_KINDS), display.encrypted_name(name)).otherwise(
                display.cleaned_name(name))
        return display.cleaned_name(name)

    @cached_property
    def results(self) -> DataFrame:
        """One row per file, with its number of redactions."""
        failed = self.errors.groupBy("path").agg(F.min("error").alias("error"))
        totals = self.counts.groupBy("path").agg(F.sum("n").alias("redactions"))
        name, ok = display.base_name(F.col("path")), F.col("error").isNull()
        return (
            self._parts.groupBy("path").agg(F.max("kind").alias("kind"))
            .join(failed, "path", "left").join(totals, "path", "left")
            .select(
                "path", name.alias("file"), ok.alias("success"),
                F.when(ok, self._output_name(name, F.col("kind"))).alias("output_path"),
                F.when(ok, F.coalesce("redactions", F.lit(0).cast("bigint"))).alias("redactions"),
                "error")
        )

    @cached_property
    def report(self) -> DataFrame:
        """The full record of every file, whatever its kind, in one schema.

        ``before``, ``removed`` and ``after`` map a surface to its number of values, ``redaction``
        a rule to its number of spans: both sets of names are fixed, so a map stays small however
        much a file holds.  One aggregation over all facts, no join.
        """
        def facts(df: DataFrame, what: str, name: Column, n: Column) -> DataFrame:
            return df.select("path", F.lit(what).alias("what"), name.alias("name"), n.alias("n"))

        none, one = F.lit(None).cast("bigint"), F.lit(1).cast("bigint")
        valued = "value <> ''"
        rows = [
            facts(self._parts, "kind", F.col("kind"), none),
            facts(self.errors, "error", F.col("error"), none),
            facts(self.before.filter(valued), "before", F.col("surface"), one),
            facts(self.removed, "removed", F.col("surface"), F.col("times")),
            facts(self.after.filter(valued), "after", F.col("surface"), one),
            facts(self.counts, "redaction", F.col("rule"), F.col("n")),
        ]
        if self._texts is not None:
            rows.append(facts(self._texts, "text", F.lit(None).cast("string"), none))
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        summed = every.groupBy("path", "what", "name").agg(F.sum("n").alias("n"))

        def held(what: str) -> Column:
            pairs = F.collect_list(F.when(F.col("what") == what, F.struct("name", "n")))
            return F.map_from_entries(F.array_sort(pairs))

        def named(what: str) -> Column:
            return F.min(F.when(F.col("what") == what, F.col("name")))

        maps = ("before", "removed", "after", "redaction")
        found = summed.groupBy("path").agg(
            named("kind").alias("kind"), named("error").alias("error"),
            F.bool_or(F.col("what") == "text").alias("has_text"), *(held(m).alias(m) for m in maps))
        ok, name = F.col("error").isNull(), display.base_name(F.col("path"))
        status = (
            F.when(F.lit(not self._config.rules) | (F.col("kind") == "image"), "no_text_rules")
            .when(F.col("kind").isin(*C.PACKAGE_KINDS) | F.col("has_text"), "redacted").otherwise("no_text"))
        encrypting = self._config.encrypt and self._key is not None
        return found.select(
            "path", name.alias("file"), "kind", ok.alias("success"),
            F.when(ok, self._output_name(name, F.col("kind"))).alias("output_path"),
            *(F.when(ok, F.col(m)).alias(m) for m in maps),
            F.when(ok, status).alias("text_status"),
            F.when(ok, encrypt_status(F.col("kind")) if encrypting else F.lit("off")).alias("encryption"),
            "error")


def _is_body() -> Column:
    """Body parts of text documents and the string cells of workbooks."""
    return PT.is_body_part(F.col("part")) | F.col("part").rlike(C.CELL_PART_PATTERN)


def edit_body(
    parts: DataFrame, config: AnonymiseConfig, key: DataFrame | None = None,
) -> DataFrame:
    """Redact, then encrypt, the text runs of body parts; adds ``counts``.

    A part whose texts do not change keeps its bytes.
    """
    body = F.col("error").isNull() & _is_body()
    charts = F.col("part").startswith(C.CHART_PART_PREFIX)
    no_texts = F.array().cast("array<string>")
    df = parts.withColumn("_xml", F.when(body, X.plain_runs(F.col("xml"))))
    df = df.withColumn("_old", F.when(body, X.run_texts(F.col("_xml"))).otherwise(no_texts))
    if config.rules:
        if config.join_units:
            found = S.joined_spans(F.col("_old"), config.rules)
        else:
            found = F.transform("_old", lambda t: S.find_spans(t, config.rules))
        df = df.withColumn("_spans", found)
        df = df.withColumn("_new", F.zip_with("_old", "_spans", S.redact_spans))
        df = df.withColumn("counts", S.count_spans(F.flatten("_spans"), config.rules))
    else:
        df = df.withColumn("_new", F.col("_old")).withColumn(
            "counts", F.create_map().cast("map<string,bigint>"))
    if config.encrypt and key is not None:
        df = df.withColumn("_key", crypto.key_of(key))
        df = df.withColumn("_new", F.when(charts, F.col("_new")).otherwise(F.transform(
            "_new", lambda t: crypto.encrypt_text(t, F.col("_key")))))
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return df.withColumn(
        "xml", F.when(same, F.col("xml")).otherwise(X.replace_runs(F.col("_xml"), F.col("_old"), F.col("_new")))
    ).select(*parts.columns, "counts")


def anonymise_packages(
    parts: DataFrame, config: AnonymiseConfig, key: DataFrame | None = None,
    policy: tuple[PolicyRow, ...] | None = None,
    records: DataFrame | None = None, texts: DataFrame | None = None,
) -> PackageRun:
    """All steps over the parts of many packages, and over what was read from files of other kinds."""
    return PackageRun(parts, config, key, policy, records, texts)


def anonymise_files(
    files: DataFrame, config: AnonymiseConfig, key: DataFrame | None = None,
    policy: tuple[PolicyRow, ...] | None = None,
    records: DataFrame | None = None, texts: DataFrame | None = None, caps: Caps = Caps(),
) -> PackageRun:
    """The same from ``(path, content)`` of any mix of kinds: one scan opens the packages and routes the rest."""
    parts = settled(metadata.check_parts(unzip_parts(files, caps)))
    return PackageRun(parts, config, key, policy, records, texts)
