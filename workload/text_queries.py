"""Queries over text columns: units, detectors, spans, redaction, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.config import ALL_RULES, RuleSet, rule_set
from inkveil.functions import detect, display, spans as S
from inkveil.operators import redaction, reports
from inkveil.session import spread
from inkveil.sources import tables
from workload import planted as P

DEFAULTS = rule_set()
CUSTOM_KEYWORDS = ("that", "les", "der")

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return spread(tables.read_table(spark, folder, "documents", "doc_id", *more, "text"))


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spread(tables.read_table(spark, folder, "conversations", "conv_id", "turn", "text"))


# ------------------------------------------------------------------- units

def unit_explode(spark, folder):
    return tables.explode_units(_documents(spark, folder), "text").select(
        "doc_id", F.col("unit_no").cast("bigint").alias("unit_no"), "text")


def nonblank_units(spark, folder):
    return tables.drop_blank(unit_explode(spark, folder), "text")


def cell_units(spark, folder):
    orders = tables.read_table(
        spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return tables.cell_units(orders, ["o_orderkey"])


# --------------------------------------------------------------- detectors

def _found(df: DataFrame, key: str, matches: Column) -> DataFrame:
    """Count and matched strings per text."""
    return df.withColumn("_m", matches).select(
        key, F.size("_m").cast("bigint").alias("n"),
        F.array_join("_m", "|").alias("matches"))


def _detect_documents(rule: str, matches: Callable[[Column], Column] | None = None) -> Query:
    def query(spark, folder):
        find = matches or (lambda t: detect.matches(t, rule))
        return _found(_documents(spark, folder), "doc_id", find(F.col("text")))
    return query


def _detect_planted(rule: str, matches: Callable[[Column], Column] | None = None) -> Query:
    def query(spark, folder):
        find = matches or (lambda t: detect.matches(t, rule))
        return _found(P.planted(spark, folder, rule), "id", find(F.col("text")))
    return query


def _form(pattern: str) -> Callable[[Column], Column]:
    return lambda t: detect.pattern_matches(t, pattern)


def detect_high_entropy_planted(spark, folder):
    df = tables.read_table(spark, folder, P.TOKEN_TABLE).selectExpr(
        f"{P.TOKEN_ID} AS id", f"{P.TOKEN_TEXT} AS text")
    return _found(df, "id", detect.matches(F.col("text"), "high_entropy"))


def detect_custom_keywords(spark, folder):
    rules = rule_set(["confidential"], keywords=CUSTOM_KEYWORDS)
    return _found(_documents(spark, folder), "doc_id",
                  detect.matches(F.col("text"), "confidential", rules))


def luhn_valid(spark, folder):
    return tables.read_table(spark, folder, P.CARD_TABLE).selectExpr(
        f"{P.CARD_ID} AS id", f"{P.CARD_TEXT} AS number",
    ).withColumn("valid", detect.luhn_valid(F.col("number")))


def token_entropy(spark, folder):
    return (
        _documents(spark, folder)
        .select("doc_id", F.posexplode(detect.tokens(F.col("text"))).alias("token_no", "token"))
        .select("doc_id", F.col("token_no").cast("bigint").alias("token_no"), "token",
                F.round(detect.shannon_entropy(F.col("token")), 9).alias("entropy"))
    )


def keyword_list_parse(spark, folder):
    raw = tables.read_table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return raw.select("p_partkey", F.posexplode(display.parse_keyword_list(F.concat(
        F.lit(" "), "p_name", F.lit(" ,, "), "p_brand", F.lit(",  ,"), "p_type", F.lit(" ,"),
    ))).alias("pos", "keyword")).withColumn("pos", F.col("pos").cast("bigint"))


def docs_with_any_pii(spark, folder):
    docs = _documents(spark, folder, "lang", "source")
    return docs.filter(detect.has_any(F.col("text"), DEFAULTS)).select("doc_id", "lang", "source")


# ------------------------------------------------------------------- spans

MATCH_SPAN_RULES = rule_set(["email", "phone", "credit_card", "ip", "high_entropy"])


def match_spans(spark, folder):
    docs = _documents(spark, folder).withColumn(
        "spans", S.all_spans(F.col("text"), MATCH_SPAN_RULES))
    return redaction.explode_spans(docs, ["doc_id"])


def resolve_spans(spark, folder):
    docs = redaction.scan(_documents(spark, folder), "text", ALL_RULES)
    return redaction.explode_spans(docs, ["doc_id"])


CARD_FIRST = rule_set(order=("credit_card", "ip"))


def resolve_spans_card_first(spark, folder):
    """The other tie order: cards and addresses before phones."""
    docs = redaction.scan(_documents(spark, folder), "text", CARD_FIRST)
    return redaction.explode_spans(docs, ["doc_id"])


def redact_documents(spark, folder):
    out = redaction.with_redaction(_documents(spark, folder), "text", ALL_RULES)
    return out.select("doc_id", "redacted", reports.total_redactions(F.col("counts")).alias("n"))


def default_rules_redact(spark, folder):
    out = redaction.with_redaction(_documents(spark, folder), "text", DEFAULTS)
    return out.select("doc_id", "redacted", reports.total_redactions(F.col("counts")).alias("n"))


def redact_conversations(spark, folder):
    """All rules with custom keywords, so that whole sentences go too."""
    rules = rule_set(C.RULE_ORDER, keywords=CUSTOM_KEYWORDS)
    out = redaction.with_redaction(_conversations(spark, folder), "text", rules)
    return out.select("conv_id", "turn", "redacted",
                      reports.total_redactions(F.col("counts")).alias("n"))


def redact_pages(spark, folder):
    pages = spread(tables.read_table(spark, folder, "pages", "page_id", "html"))
    out = redaction.with_redaction(pages, "html", ALL_RULES)
    return out.select("page_id", "redacted", reports.total_redactions(F.col("counts")).alias("n"))


def redact_planted(spark, folder):
    """Every planted text through all rules at once."""
    parts = [
        P.planted(spark, folder, r).select(F.lit(r).alias("recipe"), "id", "text")
        for r in ("currency", "ref_code", "jwt", "api_key", "confidential")
    ]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    rules = rule_set(["jwt", "api_key", "ref_code", "currency", "confidential"])
    out = redaction.with_redaction(df, "text", rules)
    return out.select("recipe", "id", "redacted")


def redact_ip_only(spark, folder):
    """Both written forms; every third document has an address of eight groups behind its text."""
    doc = F.col("doc_id")
    tail = F.concat(F.lit(" at fe10:0:0:a"), doc % 10, F.lit(":"), doc % 999, F.lit(":1:22:beef end"))
    docs = _documents(spark, folder).withColumn(
        "text", F.when(doc % 3 == 0, F.concat("text", tail)).otherwise(F.col("text")))
    out = redaction.with_redaction(docs, "text", rule_set(["ip"]), counts=None)
    return out.select("doc_id", "redacted")


def redact_email_only(spark, folder):
    out = redaction.with_redaction(_documents(spark, folder), "text", rule_set(["email"]), counts=None)
    return out.select("doc_id", "redacted")


def redact_noop(spark, folder):
    out = redaction.with_redaction(_conversations(spark, folder), "text", rule_set([]))
    return out.select("conv_id", "turn", "redacted",
                      reports.total_redactions(F.col("counts")).alias("n"))


def changed_docs(spark, folder):
    out = redaction.with_redaction(_documents(spark, folder), "text", DEFAULTS, counts=None)
    return redaction.with_changed(out, "text", "redacted").select("doc_id", "changed")


def display_values(spark, folder):
    orders = tables.read_table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    value = F.expr(DISPLAY_VALUE)
    return orders.select(
        "o_orderkey",
        display.display_value(value).alias("shown"),
        display.display_list(F.expr(
            "CASE WHEN o_orderkey % 3 = 0 THEN array() "
            "ELSE array(o_orderstatus, o_orderpriority) END")).alias("shown_list"),
    )


DISPLAY_VALUE = (
    "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'None' WHEN 2 THEN '  ' "
    "ELSE o_orderpriority END"
)


# ----------------------------------------------------------------- reports

def _doc_counts(spark, folder, *more: str, rules: RuleSet = ALL_RULES) -> DataFrame:
    return reports.counts_by_row(
        _documents(spark, folder, *more), "text", rules, ["doc_id", *more])


def rule_counts_by_doc(spark, folder):
    return _doc_counts(spark, folder)


def rule_counts_by_lang(spark, folder):
    return reports.merge_counts(_doc_counts(spark, folder, "lang"), ["lang"])


def rule_counts_by_source(spark, folder):
    return reports.merge_counts(_doc_counts(spark, folder, "source"), ["source"])


def redaction_summary(spark, folder):
    out = redaction.with_redaction(_documents(spark, folder), "text", ALL_RULES)
    return out.select(
        "doc_id", reports.total_redactions(F.col("counts")).alias("total"),
        reports.summary_line(F.col("counts")).alias("line"))


def pii_profile_rollup(spark, folder):
    return reports.profile(_doc_counts(spark, folder, "lang"), "lang", "doc_id")


def top_exposed_docs(spark, folder):
    return reports.top_exposed(_doc_counts(spark, folder), "doc_id", 20)


def residual_audit(spark, folder):
    """Redact with the default rules, then look again with all of them."""
    out = redaction.with_redaction(_documents(spark, folder), "text", DEFAULTS, counts=None)
    return reports.residual_audit(out.select("redacted"), "redacted", ALL_RULES)


QUERIES: dict[str, Query] = {
    "unit_explode": unit_explode,
    "nonblank_units": nonblank_units,
    "cell_units": cell_units,
    "detect_email": _detect_documents("email"),
    "detect_phone": _detect_documents("phone"),
    "detect_nin": _detect_planted("nin"),
    "detect_credit_card": _detect_documents("credit_card"),
    "luhn_valid": luhn_valid,
    "detect_ipv4": _detect_documents("ip", _form(C.IPV4_PATTERN)),
    "detect_ipv6": _detect_planted("ipv6", _form(C.IPV6_PATTERN)),
    "detect_jwt": _detect_planted("jwt"),
    "detect_api_key": _detect_planted("api_key"),
    "detect_ref_code": _detect_planted("ref_code"),
    "detect_currency": _detect_planted("currency"),
    "detect_high_entropy": _detect_documents("high_entropy"),
    "detect_high_entropy_planted": detect_high_entropy_planted,
    "token_entropy": token_entropy,
    "detect_confidential": _detect_planted("confidential"),
    "keyword_list_parse": keyword_list_parse,
    "detect_custom_keywords": detect_custom_keywords,
    "docs_with_any_pii": docs_with_any_pii,
    "match_spans": match_spans,
    "resolve_spans": resolve_spans,
    "resolve_spans_card_first": resolve_spans_card_first,
    "redact_documents": redact_documents,
    "default_rules_redact": default_rules_redact,
    "redact_conversations": redact_conversations,
    "redact_pages": redact_pages,
    "redact_planted": redact_planted,
    "redact_email_only": redact_email_only,
    "redact_ip_only": redact_ip_only,
    "redact_noop": redact_noop,
    "changed_docs": changed_docs,
    "display_values": display_values,
    "rule_counts_by_doc": rule_counts_by_doc,
    "rule_counts_by_lang": rule_counts_by_lang,
    "rule_counts_by_source": rule_counts_by_source,
    "redaction_summary": redaction_summary,
    "pii_profile_rollup": pii_profile_rollup,
    "top_exposed_docs": top_exposed_docs,
    "residual_audit": residual_audit,
}
