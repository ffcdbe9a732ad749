"""DuckDB statements for the text queries.

Written on their own: RE2 patterns, list functions and plain SQL over the tables.
RE2 has no look-around and its word boundary is ASCII; the patterns here use ``\\b``.
"""

from __future__ import annotations

from inkveil.constants import API_KEY_PREFIXES, CONFIDENTIAL_KEYWORDS, CURRENCY_CODES, RULE_ORDER
from workload import planted as P
from workload import text_queries as Q

# White space of the text rules, as an RE2 class body.
SP = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
      r"\x{202f}\x{205f}\x{3000}")
D = r"\p{Nd}"
OCTET = rf"(?:25[0-5]|2[0-4]{D}|[01]?{D}{D}?)"
H = "[A-Fa-f0-9]{1,4}"

RE = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": (rf"\b(?:\+?{D}{{1,3}}[-.{SP}]?)?\(?{D}{{2,4}}\)?[-.{SP}]?{D}{{3,4}}"
              rf"[-.{SP}]?{D}{{3,5}}\b"),
    "nin": rf"\b{D}{{2}}-{D}{{6}}-{D}{{6,7}}-{D}{{2}}\b",
    "credit_card": rf"\b(?:{D}[ -]*?){{13,19}}\b",
    "ip": rf"\b(?:{OCTET}\.){{3}}{OCTET}\b",
    "ip6": rf"\b(?:{H}:){{7}}{H}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
    "api_key": rf"\b(?:{'|'.join(API_KEY_PREFIXES)})[A-Za-z0-9_-]{{8,}}\b",
    "ref_code": rf"\b[A-Z]{{2,}}[-/][A-Za-z0-9]{{2,}}[-/]{D}{{4}}[-/]{D}{{2,}}\b",
    "currency": rf"\b(?:{'|'.join(CURRENCY_CODES)})[{SP}]*[{D},]+(?:\.{D}{{1,2}})?\b",
    "high_entropy": rf"[^{SP}]{{12,}}",
    "confidential": r"[^.!?\n]*[.!?\n]",
}


#: Documents with an address of eight groups, made of the id, behind every third text.
IP_TEXTS = (
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' at fe10:0:0:a' || doc_id % 10 || ':' || doc_id % 999 "
    "|| ':1:22:beef end' ELSE text END AS text FROM documents"
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def luhn(x: str) -> str:
    """Mod-10 over the digits of ``x``, 13 to 19 of them."""
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    rev = f"string_split(reverse({d}), '')"
    return (
        f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform("
        f"range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 "
        f"THEN CAST({rev}[i] AS INT) ELSE (CAST({rev}[i] AS INT) * 2) // 10 "
        f"+ (CAST({rev}[i] AS INT) * 2) % 10 END)) % 10 = 0)"
    )


def high_entropy(x: str) -> str:
    return f"(list_entropy(string_split({x}, '')) > 4.0 + 1e-12)"


def whole_word(x: str, keywords) -> str:
    """Does ``x`` hold one of the phrases as whole words, any case?

    Words are cut at everything that is no letter, number or underscore, so letters
    beyond ASCII count as letters here too.
    """
    words = f"regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+')"
    if all(k.isalpha() for k in keywords):
        return f"list_has_any({words}, [{', '.join(q(k) for k in keywords)}])"
    return f"regexp_matches({x}, {q('(?i)' + chr(92) + 'b(?:' + '|'.join(keywords) + ')' + chr(92) + 'b')})"


def check(rule: str, x: str, keywords) -> str:
    if rule == "credit_card":
        return luhn(x)
    if rule == "high_entropy":
        return high_entropy(x)
    if rule == "confidential":
        return whole_word(x, keywords)
    return "true"


def spans_sql(source: str, key: str, text: str, rules, keywords=CONFIDENTIAL_KEYWORDS) -> str:
    """All matches as rows ``(key, rule, prio, s, e)``: prefix sums over pieces."""
    selects = []
    for prio, rule in enumerate(rules):
        for name in (["ip", "ip6"] if rule == "ip" else [rule]):
            p = q(RE[name])
            selects.append(
                f"SELECT {key}, {q(rule)} AS rule, {prio} AS prio, m, g FROM ("
                f"SELECT {key}, regexp_extract_all({text}, {p}) AS m, "
                f"regexp_split_to_array({text}, {p}) AS g FROM {source}) "
                f"WHERE len(m) > 0"
            )
    hits = " UNION ALL ".join(selects)
    checks = " ".join(
        f"WHEN rule = {q(r)} THEN {check(r, 'x', keywords)}"
        for r in rules if r in ("credit_card", "high_entropy", "confidential")
    )
    guard = f"CASE {checks} ELSE true END" if checks else "true"
    return (
        f"SELECT {key}, rule, prio, s, e FROM ("
        f"SELECT {key}, rule, prio, x, before + gap AS s, before + gap + length(x) AS e FROM ("
        f"SELECT {key}, rule, prio, x, length(y) AS gap, "
        f"coalesce(sum(length(x) + length(y)) OVER (PARTITION BY {key}, rule, form "
        f"ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ("
        f"SELECT {key}, rule, prio, form, unnest(m) AS x, unnest(g[1:len(m)]) AS y, "
        f"generate_subscripts(m, 1) AS i FROM ("
        f"SELECT *, row_number() OVER () AS form FROM ({hits}))))) WHERE {guard}"
    )


def kept_sql(source: str, key: str, text: str, rules, keywords=CONFIDENTIAL_KEYWORDS) -> str:
    """One row per key with the kept spans as a list ``k`` of structs."""
    return (
        f"SELECT {key}, list_reduce(l, lambda acc, x: CASE WHEN len(acc) = 0 "
        f"OR x.s >= acc[-1].e THEN list_append(acc, x) ELSE acc END, "
        f"CAST([] AS STRUCT(s BIGINT, e BIGINT, rule VARCHAR)[])) AS k FROM ("
        f"SELECT {key}, list(struct_pack(s := CAST(s AS BIGINT), e := CAST(e AS BIGINT), "
        f"rule := rule) ORDER BY s, e DESC, prio) AS l "
        f"FROM ({spans_sql(source, key, text, rules, keywords)}) GROUP BY {key})"
    )


def kept_rows(source: str, key: str, text: str, rules, keywords=CONFIDENTIAL_KEYWORDS) -> str:
    return (
        f"SELECT {key}, u.rule AS rule, u.s AS s, u.e AS e FROM ("
        f"SELECT {key}, unnest(k) AS u FROM ({kept_sql(source, key, text, rules, keywords)}))"
    )


def redacted_sql(source: str, key: str, text: str, rules, keywords=CONFIDENTIAL_KEYWORDS) -> str:
    """``(key, text, redacted, k)`` for every row of the source."""
    return (
        f"SELECT t.{key}, t.{text}, CASE WHEN k IS NULL THEN t.{text} ELSE "
        f"array_to_string(list_transform(range(1, len(k) + 1), lambda i: "
        f"substr(t.{text}, (CASE WHEN i = 1 THEN 0 ELSE k[i - 1].e END) + 1, "
        f"k[i].s - (CASE WHEN i = 1 THEN 0 ELSE k[i - 1].e END)) || '[REDACTED]'), '') "
        f"|| substr(t.{text}, k[-1].e + 1) END AS redacted, "
        f"k FROM {source} t LEFT JOIN ({kept_sql(source, key, text, rules, keywords)}) USING ({key})"
    )


def matched(source: str, key: str, text: str, rule: str, re_name: str | None = None) -> str:
    found = f"regexp_extract_all({text}, {q(RE[re_name or rule])})"
    cond = check(rule, "x", CONFIDENTIAL_KEYWORDS)
    if cond != "true":
        found = f"list_filter({found}, lambda x: {cond})"
    return (
        f"SELECT {key}, CAST(len(m) AS BIGINT) AS n, array_to_string(m, '|') AS matches "
        f"FROM (SELECT {key}, {found} AS m FROM {source})"
    )


DEFAULT = Q.DEFAULTS.rules
KEPT_ALL = kept_rows("documents", "doc_id", "text", RULE_ORDER)
KEPT_DEFAULT = kept_rows("documents", "doc_id", "text", DEFAULT)
COUNTS = f"SELECT doc_id, rule, count(*) AS n FROM ({KEPT_ALL}) GROUP BY doc_id, rule"
UNITS = ("SELECT doc_id, unnest(u) AS text, generate_subscripts(u, 1) - 1 AS unit_no "
         "FROM (SELECT doc_id, string_split(text, chr(10)) AS u FROM documents)")
NOT_SPACE = q(rf"[^{SP}]")

# One key column for a conversation turn.
TURNS = "(SELECT {'c': conv_id, 't': turn} AS ct, text FROM conversations)"

_PLANTED_UNION = " UNION ALL ".join(
    f"SELECT {q(r)} AS recipe, {P.RECIPES[r].id} AS id, {P.RECIPES[r].text} AS text, "
    f"{P.RECIPES[r].expected} AS expected FROM {P.RECIPES[r].table}"
    for r in ("currency", "ref_code", "jwt", "api_key", "confidential")
)


def _entropy_planted() -> str:
    return (
        f"SELECT id, CAST(len(m) AS BIGINT) AS n, array_to_string(m, '|') AS matches FROM ("
        f"SELECT {P.TOKEN_ID} AS id, list_filter(string_split({P.TOKEN_TEXT}, ' '), "
        f"lambda x: length(x) >= 12 AND {high_entropy('x')}) AS m FROM {P.TOKEN_TABLE})"
    )


ORACLES: dict[str, str] = {
    "unit_explode": f"SELECT doc_id, CAST(unit_no AS BIGINT) AS unit_no, text FROM ({UNITS})",
    "nonblank_units": (
        f"SELECT doc_id, CAST(unit_no AS BIGINT) AS unit_no, text FROM ({UNITS}) "
        f"WHERE regexp_matches(text, {NOT_SPACE})"),
    "cell_units": (
        "SELECT o_orderkey, 'o_orderstatus' AS column, o_orderstatus AS text FROM orders "
        "UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders"),
    "detect_email": matched("documents", "doc_id", "text", "email"),
    "detect_phone": matched("documents", "doc_id", "text", "phone"),
    "detect_credit_card": matched("documents", "doc_id", "text", "credit_card"),
    "detect_ipv4": matched("documents", "doc_id", "text", "ip"),
    "detect_high_entropy": matched("documents", "doc_id", "text", "high_entropy"),
    "detect_high_entropy_planted": _entropy_planted(),
    **{f"detect_{r}": P.planted_sql(r) for r in P.RECIPES},
    "luhn_valid": (
        f"SELECT id, number, {luhn('number')} AS valid FROM ("
        f"SELECT {P.CARD_ID} AS id, {P.CARD_TEXT} AS number FROM {P.CARD_TABLE})"),
    "token_entropy": (
        f"SELECT doc_id, CAST(i AS BIGINT) AS token_no, token, "
        f"round(list_entropy(string_split(token, '')), 9) AS entropy FROM ("
        f"SELECT doc_id, unnest(m) AS token, generate_subscripts(m, 1) - 1 AS i FROM ("
        f"SELECT doc_id, regexp_extract_all(text, {q(RE['high_entropy'])}) AS m FROM documents))"),
    "keyword_list_parse": (
        "SELECT p_partkey, CAST(i AS BIGINT) AS pos, keyword FROM ("
        "SELECT p_partkey, unnest(l) AS keyword, generate_subscripts(l, 1) - 1 AS i FROM ("
        "SELECT p_partkey, [p_name, p_brand, p_type] AS l FROM part))"),
    "detect_custom_keywords": (
        f"SELECT doc_id, CAST(len(m) AS BIGINT) AS n, array_to_string(m, '|') AS matches FROM ("
        f"SELECT doc_id, list_filter(regexp_extract_all(text, {q(RE['confidential'])}), "
        f"lambda x: {whole_word('x', Q.CUSTOM_KEYWORDS)}) AS m FROM documents)"),
    "docs_with_any_pii": (
        f"SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM ("
        f"{spans_sql('documents', 'doc_id', 'text', DEFAULT)}))"),
    "match_spans": (
        f"SELECT doc_id, rule, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM ("
        f"{spans_sql('documents', 'doc_id', 'text', Q.MATCH_SPAN_RULES.rules)})"),
    "resolve_spans": KEPT_ALL,
    "resolve_spans_card_first": kept_rows("documents", "doc_id", "text", Q.CARD_FIRST.rules),
    "redact_documents": (
        f"SELECT doc_id, redacted, CAST(coalesce(len(k), 0) AS BIGINT) AS n FROM ("
        f"{redacted_sql('documents', 'doc_id', 'text', RULE_ORDER)})"),
    "default_rules_redact": (
        f"SELECT doc_id, redacted, CAST(coalesce(len(k), 0) AS BIGINT) AS n FROM ("
        f"{redacted_sql('documents', 'doc_id', 'text', DEFAULT)})"),
    "redact_conversations": (
        f"SELECT ct.c AS conv_id, ct.t AS turn, redacted, "
        f"CAST(coalesce(len(k), 0) AS BIGINT) AS n FROM ("
        f"{redacted_sql(TURNS, 'ct', 'text', RULE_ORDER, Q.CUSTOM_KEYWORDS)})"),
    "redact_pages": (
        f"SELECT page_id, redacted, CAST(coalesce(len(k), 0) AS BIGINT) AS n FROM ("
        f"{redacted_sql('pages', 'page_id', 'html', RULE_ORDER)})"),
    "redact_planted": (
        f"SELECT recipe, id, CASE WHEN expected = '' THEN text ELSE list_reduce("
        f"string_split(expected, '|'), lambda acc, x: replace(acc, x, '[REDACTED]'), text) "
        f"END AS redacted FROM ({_PLANTED_UNION})"),
    "redact_email_only": (
        f"SELECT doc_id, regexp_replace(text, {q(RE['email'])}, '[REDACTED]', 'g') AS redacted "
        f"FROM documents"),
    "redact_ip_only": (
        f"SELECT doc_id, regexp_replace(regexp_replace(text, {q(RE['ip6'])}, '[REDACTED]', 'g'), "
        f"{q(RE['ip'])}, '[REDACTED]', 'g') AS redacted FROM ({IP_TEXTS})"),
    "redact_noop": "SELECT conv_id, turn, text AS redacted, CAST(0 AS BIGINT) AS n FROM conversations",
    "changed_docs": (
        f"SELECT doc_id, doc_id IN (SELECT doc_id FROM ({KEPT_DEFAULT})) AS changed FROM documents"),
    "display_values": (
        f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN o_orderpriority ELSE '—' END AS shown, "
        f"CASE WHEN o_orderkey % 3 = 0 THEN '—' ELSE o_orderstatus || ', ' || o_orderpriority END "
        f"AS shown_list FROM orders"),
    "rule_counts_by_doc": COUNTS,
    "rule_counts_by_lang": (
        f"SELECT lang, rule, CAST(sum(n) AS BIGINT) AS n FROM ({COUNTS}) "
        f"JOIN documents USING (doc_id) GROUP BY lang, rule"),
    "rule_counts_by_source": (
        f"SELECT source, rule, CAST(sum(n) AS BIGINT) AS n FROM ({COUNTS}) "
        f"JOIN documents USING (doc_id) GROUP BY source, rule"),
    "redaction_summary": (
        f"SELECT doc_id, CAST(coalesce(total, 0) AS BIGINT) AS total, "
        f"CAST(total AS VARCHAR) || ' item(s) redacted (' || parts || ')' AS line FROM documents "
        f"LEFT JOIN (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, "
        f"string_agg(rule || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY rule) AS parts "
        f"FROM ({COUNTS}) GROUP BY doc_id) USING (doc_id)"),
    "pii_profile_rollup": (
        f"SELECT lang, rule, count(DISTINCT doc_id) AS docs, CAST(sum(n) AS BIGINT) AS spans "
        f"FROM ({COUNTS}) JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, rule)"),
    "top_exposed_docs": (
        f"SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM ({COUNTS}) GROUP BY doc_id "
        f"ORDER BY n DESC, doc_id LIMIT 20"),
    "residual_audit": (
        "WITH cleaned AS MATERIALIZED (SELECT doc_id, redacted FROM ("
        + redacted_sql("documents", "doc_id", "text", DEFAULT) + ")) "
        "SELECT rule, count(DISTINCT doc_id) AS docs, count(*) AS spans FROM ("
        + kept_rows("cleaned", "doc_id", "redacted", RULE_ORDER) + ") GROUP BY rule"),
}
