"""DuckDB statements for the file, package, encryption and batch queries."""

from __future__ import annotations

from inkveil.constants import DEFAULT_RULES, RULE_ORDER
from workload.metadata_oracles import LINES, TURN_PATH
from workload.text_oracles import ORACLES as TEXT_ORACLES, kept_sql, redacted_sql

STEM = "p_brand || '-' || p_partkey"
EXT = "(['.pdf', '.DOCX', '.xlsx', '.jpeg', '.bin', '', '.txt', '.Png'])[1 + p_partkey % 8]"
KIND = ("CASE p_partkey % 8 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' "
        "WHEN 3 THEN 'image' WHEN 7 THEN 'image' ELSE {other} END")
HEAD_KIND = "CASE p_size % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' END"

TEXT = "CASE WHEN turn % 5 = 4 THEN '  ' WHEN turn % 5 = 3 THEN '⧙ENC:' || text ELSE text END"
BLANK = f"(trim({TEXT}) = '')"

DOC_STEM = "'doc-' || doc_id"
DOC_EXT = "(['.docx', '.pdf', '.xlsx', '.png', '.dat'])[1 + doc_id % 5]"
BAD = "doc_id % 5 = 4"
IMAGE = "doc_id % 5 = 3"

# Body runs: the non-empty lines of a turn, numbered; one key column for both.
RUNS = (
    f"(SELECT {{'p': {TURN_PATH}, 'r': row_number() OVER (PARTITION BY conv_id, turn ORDER BY i0) - 1}} AS pr, "
    f"line AS text FROM {LINES} WHERE line <> '')"
)
PACKAGE_KEYWORDS = ("that", "les", "der")
OTHER = [("word/header1.xml", 1), ("word/footer12.xml", 1), ("word/charts/chart1.xml", 1),
         ("word/styles.xml", 1), ("customXml/item1.xml", 1), ("docs/word/document.xml", 1)]

# Length of a part: its fixed frame and what each line or role adds to it.
_HEAD = len('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>')
_W = len(' xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"')
ESCAPED = ("length(line) + 4 * (length(line) - length(replace(line, '&', ''))) "
           "+ 3 * (length(line) - length(replace(line, '<', ''))) "
           "+ 3 * (length(line) - length(replace(line, '>', '')))")
_P = len('<w:p><w:') + len(' w:id="') + len('" w:author="') + len('" w:date="2024-02-0') + 1 + len(
    'T08:00:00Z"><w:r><w:t xml:space="preserve">') + len('</w:t></w:r></w:') + len('></w:p>')
TAG = "length((['ins', 'del', 'moveTo'])[1 + i0 % 3])"
BODY_LENGTH = (
    f"{_HEAD + len('<w:document') + _W + len('><w:body></w:body></w:document>')} + sum({_P} + 2 * {TAG} "
    f"+ length(CAST(i0 AS VARCHAR)) + length(role) + 2 + {ESCAPED})"
)
_C = (len('<w:comment w:id="') + len('" w:author="') + len('" w:date="2024-01-0') + 1
      + len('T00:00:00Z" w:initials="') + 1 + len('"><w:p><w:r><w:t xml:space="preserve">')
      + len('</w:t></w:r></w:p></w:comment>'))
COMMENTS_LENGTH = (
    f"{_HEAD + len('<w:comments') + _W + len('></w:comments>')} + sum({_C} + length(CAST(i0 AS VARCHAR)) "
    f"+ CASE WHEN i0 % 3 = 2 THEN 0 ELSE length(role) + 2 END + {ESCAPED})"
)
HDR = len('<w:hdr') + _W + len('><w:t></w:t></w:hdr>')
CUT = "conv_id % 10 = 0"

# A mixed batch: one row per file with its maps as text, names in order.
CUT_TURN = "CAST(conv_id AS VARCHAR) LIKE '%0'"
TURN_COUNTS = (
    f"(SELECT conv_id, turn, {TURN_PATH} AS file, {CUT_TURN} AS cut, count(*) AS n, "
    f"count(*) FILTER (WHERE i0 % 3 <> 2) AS named, count(DISTINCT i0 % 5) FILTER (WHERE i0 % 3 <> 2) "
    f"+ count(DISTINCT i0 % 3) FILTER (WHERE i0 % 3 <> 2) AS tracked FROM {LINES} GROUP BY conv_id, turn)"
)
TURN_RULES = (
    f"(SELECT file, string_agg(rule || '=' || n, ';' ORDER BY rule) AS redaction FROM ("
    f"SELECT pr.p AS file, u.rule AS rule, count(*) AS n FROM (SELECT pr, unnest(k) AS u FROM ("
    f"{kept_sql(RUNS, 'pr', 'text', DEFAULT_RULES)})) GROUP BY ALL) GROUP BY file)"
)


def mixed(file: str, kind: str, maps: tuple[str, str, str, str], status: str, source: str, error: str = "NULL") -> str:
    """One row per file of a kind; a failed one has nothing but its error."""
    ok = f"({error}) IS NULL"
    stem = f"regexp_replace({file}, '[.][a-z]+$', '')"
    ext = f"regexp_extract({file}, '[.][a-z]+$')"
    cells = ", ".join(f"CASE WHEN {ok} THEN {m} END AS {name}" for name, m in zip(
        ("before", "removed", "after", "redaction"), maps))
    return (
        f"SELECT {file} AS file, CAST({kind} AS VARCHAR) AS kind, {ok} AS success, "
        f"CASE WHEN {ok} THEN {stem} || '_cleaned' || {ext} END AS output_path, {cells}, "
        f"CASE WHEN {ok} THEN {status} END AS text_status, CASE WHEN {ok} THEN 'off' END AS encryption, "
        f"CAST({error} AS VARCHAR) AS error FROM {source}"
    )


_TURN_BEFORE = "'comments=' || (2 * n + named) || ';tracked_changes=' || tracked"
_BOOK = "'defined_names=1' || CASE WHEN p_partkey % 3 <> 1 THEN ';hidden_sheets=1' ELSE '' END"
_FORM = "CASE WHEN o_orderkey % 3 = 0 THEN 'form=1' ELSE '' END"
_XMP = "CASE WHEN o_orderkey % 2 = 0 THEN ';xmp=1' ELSE '' END"
_IMAGE = (
    "CASE WHEN c_custkey % 3 = 0 THEN 'comment=1;' ELSE '' END || 'exif=2;' "
    "|| CASE WHEN c_custkey % 2 = 0 THEN 'icc_profile=1;' ELSE '' END || 'iptc=2;png_text=1'"
)
MIXED = " UNION ALL ".join((
    mixed("file", "'docx'", (_TURN_BEFORE, _TURN_BEFORE, "'comments=' || n || ';tracked_changes=1'",
                             "coalesce(redaction, '')"), "'redacted'",
          f"{TURN_COUNTS} LEFT JOIN {TURN_RULES} USING (file)",
          "CASE WHEN cut THEN 'BadZipFile: File is not a zip file' END"),
    mixed("'book-' || p_partkey || '.xlsx'", "'xlsx'", (_BOOK, _BOOK, "''", "''"), "'redacted'", "part"),
    mixed("'order-' || o_orderkey || '.pdf'", "'pdf'", (
        f"'annotation=3;' || CASE WHEN {_FORM} <> '' THEN {_FORM} || ';' ELSE '' END || 'info=5' || {_XMP}",
        f"'annotation=3;info=5' || {_XMP}", _FORM, "CASE WHEN o_orderkey % 2 = 0 THEN 'email=1' ELSE '' END"),
        "CASE WHEN o_orderkey % 2 = 0 THEN 'redacted' ELSE 'no_text' END", "orders"),
    mixed("'image-' || c_custkey || '.jpg'", "'image'", (_IMAGE, _IMAGE, "''", "''"), "'no_text_rules'", "customer"),
    mixed("'note-' || p_partkey || '.txt'", "NULL", ("''", "''", "''", "''"), "''", "part",
          "'Unsupported file: note-' || p_partkey || '.txt'"),
))

ORACLES: dict[str, str] = {
    "binary_inventory": (
        "SELECT coalesce(nullif(role, ''), '__HIVE_DEFAULT_PARTITION__') AS role, 'txt' AS ext, false AS supported, "
        "CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS n_bytes, "
        "CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS n_read FROM conversations GROUP BY 1"),
    "stream_redact": TEXT_ORACLES["redact_conversations"],
    "mixed_batch_results": MIXED,
    "detect_type": f"SELECT p_partkey, {KIND.format(other=HEAD_KIND)} AS kind FROM part",
    "output_names": (
        f"SELECT p_partkey, {STEM} || '_cleaned' || {EXT} AS cleaned, "
        f"{STEM} || '_encrypted' || {EXT} AS encrypted, "
        f"{STEM} || '_anonymized' || CASE WHEN p_size % 2 = 0 THEN '_encrypted' ELSE '' END || {EXT} AS download, "
        f"{STEM} || {EXT} AS original FROM part"),
    "bundle_manifest": (
        f"SELECT p_partkey, {STEM} || tag || {EXT} AS file FROM part, "
        f"(SELECT unnest(['_cleaned', '_encrypted']) AS tag) WHERE p_partkey % 8 <> 5"),
    "package_parts": (
        f"SELECT {TURN_PATH} AS path, 'word/document.xml' AS part, CAST({BODY_LENGTH} AS BIGINT) AS n_chars, "
        f"false AS failed FROM {LINES} WHERE NOT ({CUT}) GROUP BY conv_id, turn, role UNION ALL "
        f"SELECT {TURN_PATH}, 'word/comments.xml', CAST({COMMENTS_LENGTH} AS BIGINT), false "
        f"FROM {LINES} WHERE NOT ({CUT}) GROUP BY conv_id, turn, role UNION ALL "
        f"SELECT {TURN_PATH}, unnest([{', '.join(chr(39) + p + chr(39) for p, _ in OTHER)}]), "
        f"{HDR} + length(role), false FROM conversations WHERE NOT ({CUT}) UNION ALL "
        f"SELECT {TURN_PATH}, '', 0, true FROM conversations WHERE {CUT}"),
    "package_errors": f"SELECT {TURN_PATH} AS path, true AS whole FROM conversations WHERE {CUT}",
    "anonymise_packages_text": (
        f"SELECT pr.p AS path, pr.r AS run_no, redacted AS text FROM ("
        f"{redacted_sql(RUNS, 'pr', 'text', RULE_ORDER, PACKAGE_KEYWORDS)})"),
    "anonymise_packages_results": (
        f"SELECT file, true AS success, replace(file, '.docx', '_cleaned.docx') AS output_path, "
        f"CAST(coalesce(n, 0) AS BIGINT) AS redactions, CAST(NULL AS VARCHAR) AS error FROM ("
        f"SELECT {TURN_PATH} AS file FROM conversations) LEFT JOIN ("
        f"SELECT pr.p AS file, sum(len(k)) AS n FROM ("
        f"{kept_sql(RUNS, 'pr', 'text', RULE_ORDER, PACKAGE_KEYWORDS)}) GROUP BY 1) USING (file)"),
    "anonymise_packages_after": (
        f"SELECT 'comments' AS surface, 'date' AS key, '1970-01-01T00:00:00Z' AS value, "
        f"count(*) AS packages FROM conversations UNION ALL "
        f"SELECT 'tracked_changes', 'date', '1970-01-01T00:00:00Z', count(*) FROM conversations"),
    "encrypt_flags": (
        f"SELECT conv_id, turn, NOT ({BLANK} OR turn % 5 = 3) AS is_token, "
        f"CASE WHEN {BLANK} OR turn % 5 = 3 THEN {TEXT} END AS unchanged FROM conversations"),
    "encrypt_roundtrip": f"SELECT conv_id, turn, {TEXT} AS text FROM conversations",
    "decrypt_wrong_key": (
        f"SELECT conv_id, turn, true AS untouched, NOT {BLANK} AS marked FROM conversations"),
    "is_encrypted": (
        "SELECT conv_id, bool_or(turn % 5 = 3) AS encrypted FROM conversations GROUP BY conv_id"),
    "encrypt_units": (
        f"SELECT conv_id, turn, i0 AS unit_no, line AS plain, trim(line) <> '' AS marked FROM {LINES}"),
    "encrypt_status": (
        "SELECT p_partkey, CASE WHEN p_partkey % 8 IN (1, 2) THEN 'encrypted' "
        "ELSE 'skipped_unsupported' END AS status FROM part"),
    "anonymise_batch": (
        f"SELECT {DOC_STEM} || {DOC_EXT} AS file, NOT ({BAD}) AS success, "
        f"CASE WHEN NOT ({BAD}) THEN {DOC_STEM} || '_cleaned' || {DOC_EXT} END AS output_path, "
        f"CASE WHEN NOT ({BAD}) THEN 'lang=' || lang || ';n_chars=' || n_chars || ';source=' || source END AS before, "
        f"CASE WHEN NOT ({BAD}) THEN CASE WHEN n_chars = 1 THEN '' ELSE 'n_chars=' || n_chars || ';' END || 'source=' || source END AS removed, "
        f"CASE WHEN NOT ({BAD}) THEN 'lang=' || lang || ';n_chars=1;source=' END AS after, "
        f"CASE WHEN NOT ({BAD}) THEN CASE WHEN {IMAGE} THEN '' ELSE coalesce(counts, '') END END AS redaction, "
        f"CASE WHEN NOT ({BAD}) THEN CASE WHEN {IMAGE} THEN 'no_text_rules' ELSE 'redacted' END END AS text_status, "
        f"CASE WHEN NOT ({BAD}) THEN CASE WHEN {IMAGE} THEN d.text ELSE redacted END END AS output_text, "
        f"CASE WHEN {BAD} THEN 'Unsupported file: in/' || {DOC_STEM} || {DOC_EXT} END AS error "
        f"FROM documents d JOIN (SELECT doc_id, redacted FROM ("
        f"{redacted_sql('documents', 'doc_id', 'text', RULE_ORDER)})) USING (doc_id) "
        f"LEFT JOIN (SELECT doc_id, string_agg(rule || '=' || n, ';' ORDER BY rule) AS counts FROM ("
        f"SELECT doc_id, u.rule AS rule, count(*) AS n FROM (SELECT doc_id, unnest(k) AS u FROM ("
        f"{kept_sql('documents', 'doc_id', 'text', RULE_ORDER)})) GROUP BY ALL) GROUP BY doc_id) USING (doc_id)"),
    "batch_errors": (
        f"SELECT {DOC_STEM} || {DOC_EXT} AS file, 'Unsupported file: in/' || {DOC_STEM} || {DOC_EXT} AS error "
        f"FROM documents WHERE {BAD}"),
    "batch_status": (
        f"SELECT NOT ({BAD}) AS success, count(*) AS n FROM documents GROUP BY 1"),
}
