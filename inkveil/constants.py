"""Fixed values.

Everything in this module is data that decides results: labels, word lists,
pattern texts, field lists and formats.  No logic lives here.
"""

# --------------------------------------------------------------------------
# Labels and rule names
# --------------------------------------------------------------------------

REDACTED_LABEL = "[REDACTED]"

# Tie order: on equal start and equal end the earlier name wins.
RULE_ORDER = (
    "email", "phone", "nin", "credit_card", "ip", "jwt", "api_key",
    "ref_code", "currency", "high_entropy", "confidential",
)

# Rules that are switched on unless the caller says otherwise.
DEFAULT_RULES = (
    "email", "phone", "nin", "credit_card", "ip", "ref_code", "currency",
)

# --------------------------------------------------------------------------
# Character classes.  Text rules are Unicode-aware: a word
# character is any letter, any number or the underscore, a digit is any decimal
# digit, white space is the Unicode set plus the four ASCII separators.  They
# are spelled out so that results do not depend on the JDK's meaning of \b.  U+10000 is
# a letter like others; written out it makes the JDK's look-behind step over whole code
# points instead of half a surrogate pair.
# --------------------------------------------------------------------------

WORD_CHARS = "\\p{L}\\p{N}_\U00010000"
WORD = f"[{WORD_CHARS}]"
DIGIT = r"\p{Nd}"
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Zero-width word boundary; START / STOP are the cheaper halves for use next to a
# character that is known to be a word character.  A pattern may open with a plain
# look-ahead on its first characters: same matches, but most positions fail cheaply.
START = rf"(?<!{WORD})"
STOP = rf"(?!{WORD})"
EDGE = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"

# --------------------------------------------------------------------------
# Detection patterns
# --------------------------------------------------------------------------

# A long run that no address follows is matched as a whole and dropped afterwards (no "@"):
# its later positions would fail the same way, each after a scan to the run's end.
EMAIL_PATTERN = (
    rf"{EDGE}(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{STOP}|[A-Za-z0-9._%+-]{{64,}}+)"
)
PHONE_PATTERN = (
    rf"(?=[+(\p{{Nd}}]){EDGE}(?:\+?{DIGIT}{{1,3}}[-.{SPACE_CHARS}]?)?"
    rf"\(?{DIGIT}{{2,4}}\)?[-.{SPACE_CHARS}]?{DIGIT}{{3,4}}"
    rf"[-.{SPACE_CHARS}]?{DIGIT}{{3,5}}{STOP}"
)
NIN_PATTERN = (
    rf"(?={DIGIT}{{2}}-){START}{DIGIT}{{2}}-{DIGIT}{{6}}-{DIGIT}{{6,7}}-{DIGIT}{{2}}{STOP}"
)
CARD_PATTERN = rf"(?={DIGIT}){START}(?:{DIGIT}[ -]*?){{13,19}}{EDGE}"

OCTET = rf"(?:25[0-5]|2[0-4]{DIGIT}|[01]?{DIGIT}{DIGIT}?)"
IPV4_PATTERN = rf"(?={DIGIT}){START}(?:{OCTET}\.){{3}}{OCTET}{STOP}"

# Longest written form first; "::" may open or close an address.
HEXTET = "[A-Fa-f0-9]{1,4}"
IPV6_PATTERN = (
    rf"(?=[A-Fa-f0-9]{{0,4}}:)(?<![{WORD_CHARS}:])(?:"
    rf"[Ff][Ee]80:(?::{HEXTET}){{0,4}}%[0-9a-zA-Z]+"
    rf"|(?:{HEXTET}:){{7}}{HEXTET}(?!\.{DIGIT})"
    rf"|(?:{HEXTET}:){{1,1}}(?::{HEXTET}){{1,6}}(?!\.{DIGIT})"
    rf"|(?:{HEXTET}:){{1,2}}(?::{HEXTET}){{1,5}}(?!\.{DIGIT})"
    rf"|(?:{HEXTET}:){{1,3}}(?::{HEXTET}){{1,4}}(?!\.{DIGIT})"
    rf"|(?:{HEXTET}:){{1,4}}(?::{HEXTET}){{1,3}}(?!\.{DIGIT})"
    rf"|(?:{HEXTET}:){{1,5}}(?::{HEXTET}){{1,2}}(?!\.{DIGIT})"
    rf"|(?:{HEXTET}:){{1,6}}:{HEXTET}(?!\.{DIGIT})"
    rf"|:(?::{HEXTET}){{1,7}}(?!\.{DIGIT})"
    rf"|(?:{HEXTET}:){{1,7}}:(?!:)"
    rf"){STOP}"
)

# A long run without the other two segments is matched as a whole and dropped afterwards (no "."):
# its later starts would fail the same way, each after a scan to the run's end.
JWT_PATTERN = (
    rf"(?=eyJ){START}eyJ(?:[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+{EDGE}|[A-Za-z0-9_-]{{61,}}+)"
)
# longer ones first where one begins another
API_KEY_PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AKIA", "AKI")
API_KEY_PATTERN = (
    rf"(?=[spgA]){START}(?:{'|'.join(API_KEY_PREFIXES)})"
    rf"[A-Za-z0-9_-]{{8,}}{EDGE}"
)
REF_CODE_PATTERN = (
    rf"(?=[A-Z]{{2}}){START}[A-Z]{{2,}}[-/][A-Za-z0-9]{{2,}}[-/]{DIGIT}{{4}}[-/]{DIGIT}{{2,}}{STOP}"
)
CURRENCY_CODES = (
    "UGX", "USD", "EUR", "KES", "GBP", "JPY", "CNY", "ZAR", "NGN", "TZS",
    "RWF", "BIF", "SSP", "CDF", "ETB", "AUD", "CAD", "CHF", "INR", "SAR",
    "AED", "MXN", "BRL", "GHS", "ZMW", "MZN", "AOA",
)
CURRENCY_PATTERN = (
    rf"(?=[A-Z]{{3}}){START}(?:{'|'.join(CURRENCY_CODES)})"
    rf"[{SPACE_CHARS}]*[{DIGIT},]+(?:\.{DIGIT}{{1,2}})?{EDGE}"
)

TOKEN_PATTERN = rf"(?=\S{{12}})[^{SPACE_CHARS}]{{12,}}"
ENTROPY_LIMIT = 4.0
# More than 4 bits per character takes at least 17 different characters.
ENTROPY_MIN_CHARS = 17
LONG_TOKEN_PATTERN = rf"(?=\S{{17}})[^{SPACE_CHARS}]{{17,}}"

# A sentence runs up to and including its terminator; \G keeps the scan linear
# on a long tail that has none (sentences always touch each other).
SENTENCE_PATTERN = r"\G[^.!?\n]*+[.!?\n]"

CONFIDENTIAL_KEYWORDS = (
    "confidential", "secret", "classified",
    "internal only", "internal review", "internal use only",
    "not for distribution", "not for circulation",
    "not for external circulation", "not for external distribution",
    "private", "proprietary",
    "password", "passwd", "pwd",
    "bank account", "account number", "routing number",
    "salary", "compensation", "bonus",
    "ssn", "social security", "passport",
    "national id", "driver license", "drivers license",
    "patient", "medical record", "diagnosis",
    "trade secret", "nda", "non-disclosure",
    "access code", "pin", "security code",
    "cvv", "cvc",
    "username", "login",
    "date of birth", "dob",
    "top secret", "restricted",
    "cabinet", "budget allocation",
    "internal briefing", "internal memo",
)

# --------------------------------------------------------------------------
# Files and packages
# --------------------------------------------------------------------------

KIND_BY_EXTENSION = {
    "pdf": "pdf", "docx": "docx", "xlsx": "xlsx",
    "jpg": "image", "jpeg": "image", "png": "image",
    "tiff": "image", "tif": "image", "bmp": "image",
}
PACKAGE_KINDS = ("docx", "xlsx")
PDF_MAGIC = b"%PDF"
ZIP_MAGIC = b"PK\x03\x04"

CLEANED_SUFFIX = "_cleaned"
ENCRYPTED_SUFFIX = "_encrypted"
DOWNLOAD_SUFFIX = "_anonymized"
BUNDLE_PATTERN = r"_(cleaned|encrypted)\."
EMPTY_DISPLAY = "—"

BODY_PART_PATTERN = r"^word/(document|(header|footer)\d*)\.xml$"
CHART_PART_PREFIX = "word/charts/"
# shared strings, and sheets for their inline and formula strings
CELL_PART_PATTERN = r"^xl/(sharedStrings|worksheets/[^/]+)\.xml$"
CUSTOM_XML_PREFIX = "customxml/"

# --------------------------------------------------------------------------
# Metadata field lists
# --------------------------------------------------------------------------

CATEGORIES = ("author", "dates", "geo", "software")

# element name in docProps/core.xml -> key of the text-document record
DOCX_CORE_STRINGS = {
    "creator": "author", "category": "category", "description": "comments",
    "contentStatus": "content_status", "identifier": "identifier",
    "keywords": "keywords", "language": "language",
    "lastModifiedBy": "last_modified_by", "subject": "subject",
    "title": "title", "version": "version",
}
DOCX_CORE_DATES = {
    "created": "created", "modified": "modified", "lastPrinted": "last_printed",
}
XLSX_CORE_STRINGS = (
    "creator", "lastModifiedBy", "category", "contentStatus", "description",
    "identifier", "keywords", "language", "subject", "title", "version",
)
XLSX_CORE_DATES = ("created", "modified", "lastPrinted")
CORE_INTEGERS = ("revision",)

TRACKED_CHANGE_TAGS = (
    "ins", "del", "rPrChange", "pPrChange", "tblPrChange",
    "tcPrChange", "trPrChange", "sectPrChange", "numberingChange",
)
APP_FIELDS = {"Company": "company", "Manager": "manager"}

PDF_INFO_FIELDS = ("Author", "Title", "Subject", "Creator", "Producer", "Keywords")
PDF_DATE_FIELDS = ("CreationDate", "ModDate")

PNG_TEXT_KEYS = (
    "Title", "Author", "Description", "Copyright", "Creation Time",
    "Software", "Disclaimer", "Warning", "Source", "Comment",
)
IPTC_NAMES = {
    "2#025": "Model", "2#080": "Byline", "2#110": "Credit",
    "2#116": "Copyright", "2#120": "Caption", "2#122": "CaptionWriter",
}
SENSITIVE_EXIF = (
    "GPSInfo", "Make", "Model", "Software", "Artist", "Copyright",
    "XPAuthor", "HostComputer", "GPSLatitude", "GPSLongitude",
)

EPOCH_DATE = "1970-01-01T00:00:00Z"

# --------------------------------------------------------------------------
# encryption
# --------------------------------------------------------------------------

ENC_PREFIX = "⧙ENC:"
ENC_SUFFIX = ":ENC⧘"
KDF_ITERATIONS = 200_000
KEY_BYTES = 32
SALT_BYTES = 16
SALT_PART = "encryption_salt.bin"
ENCRYPTABLE_KINDS = ("docx", "xlsx")
