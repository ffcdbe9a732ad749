"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Every pattern is applied so that its work is linear in the text: an address is found from its
``@`` outwards, digit patterns begin only where a run of digits begins.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import arrow_map, prepare, read_table
from inkveil.session import spread

#: Kinds in their order for ties; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "account")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
#: Least and greatest number of characters of an account number.
IBAN_CHARS = range(15, 35)
_ALNUM = re.compile(r"[A-Za-z0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Characters of an account number by the country it begins with.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Words that make a kind likelier (lower case), and how far from a span they are looked for.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax"),
    "iban": ("iban", "bank", "transfer", "bic", "swift"),
    "account": ("card", "visa", "mastercard", "amex", "credit", "payment"),
}
WINDOW = 40
#: Score before any check, what a passed checksum and a context word add, and the least score of an added span.
START = {"email": 0.6, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.3, "account": 0.1}
CHECKED, NEAR, LEAST = 0.4, 0.3, 0.6
_CHECKSUM = frozenset(("card", "iban", "account"))
_WORD = re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)*")


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of international bank account numbers."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each character is looked at a bounded number of times."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = after = m.end()
        else:
            last = at + 1
        at = text.find("@", after)
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Dotted quads whose parts are at most 255; a quad that fails is dropped whole."""
    return [m.span() for m in _IP.finditer(text)
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]


def cards_and_accounts(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Digit runs of 14 to 19 digits, and of 12 or 13 (proposals that need context), both passing Luhn."""
    cards, accounts = [], []
    for m in _DIGITS.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                (cards if len(digits) >= 14 else accounts).append(m.span())
    return cards, accounts


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


def _iban_end(text: str, start: int, end: int) -> int | None:
    """Where the account number that begins at ``start`` ends, at most at ``end``; null if none passes mod-97.

    It ends where no letter or digit follows.  The length of its country is tried first, then
    the others from the longest down, so a word or amount behind it is not taken in.
    """
    head = int("".join(str(int(c, 36)) for c in text[start:start + 4]))  # six digits, which go last
    passing, n, rest = {}, 4, 0
    for i in range(start + 4, end):
        if text[i] != " ":
            value = int(text[i], 36)
            n, rest = n + 1, (rest * (10 if value < 10 else 100) + value) % 97
            if n in IBAN_CHARS and (rest * 1_000_000 + head) % 97 == 1 and not _ALNUM.match(text, i + 1):
                passing[n] = i + 1
    own = IBAN_LENGTH.get(text[start:start + 2])
    return passing.get(own, passing[max(passing)]) if passing else None


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers, leftmost first and without overlap; a start that fails is not looked into again
    before its next word."""
    found, m = [], _IBAN.search(text)
    while m:
        end = _iban_end(text, m.start(), m.end())
        if end is not None:
            found.append((m.start(), end))
        m = _IBAN.search(text, m.start() + 4 if end is None else end)
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """Start value, plus the checksum's and the context's share, at most 1."""
    near = f"{text[max(0, start - WINDOW):start]} {text[end:end + WINDOW]}".lower()
    context = not set(CONTEXT[kind]).isdisjoint(_WORD.findall(near))
    return min(1.0, START[kind] + CHECKED * (kind in _CHECKSUM) + NEAR * context)


def spans(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, end, kind number, score) by start and kind; base kinds always stay, others from LEAST on.

    Offsets are code points.  Null and empty texts have none.
    """
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(s, e, 0) for s, e in emails(text)]
    if "." in text:
        found += [(s, e, 1) for s, e in addresses(text)]
    cards, accounts = cards_and_accounts(text)
    found += [(s, e, 2) for s, e in cards]
    if "+" in text:
        found += [(s, e, 3) for s, e in phones(text)]
    found += [(s, e, 4) for s, e in ibans(text)]
    found += [(s, e, 5) for s, e in accounts]
    scored = [(s, e, k, score(text, KINDS[k], s, e)) for s, e, k in found]
    return sorted(((s, e, k, p) for s, e, k, p in scored if k < len(BASE) or p >= LEAST), key=lambda x: (x[0], x[2]))


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, _ in found)


def redact(text: str, found) -> str:
    """Each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s, e, k, _ in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


SPANS = "doc_id long, spans array<struct<start:int,end:int,kind:string,score:double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) per row, in one pass without a shuffle.

    Null and empty texts have no spans; repeated rows get equal results; other columns are not read.
    """
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = [spans(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"),
                "spans": [[{"start": s, "end": e, "kind": KINDS[k], "score": p} for s, e, k, p in f] for f in found]}

    return arrow_map(spread(docs.select("doc_id", "text")), run, SPANS)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced and n_chars, where there is one, counted anew.

    Null texts stay null; texts without spans and all other columns stay as they are.
    """
    schema = docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            clean = [redact(t, f) if t and (f := spans(t)) else t for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            n = batch.schema.get_field_index("n_chars")
            if n >= 0:
                old = columns[n].to_pylist()
                columns[n] = pa.array([o if a == b else len(b) for a, b, o in zip(texts, clean, old, strict=True)],
                                      batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of find_pii: counts and hash of the base spans, and all spans as text."""
    found = find_pii(read_table(prepare(spark), folder, "documents"))
    as_text = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, as_text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", as_text), ",").alias("spans"))
