"""XML part text as typed tokens: one pattern cuts a part once, everything else reads the tokens.

A comment, marked section or processing instruction is one token whatever it holds, so a tag name
or a section mark inside one is never taken for markup.  The tokens of any text, well-formed or
not, join to that text again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.detect import let

_NAME = r"[^\s<>/!?\"'=]++"
_ATTRIBUTE = r"\s++[^\s=>/\"']++\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+')"
# possessive throughout: a token is found in one scan and never given back
TOKEN = (
    r"<!--(?:[^-]++|-(?!->))*+-->"
    r"|<!\[CDATA\[(?:[^\]]++|\](?!\]>))*+\]\]>"
    r"|<\?(?:[^?]++|\?(?!>))*+\?>"
    rf"|</?{_NAME}(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|[^<]++|<"
)
#: Declarations, comments and sections, without which a part is plain as it stands.
_SPECIAL = r"<!|<\?(?!xml\s)"


def tokens(xml: Column) -> Column:
    """The part as an array of strings that join to it again; null: null."""
    return F.regexp_extract_all(xml, F.lit(f"(?s){TOKEN}"), F.lit(0))


def kind(token: Column) -> Column:
    """``comment``, ``cdata``, ``instruction``, ``close``, ``empty``, ``open`` or ``text``; a stray ``<`` is text."""
    return (
        F.when(token.startswith("<!--"), "comment")
        .when(token.startswith("<![CDATA["), "cdata")
        .when(token.startswith("<?"), "instruction")
        .when(token.startswith("</"), "close")
        .when(token.startswith("<") & token.endswith("/>"), "empty")
        .when(token.startswith("<") & token.endswith(">"), "open")
        .otherwise("text")
    )


def local_name(token: Column) -> Column:
    """Name of a tag without its prefix; other tokens: empty."""
    return F.regexp_extract(token, rf"(?s)\A</?(?:[^\s<>/!?\"'=:]++:)?([^\s<>/!?\"'=]++)", 1)


def plain(xml: Column) -> Column:
    """The part without comments, and marked sections as ordinary text.

    An instruction that holds a ``<`` goes as well.  What is left can be read by patterns: every
    ``<`` in it begins a tag or an instruction.  A part without any of these is returned as it is.
    """
    def one(token: Column) -> Column:
        inner = F.substring(token, F.lit(10), F.length(token) - 12)
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inner = F.replace(inner, F.lit(raw), F.lit(safe))
        hides = token.startswith("<?") & F.substring(token, F.lit(3), F.length(token)).contains("<")
        return (F.when(token.startswith("<!--") | hides, "").when(token.startswith("<![CDATA["), inner).otherwise(token))

    return F.when(xml.rlike(_SPECIAL), F.array_join(F.transform(tokens(xml), one), "")).otherwise(xml)


def tags_named(xml: Column, names: Iterable[str]) -> Column:
    """All opening tags with these local names, document order; ``xml`` is ``plain``."""
    pattern = rf"(?s)<(?:[^\s<>/!?\"'=:]++:)?(?:{'|'.join(names)})(?:{_ATTRIBUTE})*+\s*+/?>"
    return F.regexp_extract_all(xml, F.lit(pattern), F.lit(0))


def child_tags(xml: Column) -> Column:
    """Opening tags of the root's children, document order; ``xml`` is ``plain``."""
    tags = F.filter(tokens(xml), lambda t: t.startswith("<") & ~t.startswith("<?"))
    none = F.array().cast("array<string>")

    def step(state: Column, tag: Column) -> Column:
        closes, opens = tag.startswith("</"), ~tag.endswith("/>")
        depth = F.when(closes, state["depth"] - 1).when(opens, state["depth"] + 1).otherwise(state["depth"])
        found = F.when(~closes & (state["depth"] == 1), F.concat(state["found"], F.array(tag))).otherwise(state["found"])
        return F.struct(depth.alias("depth"), found.alias("found"))

    return F.aggregate(tags, F.struct(F.lit(0).alias("depth"), none.alias("found")), step, lambda s: s["found"])


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, by its local name; absent or empty: empty."""
    named = rf"\s++(?:[\w.-]++:)?{name}\s*+=\s*+"
    pattern = rf"(?s)\A<[^\s>/]++(?:(?!{named}){_ATTRIBUTE})*+{named}(?:\"([^\"]*+)\"|'([^']*+)')"
    return let(F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2)), unescape)


_REFERENCE = "&#(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});"


def _character(reference: Column) -> Column:
    """The character of ``x41`` or ``65``; what stands for none stays as written."""
    hexadecimal = reference.startswith("x")
    code = F.when(hexadecimal, F.conv(F.substring(reference, F.lit(2), F.length(reference)), 16, 10).cast("int")).otherwise(
        F.expr("0") + F.when(~hexadecimal, reference).cast("int"))
    is_one = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    safe = F.when(is_one, code).otherwise(F.lit(65))
    return F.when(is_one, F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")).otherwise(
        F.concat(F.lit("&#"), reference, F.lit(";")))


def unescape(text: Column) -> Column:
    """Character data -> text.  Never fails, whatever the text holds."""
    def named(part: Column) -> Column:
        for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            part = F.replace(part, F.lit(safe), F.lit(raw))
        return part

    characters = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)), _character)
    numeric = F.array_join(F.zip_with(
        F.split(text, _REFERENCE, -1), characters, lambda t, c: F.concat(named(t), F.coalesce(c, F.lit("")))), "")
    return F.when(text.contains("&#"), numeric).when(text.contains("&"), named(text)).otherwise(text)
