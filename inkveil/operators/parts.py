"""Package parts as table rows: selection, text, scrub, substitution."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.functions import xmltext as X, xmltokens as T
from inkveil.functions.detect import let
from inkveil.plans.policies import ANY, DEFAULT_POLICY, PolicyRow, active


def is_body_part(part: Column, charts: bool = True) -> Column:
    """Parts whose run texts are visible body text."""
    body = part.rlike(C.BODY_PART_PATTERN)
    return body | part.startswith(C.CHART_PART_PREFIX) if charts else body


def body_parts(parts: DataFrame) -> DataFrame:
    return parts.filter(is_body_part(F.col("part")))


def text_runs(parts: DataFrame) -> DataFrame:
    """One row per text run, document order; unreadable parts give none.

    Each run is a unit of its own: a match never crosses two runs.
    """
    xml = F.when(F.col("error").isNull(), F.col("xml"))
    return body_parts(parts).select(
        "path", "part", "ordinal", F.posexplode(X.text_runs(xml)).alias("run_no", "text"))


def part_tokens(parts: DataFrame) -> DataFrame:
    """(path, part, token_no, kind, name, token) of every XML part; joined in order they are its text."""
    return parts.filter("xml IS NOT NULL").select(
        "path", "part", F.posexplode(T.tokens(F.col("xml"))).alias("token_no", "token")).select(
        "path", "part", "token_no", T.kind(F.col("token")).alias("kind"), T.local_name(F.col("token")).alias("name"), "token")


def content_digests(parts: DataFrame) -> DataFrame:
    """(path, part, digest) of the run texts of each body part; unreadable parts have none."""
    xml = F.when(F.col("error").isNull(), F.col("xml"))
    return body_parts(parts).select(
        "path", "part", F.sha2(F.array_join(X.text_runs(xml), "\n"), 256).alias("digest"))


def content_preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, part, digest, preserved) of each body part of ``before``, by one aggregation over both.

    ``preserved`` is false for a part that is missing or cannot be read after; (path, part) is unique.
    """
    sides = content_digests(before).withColumn("side", F.lit(0)).unionByName(
        content_digests(after).withColumn("side", F.lit(1)))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("digest")))
    return (sides.groupBy("path", "part").agg(F.min("side").alias("first"), of(0).alias("digest"), of(1).alias("after"))
            .filter("first = 0")
            .select("path", "part", "digest", F.col("digest").eqNullSafe(F.col("after")).alias("preserved")))


Edit = Callable[[Column], Column]
_ANY_TAG = r"[\w.-]+"


class _Programme:
    """Edits of parts that active policy rows ask for, as (condition on the part, edits)."""

    def __init__(self, rows: Iterable[PolicyRow]):
        self._actions = {(r.kind, r.surface, r.key): r.action for r in rows}
        self.rules: list[tuple[Column, list[Edit]]] = []
        self.template_kinds = [k for k in ("docx", "xlsx") if self.action(k, "template", "template_path") == "drop"]

    def action(self, kind: str, surface: str, key: str) -> str | None:
        """What happens to a key; an exact row beats a whole-surface row."""
        return self._actions.get((kind, surface, key), self._actions.get((kind, surface, ANY)))

    def on(self, part: Column, *edits: Edit | None) -> None:
        chosen = [e for e in edits if e]
        if chosen:
            self.rules.append((part, chosen))

    def blank(self, kind: str, surface: str, key: str, edit: Edit) -> Edit | None:
        return edit if self.action(kind, surface, key) else None


def _core_edits(plan: _Programme, kind: str, elements: Mapping[str, str]) -> list[Edit]:
    """Element name -> key: texts are emptied, dropped fields go, numbers become 1."""
    by_action: dict[str, list[str]] = {}
    for element, key in elements.items():
        by_action.setdefault(plan.action(kind, "core", key) or "", []).append(element)
    edits = []
    if names := by_action.get("blank"):
        edits.append(lambda x: X.set_text(x, names))
    if ones := by_action.get("one"):
        edits.append(lambda x: X.set_text(x, ones, "1"))
    if gone := by_action.get("drop"):
        edits.append(lambda x: X.drop_element(x, gone))
    return edits


def edit_programme(rows: Iterable[PolicyRow]) -> _Programme:
    """Policy rows -> edits of the parts that hold their keys.

    One row decides for the table of metadata and for the part, so reports and parts agree.
    """
    part, kind = F.col("part"), F.col("kind")
    docx, xlsx = kind == "docx", kind == "xlsx"
    plan = _Programme(rows)
    core = part == "docProps/core.xml"
    integers = {n: n for n in C.CORE_INTEGERS}
    plan.on(core & docx, *_core_edits(plan, "docx", {**C.DOCX_CORE_STRINGS, **C.DOCX_CORE_DATES, **integers}))
    plan.on(core & xlsx, *_core_edits(
        plan, "xlsx", {n: n for n in (*C.XLSX_CORE_STRINGS, *C.XLSX_CORE_DATES, *C.CORE_INTEGERS)}))

    def attribute(of: str, surface: str, key: str, tags, name: str, to: str) -> Edit | None:
        return plan.blank(of, surface, key, lambda x: X.set_attribute(x, tags, name, to))

    def people(x: Column) -> Column:
        x = X.set_attribute(X.set_attribute(x, ["person"], "name", ""), ["person"], "id", "")
        return X.set_text(x, ["person"])

    for of, is_of in (("docx", docx), ("xlsx", xlsx)):
        folder = "word" if of == "docx" else "xl"
        fields = [n for n, key in C.APP_FIELDS.items() if plan.action(of, "app", key)]
        plan.on((part == "docProps/app.xml") & is_of, (lambda x, n=fields: X.set_text(x, n)) if fields else None)
        plan.on((part == "docProps/custom.xml") & is_of, plan.blank(
            of, "custom_properties", ANY, lambda x: X.drop_element(x, "property")))
        plan.on(part.startswith(f"{folder}/threadedComments/") & is_of,
                attribute(of, "threaded_comments", "author", _ANY_TAG, "author", ""),
                plan.blank(of, "threaded_comments", "provision_id", lambda x: X.drop_attribute(x, _ANY_TAG, "provisionId")))
        plan.on((part == f"{folder}/people.xml") & is_of, plan.blank(of, "people", "name", people))
        plan.on(F.lower(part).like(C.CUSTOM_XML_PREFIX + "%.xml") & is_of,
                plan.blank(of, "custom_xml", "part", X.drop_children))
    plan.on((part == "word/comments.xml") & docx,
            attribute("docx", "comments", "author", "comment", "author", ""),
            attribute("docx", "comments", "initials", "comment", "initials", ""),
            attribute("docx", "comments", "date", "comment", "date", C.EPOCH_DATE))
    plan.on((part == "word/document.xml") & docx,
            attribute("docx", "tracked_changes", "author", C.TRACKED_CHANGE_TAGS, "author", ""),
            attribute("docx", "tracked_changes", "date", C.TRACKED_CHANGE_TAGS, "date", C.EPOCH_DATE))
    elements = [e for e, surface in (("attachedTemplate", "template"), ("docVars", "document_variables"), ("mailMerge", "mail_merge"))
                if plan.action("docx", surface, ANY)]
    plan.on((part == "word/settings.xml") & docx, (lambda x: X.drop_element(x, elements)) if elements else None)
    plan.on((part == "xl/workbook.xml") & xlsx,
            attribute("xlsx", "hidden_sheets", "sheet", "sheet", "state", "visible"),
            plan.blank("xlsx", "defined_names", ANY, lambda x: X.drop_element(x, "definedNames")))
    plan.on((part == "xl/connections.xml") & xlsx, *(
        plan.blank("xlsx", "connections", key, lambda x, t=tag, k=key: X.drop_attribute(x, t, k))
        for key, tag in (("name", "connection"), ("description", "connection"), ("connection", "dbPr"))))
    plan.on(part.rlike(r"^xl/externalLinks/.*\.xml\.rels$") & xlsx, plan.blank(
        "xlsx", "external_links", ANY, lambda x: X.drop_attribute(x, "Relationship", "Target")))
    return plan


def scrubbed(plan: _Programme, xml: Column) -> Column:
    """Part text after the programme's edits; all other bytes stay.

    Edits run on the text without marked sections and comments, so nothing hides from them in
    one and no tag name in a comment is taken for an element.  A part that they leave alone
    keeps its bytes.
    """
    if not plan.rules:
        return xml

    def edited(plain: Column) -> Column:
        case = F
        for condition, edits in plan.rules:
            case = case.when(condition, reduce(lambda x, edit: edit(x), edits, plain))
        return let(case.otherwise(plain), lambda new: F.when(new == plain, xml).otherwise(new))

    touched = reduce(lambda some, rule: some | rule[0], plan.rules, F.lit(False))
    return F.when(touched, let(X.plain_runs(xml), edited)).otherwise(xml)


def scrub(
    parts: DataFrame, categories: Iterable[str] = C.CATEGORIES, policy: Iterable[PolicyRow] = DEFAULT_POLICY,
) -> DataFrame:
    """Part-level strip by the policy; parts with an error are passed on unchanged.

    An edited part is read again: one that would no longer be well-formed keeps its text and gets
    an error.  The relationship of a removed template goes with it.  Its id stands in another part
    of the same package, so that one kind of part is joined on its path; the other parts
    are edited where they are, without a shuffle.
    """
    plan = edit_programme(active(policy, categories))
    ok = F.col("error").isNull()

    def edited(df: DataFrame, when: Column, new: Column) -> DataFrame:
        read = F.when(when, let(new, lambda text: F.struct(
            text.alias("xml"), F.when(text != F.col("xml"), X.xml_error(text)).alias("bad"))))
        df = df.withColumn("_edit", read)
        good = F.col("_edit").isNotNull() & F.col("_edit.bad").isNull()
        return df.select(*(
            F.when(good, F.col("_edit.xml")).otherwise(F.col("xml")).alias("xml") if c == "xml"
            else F.when(F.col("_edit.bad").isNotNull(), F.lit("edited part is malformed")).otherwise(F.col("error")).alias("error")
            if c == "error" else F.col(c) for c in parts.columns))

    new = scrubbed(plan, F.col("xml"))
    if not plan.template_kinds:
        return edited(parts, ok, new)
    rid = F.from_xml(
        F.when(ok, F.col("xml")), "attachedTemplate struct<_id:string>", {"ignoreNamespace": "true"}
    )["attachedTemplate"]["_id"]
    refs = (
        parts.filter((F.col("part") == "word/settings.xml") & F.col("kind").isin(*plan.template_kinds))
        .select("path", rid.alias("_rid")).filter(F.col("_rid") != "")
    )
    is_rels = F.col("part").eqNullSafe(F.lit("word/_rels/settings.xml.rels"))
    rels = edited(parts.filter(is_rels).join(refs, "path", "left"), ok & F.col("_rid").isNotNull(),
                  X.drop_relationship(X.plain_runs(F.col("xml")), F.col("_rid")))
    return edited(parts.filter(~is_rels), ok, new).unionByName(rels)


def substitute(parts: DataFrame, replacements: DataFrame) -> DataFrame:
    """Replaced parts override, all others stay as they are, ordinals are kept.

    ``replacements`` (path, part, xml) holds at most one row per part.
    """
    new = replacements.select("path", "part", F.col("xml").alias("_new"))
    return parts.join(new, ["path", "part"], "left").withColumn(
        "xml", F.coalesce("_new", "xml")).select(*parts.columns)
