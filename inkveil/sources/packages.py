"""Office packages: zip container <-> part rows.  The only Python worker code.

Whatever cannot be read becomes a row with an error instead of an exception.  Caps against
zip bombs are there to ask for; without them no entry or package is too large.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.sources.files import file_kind

PART_SCHEMA = (
    "path string, kind string, part string, ordinal int, content binary, xml string, error string"
)
PACKAGE_SCHEMA = "path string, kind string, content binary, error string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
# Rows of a batch that become Python objects at a time, and rows of a batch that leaves a worker.
_TAKEN_PARTS, _TAKEN_PACKAGES, _GIVEN = 256, 16, 2_000


@dataclass(frozen=True)
class Caps:
    """Optional guards; None: no limit.  ``flush_bytes`` only sizes the batches of rows, which hold few rows anyway."""

    entry_bytes: int | None = None
    package_bytes: int | None = None
    entries: int | None = None
    flush_bytes: int = 8 << 20


_DECLARED = re.compile(r"""\A\s*<\?xml[^>]*?\sencoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")


class _DocumentType(Exception):
    pass


def _refuse(*_: object) -> None:
    raise _DocumentType


def _parse_error(data: bytes) -> str | None:
    """Why a part is not one well-formed document, read to its last byte; nothing is expanded."""
    parser = expat.ParserCreate()
    parser.StartDoctypeDeclHandler = _refuse
    try:
        parser.Parse(data, True)
    except _DocumentType:
        return "document type declaration"
    except (expat.ExpatError, ValueError, LookupError):
        return "malformed XML"
    return None


def _decode(data: bytes) -> str:
    """By byte-order mark, else by the declared encoding, else as UTF-8."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    declared = _DECLARED.match(data[:200].decode("latin-1"))
    if data[:3] == b"\xef\xbb\xbf" or not declared:
        return data.decode("utf-8-sig")
    return data.decode(declared[1])


def _text(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of an XML part; other parts have neither."""
    if not name.lower().endswith((".xml", ".rels")):
        return None, None
    try:
        return _decode(data), _parse_error(data)
    except (UnicodeDecodeError, LookupError) as err:
        return None, f"undecodable XML: {getattr(err, 'reason', err)}"


def _bytes(name: str, xml: str | None, content: bytes | None) -> bytes:
    """An untouched part as it was; an edited one as UTF-8, which its declaration then says."""
    if not isinstance(xml, str):
        return content or b""
    if content is not None and _text(name, content)[0] == xml:
        return content
    declared = _DECLARED.match(xml)
    if declared and declared[1].lower() not in ("utf-8", "us-ascii", "ascii"):
        xml = xml[:declared.start(1)] + "UTF-8" + xml[declared.end(1):]
    return xml.encode("utf-8")


def _entries(path: str, kind: str, content: bytes, caps: Caps) -> Iterator[tuple]:
    if kind not in C.PACKAGE_KINDS:
        yield path, kind, None, None, None, None, (None if kind else f"Unsupported file: {path}")
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = archive.infolist()
            if caps.entries is not None and len(infos) > caps.entries:
                raise ValueError(f"more than {caps.entries} entries")
            if not infos:
                raise ValueError("no entries")
            room = caps.package_bytes
            for i, info in enumerate(infos):
                if info.is_dir():
                    continue
                limit = min((x for x in (caps.entry_bytes, room) if x is not None), default=None)
                try:
                    with archive.open(info) as entry:
                        data = entry.read(-1 if limit is None else limit + 1)
                    if limit is not None and len(data) > limit:
                        raise ValueError(f"entry larger than {limit} bytes")
                except Exception as err:
                    yield path, kind, info.filename, i, None, None, f"{type(err).__name__}: {err}"
                    continue
                if room is not None:
                    room -= len(data)
                xml, error = _text(info.filename, data)
                # the bytes stay beside a text that would not give them back
                same = xml is not None and xml.encode("utf-8") == data
                yield path, kind, info.filename, i, (None if same else data), xml, error
    except Exception as err:
        yield path, kind, None, None, None, None, f"{type(err).__name__}: {err}"


def _taken(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples; only so many are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, rows).columns))


def _given(rows: Iterable[tuple], schema: str, flush_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, bounded by their bytes and by their number."""
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if size >= flush_bytes or len(held) >= _GIVEN:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def unzip_parts(files: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """``(path, content)`` -> part rows; XML parts as text, others as bytes.

    One scan for a mix of kinds: a file that is no package is one row without a part, and with an
    error if its kind is unknown.  Its bytes do not go to a worker.
    """
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (row for path, kind, content in _taken(batches, _TAKEN_PACKAGES)
                 for row in _entries(path, kind, content or b"", caps))
        return _given(parts, PART_SCHEMA, caps.flush_bytes)

    kind = F.col("kind") if "kind" in files.columns else file_kind(F.col("path"), F.col("content"))
    return files.select("path", kind.alias("kind"), "content").withColumn(
        "content", F.when(F.col("kind").isin(*C.PACKAGE_KINDS), F.col("content"))).mapInArrow(unpack, PART_SCHEMA)


def _size(parts: DataFrame):
    """Bytes of a part as it will be written."""
    sizes = [F.octet_length("xml")]
    if "content" in parts.columns:
        sizes.append(F.octet_length("content"))
    return F.coalesce(*sizes, F.lit(0))


def zip_parts(parts: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """Part rows -> one package per path, entries in their original order.

    One package is written by one task, which reads its rows in order and holds one package at a
    time.  With caps, its size is checked first, on lengths alone: a package beyond them becomes a
    row with an error and is never gathered.
    """

    def written(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (path,), entries in groupby(rows, key=lambda row: row[:1]):
            out, kinds = io.BytesIO(), []
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for _, kind, part, content, xml in entries:
                    kinds = kinds or [kind]
                    stamp = zipfile.ZipInfo(part, (1980, 1, 1, 0, 0, 0))
                    stamp.compress_type = zipfile.ZIP_DEFLATED
                    archive.writestr(stamp, _bytes(part, xml, content))
            yield path, kinds[0], out.getvalue(), None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _given(written(_taken(batches, _TAKEN_PARTS)), PACKAGE_SCHEMA, caps.flush_bytes)

    rows = parts.filter("part IS NOT NULL")
    content = F.col("content") if "content" in parts.columns else F.lit(None).cast("binary")

    def packed(fit: DataFrame) -> DataFrame:
        ordered = fit.select("path", "kind", "part", "ordinal", content.alias("content"), "xml").repartition(
            "path").sortWithinPartitions("path", F.col("ordinal").asc_nulls_last())
        return ordered.select("path", "kind", "part", "content", "xml").mapInArrow(pack, PACKAGE_SCHEMA)

    if caps.package_bytes is None and caps.entries is None:
        return packed(rows)
    most = lambda c: F.lit(float("inf") if c is None else float(c))
    over = (
        rows.groupBy("path").agg(F.sum(_size(rows)).alias("bytes"), F.count("*").alias("entries"))
        .filter((F.col("bytes") > most(caps.package_bytes)) | (F.col("entries") > most(caps.entries)))
    )
    too_big = over.select(
        "path", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("binary").alias("content"),
        F.concat(F.lit("package larger than the cap: "), F.col("bytes").cast("string"),
                 F.lit(" bytes")).alias("error"))
    return packed(rows.join(over.select("path"), "path", "left_anti")).unionByName(too_big)


def part_errors(parts: DataFrame) -> DataFrame:
    """The error table: packages and parts that could not be read."""
    return parts.filter("error IS NOT NULL").select("path", "part", "error")


def add_salt(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Put the run's salt into every package, ahead of its other entries."""
    salt = parts.select("path", "kind").distinct().select(
        "path", "kind", F.lit(C.SALT_PART).alias("part"), F.lit(-1).alias("ordinal"),
        manifest.select("salt").scalar().alias("content"),
        F.lit(None).cast("string").alias("xml"), F.lit(None).cast("string").alias("error"))
    return parts.unionByName(salt.select(*parts.columns))


def package_salts(parts: DataFrame) -> DataFrame:
    """``(path, salt)`` of the encrypted packages; others are not in it."""
    return parts.filter(F.col("part") == C.SALT_PART).select("path", F.col("content").alias("salt"))


def drop_salt(parts: DataFrame) -> DataFrame:
    return parts.filter(~F.col("part").eqNullSafe(F.lit(C.SALT_PART)))
