"""Quality rules: word and line counts, and compression bands over whole texts and fixed chunks.

A text that zstandard shrinks far below its length repeats itself; one that hardly shrinks is
no prose.  The limits depend on the length, as short texts hardly compress and long ones do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from inkveil.llm.common import SPACE, arrow_map, prepare, read_table, text_bytes

SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not begin a code point

#: From so many UTF-8 bytes on: least and greatest compressed size over size (zstandard, LEVEL).
BANDS = (
    (64, 0.45, 1.50),
    (256, 0.40, 0.95),
    (1_024, 0.37, 0.80),
    (4_096, 0.34, 0.75),
    (16_384, 0.30, 0.75),
    (65_536, 0.26, 0.75),
)
LEVEL = 3
CHUNK = 2_048
#: The same limits for one whole chunk, and the share of chunks that may lie outside them.
CHUNK_BAND = (0.34, 0.80)
CHUNK_SHARE = 0.25

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a window of three words that occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    v = len(number)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 21:  # else three numbers would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * v + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(n, bool)
    again = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(3):
        found[again + k] = True
    return int(found.sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), len(text.translate(None, SPACE + _CONTINUED)),
            len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


def ratios(text: bytes, zip_: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Compressed size over size: of the whole text (empty: 1), and of each whole chunk."""
    if not text:
        return 1.0, []
    whole = len(zip_.compress(text)) / len(text)
    return whole, [len(zip_.compress(text[i:i + CHUNK])) / CHUNK for i in range(0, len(text) - CHUNK + 1, CHUNK)]


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    """Limits for a text of that many bytes; below the first band there are none."""
    low, high = 0.0, float("inf")
    for start, least, most in bands:
        if n_bytes >= start:
            low, high = least, most
    return low, high


def in_bands(text: bytes, whole: float, chunks: list[float], bands=BANDS) -> bool:
    low, high = band(len(text), bands)
    outside = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks)
    return low <= whole <= high and outside <= CHUNK_SHARE * len(chunks)


def verdict(text: bytes | None, zip_: zstandard.ZstdCompressor, bands=BANDS) -> dict:
    """All of one text; null counts as empty (no words: base_failed)."""
    text = text or b""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = counts(text)
    whole, chunks = ratios(text, zip_)
    failed = base_fails(n_words, n_repeat)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
            "n_repeat_words": n_repeat, "base_failed": failed, "ratio": whole,
            "chunk_low": min(chunks, default=None), "chunk_high": max(chunks, default=None),
            "kept": not failed and in_bands(text, whole, chunks, bands)}


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, ratio double, chunk_low double, chunk_high double, kept boolean")


def quality_rules(docs: DataFrame, bands=BANDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, ratios and verdict, in one pass without a shuffle.

    Null and empty texts have no words and fail; a repeated row gets its own, equal result; an
    empty table gives an empty result; columns besides doc_id and text are not read.
    """
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        found = [verdict(t, zip_, bands) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id")} | {
            k: [f[k] for f in found] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                               "base_failed", "ratio", "chunk_low", "chunk_high", "kept")}

    return arrow_map(text_bytes(docs), run, SCHEMA)


def keep_good(docs: DataFrame, bands=BANDS) -> DataFrame:
    """The rows of ``docs`` whose text passes, all columns as they are; one pass, no shuffle."""
    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([verdict(t.encode() if t else b"", zip_, bands)["kept"] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_compression_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(read_table(prepare(spark), folder, "documents"))
