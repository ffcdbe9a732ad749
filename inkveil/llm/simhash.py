"""Near duplicates by SimHash fingerprints, found by Golay keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm import golay
from inkveil.llm.common import arrow_map, prepare, read_table, stored, text_bytes
from inkveil.llm.graph import components_by_key, differing

SEED = 42
BLOCK = 1 << 15
#: Words of a shingle, and bits that linked fingerprints may differ in.
SHINGLE, MOST_BITS = 3, 2


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All windows of ``size`` words, space-joined; fewer words: the whole sequence; none: none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    return [text[s:e] for s, e in zip(starts[:n].tolist(), ends[size - 1:].tolist(), strict=True)]


def majority(digests: list[bytes], width: int) -> np.ndarray:
    """Bit sums over digests of ``width`` bytes as booleans: set in over half of them."""
    total = np.zeros(8 * width, np.int64)
    for i in range(0, len(digests), BLOCK):
        block = np.frombuffer(b"".join(digests[i:i + BLOCK]), np.uint8).reshape(-1, width)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return 2 * total > len(digests)


def fingerprint(text: bytes | None) -> int:
    """64 bits from the 3-word shingles, repeats included, of the lower-cased text; no words: 0."""
    found = shingles((text or b"").lower().split(), SHINGLE)
    bits = majority([xxhash.xxh64_digest(s, SEED) for s in found], 8)
    return int(np.packbits(bits).view(">i8")[0])


def _raw(text: Column) -> Column:
    """Names a text beside its id: rows with equal ids can hold different texts."""
    return F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, fp): one row per row of ``docs``; null and empty texts have fingerprint 0."""
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column("doc_id"), "raw": batch.column("raw"),
                "fp": [fingerprint(t) for t in batch.column("text").to_pylist()]}

    return arrow_map(text_bytes(docs, _raw("text").alias("raw")), run, "doc_id long, raw string, fp long")


def golay_keys(fps: DataFrame, node: str, words: list[str]) -> DataFrame:
    """(key, node) rows: the Golay keys of each fingerprint column, told apart by column."""
    def run(batches):
        for batch in batches:
            nodes = batch.column(node).to_numpy(zero_copy_only=False)
            for i, w in enumerate(words):
                rows, found = golay.keys(batch.column(w).to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found | (i << 40), pa.int64()), pa.array(nodes[rows], pa.int64())], names=["key", "node"])

    return fps.select(*dict.fromkeys((node, *words))).mapInArrow(run, "key long, node long")


def _groups(fps: DataFrame, most: int) -> DataFrame:
    """(fp, group): fingerprints linked at ``most`` or fewer differing bits have one group.

    Equal fingerprints are one node, so copies are never paired.
    """
    assert most <= 2, "the keys find links of at most two differing bits"
    nodes = fps.select("fp").distinct()
    near = components_by_key(
        golay_keys(nodes, "fp", ["fp"]),
        lambda pairs: pairs.where(differing([F.col("a")], [F.col("b")]) <= most))
    return (nodes.join(near.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", F.coalesce("component", "fp").alias("group")))


def simhash_components(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, component_id): components of links at ``most`` (two or fewer) differing bits.

    A null id takes part with the others; a component of null ids only has a null id.  Repeated rows
    get equal results; an empty table gives none.
    """
    fps = stored(fingerprints(docs).select("doc_id", "fp"), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(_groups(fps, most), "fp")
    named = least.groupBy("group").agg(F.min("rep").alias("component_id"))
    return fps.join(least.join(named, "group").select("fp", "component_id"), "fp")


def keep_one_of_each(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, without an id only if none has one.

    Groups are those of ``simhash_components``.  Of rows with that id the smallest digest of the text
    decides, then the smallest of all columns as JSON, so a repeated row stays once.
    """
    fps = stored(fingerprints(docs), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "raw")
    firsts = fps.groupBy("fp").agg(F.min(first).alias("first")).join(_groups(fps, most), "fp")
    kept = (firsts.groupBy("group").agg(F.min("first").alias("first"))
            .select(F.col("first.doc_id").alias("__id"), F.col("first.raw").alias("__kept")))
    named = docs.withColumn("__raw", _raw("text"))
    among = Window.partitionBy("doc_id", "__raw").orderBy("__json")
    return (named.join(kept, (F.col("__raw") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
            .withColumn("__json", F.to_json(F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text")), F.lit(0))))
            .withColumn("__among_equals", F.row_number().over(among))
            .where("__among_equals = 1").select(*docs.columns))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(read_table(prepare(spark), folder, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
