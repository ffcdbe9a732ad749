"""Benchmark decontamination: a broadcast set of hashed test n-grams against every window of the documents.

Windows whose hash is in the set are compared word by word with the test n-grams; what is left
marks documents, or the spans to cut out of them.  DataFrame functions only.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.llm.common import prepare, read_table, stored
from inkveil.session import spread

#: Words of a window; a test item of fewer words is one window of its own length.
WINDOW = 10
#: Hashes broadcast at a time, 8 bytes each.  A larger set is matched in as many passes as it takes.
BLOCK = 1_000_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same class for Spark, with its characters listed: Java takes the ranges one by one, which costs several
# times as much once several tasks of an executor do so at a time.
_LETTERS = string.digits + string.ascii_lowercase
_BEYOND = r"\x{80}-\x{10FFFF}"
_RUN = f"[{_LETTERS}{_BEYOND}]+"
# pieces of text that is not lower-cased: words and what lies between them
_BETWEEN = f"[^{_LETTERS}{string.ascii_uppercase}{_BEYOND}]+"
_PIECE = f"[{_LETTERS}{string.ascii_uppercase}{_BEYOND}]+|" + _BETWEEN


def words(text: Column) -> Column:
    """Normalised words: letters and digits, A-Z lower-cased; null: none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)  # the quick way is right for these only
    lower = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(lower, F.lit(_RUN), F.lit(0))


def _text_key(text: Column) -> Column:
    """Names a text beside its id: rows with equal ids can hold different texts."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _starts(n: Column, size: Column | int) -> Column:
    return F.greatest(n - size + 1, F.lit(0))


def grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, h, items): each distinct test window with the sorted ids, as text, of the items that hold it."""
    tokens, n = F.col("words"), F.size("words")
    starts = F.when(n >= window, F.sequence(F.lit(1), n - window + 1)).when(n > 0, F.array(F.lit(1)))
    return (benchmark.select("item_id", words(F.col("text")).alias("words"))
            .select("item_id", "words", F.explode_outer(starts).alias("at")).where(F.col("at").isNotNull())
            .select(F.col("item_id").cast("string").alias("item"), F.slice(tokens, F.col("at"), F.lit(window)).alias("gram"))
            .groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
            .withColumn("h", F.xxhash64("gram")))


def _candidates(docs: DataFrame, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, text_key, start, size, h, gram) of the windows whose hash is in ``hashes``."""
    tokens, n = F.col("words"), F.size("words")

    def windows(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(size))))
        return F.when(n >= size, every).otherwise(F.array().cast("array<bigint>"))

    # the outer form: a filter on the number of windows would carry the whole expression down the plan
    scanned = (spread(docs.select("doc_id", "text"))
               .select("doc_id", _text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("words"))
               .select("doc_id", "text_key", "words", F.concat(*(windows(s) for s in sizes)).alias("windows"))
               .select("doc_id", "text_key", "words", F.posexplode_outer("windows").alias("at", "h")))
    met = scanned.join(F.broadcast(hashes), "h", "left_semi")
    start, size, before = F.col("at"), F.lit(sizes[0]), F.lit(0)
    for shorter, longer in zip(sizes, sizes[1:]):
        before = before + _starts(n, shorter)
        start = F.when(F.col("at") >= before, F.col("at") - before).otherwise(start)
        size = F.when(F.col("at") >= before, F.lit(longer)).otherwise(size)
    placed = met.select("doc_id", "text_key", "h", "words", start.alias("start"), size.alias("size"))
    return placed.select("doc_id", "text_key", "h", "start", "size",
                         F.slice(tokens, F.col("start") + 1, F.col("size")).alias("gram"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, size, items): each place where a document holds a test window.

    ``start`` is a word number from 0.  Rows equal in id and text have one set of places.
    """
    test = stored(grams(benchmark, window), "grams")
    sizes = [r["size"] for r in test.select(F.size("gram").alias("size")).distinct().orderBy("size").collect()]
    none = test.select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text_key"), F.lit(0).alias("start"),
                       F.lit(0).alias("size"), "items").where(F.lit(False))
    passes = math.ceil(test.count() / BLOCK)
    part = F.pmod(F.xxhash64(F.lit("pass"), F.col("h")), F.lit(max(passes, 1)))
    found = []
    for i in range(passes):
        hashes = test.where(part == i).select("h").distinct()
        met = stored(_candidates(docs, hashes, sizes).distinct(), "met")
        same = (met["h"] == test["h"]) & (met["gram"] == test["gram"])
        found.append(met.join(test, same).select("doc_id", "text_key", "start", "size", "items"))
    return reduce(DataFrame.unionByName, found, none)


def spans(places: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, after): overlapping and adjoining places joined, as word numbers."""
    ends = places.groupBy("doc_id", "text_key", "start").agg((F.col("start") + F.max("size")).alias("end"))
    order = Window.partitionBy("doc_id", "text_key").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ends.withColumn("opens", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    return (opened.withColumn("span", F.sum("opens").over(order))
            .groupBy("doc_id", "text_key", "span").agg(F.min("start").alias("first"), F.max("end").alias("after"))
            .drop("span"))


def _by_text(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``found`` for the row's id and text, null where there are none.

    Ids may be null and columns of ``docs`` may have any names; results begin with two underscores.
    """
    named = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"),
                         *(F.col(c).alias(f"__{c}") for c in found.columns if c not in ("doc_id", "text_key")))
    keyed = docs.withColumn("__text_key", _text_key(F.col("text")))
    same = (F.col("__text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return keyed.join(named, same, "left").drop("__text_key", "__id", "__key")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids as text), contaminated.

    Null and empty texts, also of items, have no words.  A null item id marks words but is not among
    the items.  Repeated rows get equal results; rows with one id but different texts get their own.
    Without items, or without documents, nothing is hit.
    """
    places = stored(occurrences(docs, benchmark, window), "places")
    hit = spans(places).groupBy("doc_id", "text_key").agg(F.sum(F.col("after") - F.col("first")).alias("n_hit"))
    items = (places.groupBy("doc_id", "text_key").agg(F.collect_set("items").alias("sets"))
             .select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"),
                     F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items")))
    both = (hit.join(items, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
            .select("doc_id", "text_key", "n_hit", "items"))
    counted = spread(docs.select("doc_id", "text")).select(
        "doc_id", "text", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return _by_text(counted, both).select(
        "doc_id", "n_words", F.coalesce("__n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("__n_hit", F.lit(0)) > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no test window."""
    hit = occurrences(docs, benchmark, window).select("doc_id", "text_key").distinct().withColumn("hit", F.lit(True))
    return _by_text(docs, hit).where(F.col("__hit").isNull()).select(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every test span cut out of ``text``, from its first word to the end of its last."""
    cut = (spans(occurrences(docs, benchmark, window)).groupBy("doc_id", "text_key")
           .agg(F.array_sort(F.collect_list(F.struct("first", "after"))).alias("cuts")))
    pieces, cuts = F.col("__pieces"), F.col("__cuts")
    lead = F.get(pieces, F.lit(0)).rlike(_BETWEEN).cast("int")
    # piece numbers: word w is piece 2 w + lead; kept are the pieces from one cut to the next
    from_ = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: 2 * (c["after"] - 1) + F.col("__lead") + 1))
    upto = F.concat(F.transform(cuts, lambda c: 2 * c["first"] + F.col("__lead")), F.array(F.size(pieces)))
    kept = F.transform(F.arrays_zip(from_.alias("a"), upto.alias("b")),
                       lambda g: F.array_join(F.slice(pieces, g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0))), ""))
    rest = (_by_text(docs, cut)
            .withColumn("__pieces", F.when(cuts.isNotNull(), F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))))
            .withColumn("__lead", lead))
    text = F.when(cuts.isNull(), F.col("text")).otherwise(F.array_join(kept, "")).alias("text")
    return rest.select(*(text if c == "text" else F.col(c) for c in docs.columns))


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    found = report(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WINDOW} THEN [w]
        ELSE list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: w[i:i + {WINDOW - 1}]) END) AS gram FROM b),
k AS (SELECT DISTINCT len(gram) AS k FROM g),
p AS (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM d, k WHERE len(w) >= k),
h AS (SELECT r, k, pos, item_id FROM p JOIN g ON g.gram = p.w[p.pos + 1:p.pos + p.k]),
n AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS word FROM h) GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
