"""Spelling variant grouping: words of the corpus at one edit from each other, and the form they stand for.

An edit lies in one half of a word, so the other half is whole in its partner.  Words are dealt to
cells by the first and by the last letters, which both share; a task indexes the words of a cell
(``fm_index``) and searches all words of that cell in it.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import prepare, read_table, stored
from inkveil.llm.fm_index import Vocabulary
from inkveil.session import spread

#: Code points and occurrences that a word needs, and how many times more often its form must occur.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Letters that partners share at one end: half of the shortest word, rounded down.
SHARED = LEAST_LENGTH // 2
#: Code points that a cell is meant to hold and that one index may hold; a crowded cell is cut into
#: several indexes, and all its words are searched in each.
MEANT, MOST = 400_000, 1_200_000
#: Words searched at a time.
SEARCHED = 20_000

_RUN = "[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words long and frequent enough; ``n`` counts occurrences in all texts.

    Words are lower-cased (A-Z only) runs of letters.  Where 31 divides the crc32 of
    ``<doc_id>:<run>``, one of its code points, chosen by that number, is left out; a null id is empty.
    """
    runs = (spread(docs.select("doc_id", "text"))
            .select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))).alias("run"))
            .where(F.col("run").isNotNull())
            .select("doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run")))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    drawn = runs.select("run", h.alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run"))
    return (drawn.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)))


def _cells(words: DataFrame) -> tuple[DataFrame, int]:
    """(cell, block, asked, side, word, n): words to index (asked = 0) and to search, and their number of tasks.

    A cell's words have the same letters at the side that is matched exactly.  Only the sizes of the
    cells are gathered, and stay a table.
    """
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    n_cells = max(32, math.ceil(total / MEANT))
    ends = F.array(*(F.struct(F.lit(side).alias("side"), shared.alias("shared")) for side, shared in (
        ("right", F.substring("word", 1, SHARED)), ("left", F.expr(f"right(word, {SHARED})")))))
    placed = (words.select("word", "n", F.explode(ends).alias("end"))
              .select("word", "n", "end.side",
                      F.concat("end.side", F.pmod(F.xxhash64("end.side", "end.shared"), F.lit(n_cells))).alias("cell")))
    sizes = placed.groupBy("cell").agg(F.ceil(F.sum(F.length("word")) / MOST).cast("int").alias("blocks"))
    sized = placed.join(sizes, "cell")
    texts = sized.select("cell", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"),
                         F.lit(0).alias("asked"), "side", "word", "n")
    asked = sized.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                         F.lit(1).alias("asked"), "side", "word", "n")
    return texts.unionByName(asked), n_cells


def _better(n: int, word: str, best: tuple[int, str] | None) -> bool:
    return best is None or (-n, word) < (-best[0], best[1])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each searched word, within the index that its rows follow; no pairs leave the task."""
    place, texts, index, waiting = None, [], None, []

    def answer() -> pa.RecordBatch:
        side = place[2]
        queries = [w for w, _ in waiting]
        found = [(0, None)] * len(queries)
        for q, i in zip(*(x.tolist() for x in index.near(queries, side == "right")), strict=True):
            x, (y, n) = queries[q], texts[i]
            if side == "left" and y.startswith(x[:len(x) // 2]):
                continue  # the other side finds it
            count, best = found[q]
            found[q] = (count + 1, (n, y) if _better(n, y, best) else best)
        kept = [(w, n, c, b[1], b[0]) for (w, n), (c, b) in zip(waiting, found, strict=True) if c]
        columns = list(zip(*kept)) or [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
             pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())],
            names=["word", "n", "n_near", "best", "best_n"])

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "side", "asked", "word", "n")), strict=True)
        for cell, block, side, asked, word, n in rows:
            if (cell, block, side) != place:
                if waiting:
                    yield answer()
                place, texts, index, waiting = (cell, block, side), [], None, []
            if not asked:
                texts.append((word, n))
                continue
            if not texts:
                continue
            if index is None:
                index = Vocabulary([w for w, _ in texts])
            waiting.append((word, n))
            if len(waiting) >= SEARCHED:
                yield answer()
                waiting = []
    if waiting:
        yield answer()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) of the words that have others at one edit.

    ``best`` is the most frequent of these, of equally frequent ones the smallest.
    """
    rows, tasks = _cells(words)
    dealt = rows.repartition(2 * tasks, "cell", "block").sortWithinPartitions("cell", "block", "asked")
    part = dealt.mapInArrow(_search, "word string, n long, n_near long, best string, best_n long")
    order = F.struct(-F.col("best_n"), F.col("best"))
    return part.groupBy("word", "n").agg(
        F.sum("n_near").alias("n_near"), F.min_by("best", order).alias("best"), F.max("best_n").alias("best_n"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root): where the links of ``forms`` (word, form) end, after ``steps`` doublings."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = stored(found.join(onward, "root", "left")
                       .select("word", F.coalesce("further", "root").alias("root")), "roots")
    return found


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root), one row per word of the vocabulary.

    ``form`` is the most frequent word at one edit, if TIMES as frequent; ``root`` is where forms
    end.  Null and empty texts have no words; an empty table gives none.  Repeated rows count as
    often as they occur.
    """
    words = stored(vocabulary(docs), "vocabulary")
    near = stored(near_words(words), "near")
    forms = near.where(F.col("best_n") >= TIMES * F.col("n")).select("word", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    # a link multiplies the count by TIMES, so the most frequent word bounds their number in a row
    most = words.agg(F.max("n")).first()[0] or LEAST_COUNT
    row = 1 + math.floor(math.log(most / LEAST_COUNT, TIMES) + 1e-9)
    ends = roots(forms, max(1, math.ceil(math.log2(row))))
    return (words.join(near.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(ends, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n",
                    F.coalesce("root", "word").alias("root")))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants(read_table(prepare(spark), folder, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n")
