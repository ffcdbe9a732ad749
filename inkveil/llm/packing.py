"""Best-fit packing planned over the histogram of lengths.

There are at most ``capacity`` different lengths, however many documents there are.  The plan
runs best-fit decreasing over (length, count), whole runs of equal sequences at a time; then
every piece takes the planned slot with its length and its rank within that length, by a join.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import gapless, prepare, read_table, stored, text_bytes

CAPACITY = 4096
END = 1
#: Words, and pieces of words, that a worker remembers with their ids, in each of two generations.
REMEMBERED = 200_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of whole texts through a memory of words.

    The tokenizer never joins characters across white space, so a text's ids are those of its
    words.  Words of ASCII and Latin-1 letters, digits and marks go straight to the merge model,
    by the tokenizer's own split pattern (a fixed value); all other words go through the whole tokenizer.
    """

    _PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    _PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pieces = _Memory(self.piece)
        self.words = _Memory(self.word)
        # bytes as the letters that stand for them in the vocabulary
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in keep]
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(other)}

    def word(self, raw: bytes) -> bytes:
        word = raw.decode(errors="replace")
        if not self._PLAIN.fullmatch(word) or "<|" in word:
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self._PIECES.findall(word.lower())))

    def piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text (UTF-8), split at ASCII white space."""
        return b"".join(map(self.words.__getitem__, text.split()))


class _Memory(dict):
    """Keys with their ids.  A full generation becomes the old one, and the one before is forgotten.

    What is still asked for moves on from the old generation, so frequent words are worked out once.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= REMEMBERED:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One memory for each worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each text's ids and the end id, cut into pieces of ``capacity``; null text: the end id alone.

    ``with_ids`` adds the ids themselves.  Columns besides doc_id and text are not read.
    """
    end = np.array([END], "<u4").tobytes()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        tokens = word_ids(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (tokens.ids(text) if text else b"") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(out, (doc, i, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in out[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return text_bytes(docs).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, rank, sequences, each, sequence, offset).

    The pieces of ``length`` with ranks from ``rank`` on fill ``sequences`` sequences from
    ``sequence`` on, ``each`` pieces in a row from ``offset`` on.  Sequences with the same room
    form runs; the tightest run that a length fits is filled first, and as best fit would, a
    sequence takes further pieces of that length while they fit.  The size of the plan depends
    on ``capacity``, not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free places -> runs (first sequence, sequences)
    free: list[int] = []  # keys of room, ascending
    runs, next_sequence = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(free, left)
        room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                each = min(capacity // length, todo)
                n = todo // each
                left, first = capacity, next_sequence
                next_sequence += n
            else:
                left = free[at]
                first, n = room[left].pop()
                each = min(left // length, todo)
                used = min(n, todo // each)
                if used < n:
                    room[left].append((first + used, n - used))
                    n = used
                if not room[left]:
                    del room[left]
                    free.remove(left)
            runs.append((length, rank, n, each, first, capacity - left))
            rank += n * each
            todo -= n * each
            if left - each * length:
                put(left - each * length, first, n)
    return runs


#: Most slots of one row of the plan; rows are dealt to all tasks.
RUN = 1 << 17


def slots(spark: SparkSession, runs: list[tuple]) -> DataFrame:
    """(length, rank, sequence_id, offset): the planned runs as rows, made where they are needed."""
    cut = [(length, rank + i * each, min(step, n - i), each, first + i, offset)
           for length, rank, n, each, first, offset in runs
           for step in (max(1, RUN // each),) for i in range(0, n, step)]
    frame = (spark.createDataFrame(cut, "length long, rank long, n long, each long, first long, offset long")
             .repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    slots_of_run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") * F.col("each") - 1))
    return (frame.select("*", slots_of_run.alias("i"))
            .select("length", (F.col("rank") + F.col("i")).alias("rank"),
                    (F.col("first") + F.floor(F.col("i") / F.col("each"))).alias("sequence_id"),
                    (F.col("offset") + F.col("i") % F.col("each") * F.col("length")).alias("offset")))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its place there.

    An empty table gives an empty result; repeated rows are packed each on its own; pieces with
    equal lengths take their slots by id and piece.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, path or vocabulary_path(), capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = gapless(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    return (ranked.join(slots(spark, plan(histogram, capacity)), ["length", "rank"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read_table(prepare(spark), folder, "documents"))
