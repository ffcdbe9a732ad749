"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import arrow_map, prepare, read_table, remainder, text_bytes

UNKNOWN = "und"
#: Hash buckets of the byte 2-, 3- and 4-grams; size of their vectors, which is a quarter of the
#: number of languages where that is more.
BUCKETS, WIDTH = 1 << 12, 16
#: About so many texts are learned from, shared evenly by all languages, but at least LEAST_EACH of each.
MAX_TEXTS, LEAST_EACH = 2_000, 8
#: Words in the short pieces of a text that are learned beside the whole, so that short texts do well too.
PIECES = (2, 6, 25)
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.5, 1e-5
#: Every fifth text calibrates; predictions below the threshold are wrong more often than this allows.
ACCEPTED_ACCURACY = 0.98

_LETTERS = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode(errors="replace"))))


def clean(text: bytes) -> bytes:
    """Lower-case letters and bytes beyond ASCII; everything else becomes single blanks."""
    return b" " + b" ".join(text.translate(_LETTERS).split()) + b" "


def subwords(cleaned: bytes) -> np.ndarray:
    """Buckets of all byte 2-, 3- and 4-grams."""
    a = np.frombuffer(cleaned, np.uint8).astype(np.uint32)
    gram, found = a, []
    for n in (2, 3, 4):
        if len(a) < n:
            break
        gram = gram[:-1] * np.uint32(0x01000193) ^ a[n - 1:]
        found.append((gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x05EBCA6B)) >> np.uint32(20))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def average(cleaned: bytes) -> np.ndarray:
    """Share of each bucket among the subwords of a text."""
    h = subwords(cleaned)
    return np.bincount(h, minlength=BUCKETS) / max(1, len(h))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a language score for each bucket: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, averages: np.ndarray) -> np.ndarray:
        return averages @ self.table + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, accepted); no letter or null: und, 0, not accepted."""
        if not text or not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0, False
        p = softmax(self.scores(average(clean(text)))[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], calibrates: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent on rows of bucket shares; then temperature and threshold from
    the rows that ``calibrates`` marks."""
    n_lang = len(languages)
    if n_lang == 0 or not len(x):
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    train = np.flatnonzero(~calibrates) if (~calibrates).any() else np.arange(len(x))
    chosen = np.zeros(len(x), np.float32)
    chosen[train] = 1 / len(train)
    mean = chosen @ x  # without copies of the matrix
    scale = 1 / max(1e-9, float(np.sqrt(max(0.0, chosen @ np.einsum("ij,ij->i", x, x) - mean @ mean))))
    width = max(WIDTH, n_lang // 4)
    embed = rng.normal(0, 0.3, (BUCKETS, width)).astype(np.float32)
    out = np.zeros((width, n_lang), np.float32)
    bias = np.zeros(n_lang, np.float32)
    target = np.eye(n_lang, dtype=np.float32)[y]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(train)
        for i in range(0, len(order), BATCH):
            rows = order[i:i + BATCH]
            b = (x[rows] - mean) * scale
            hidden = b @ embed
            gap = (softmax(hidden @ out + bias) - target[rows]) / len(rows)
            back = b.T @ (gap @ out.T)
            out -= rate * (hidden.T @ gap + DECAY * out)
            bias -= rate * gap.sum(axis=0)
            embed -= rate * (back + DECAY * embed)
    table = (embed @ out).astype(np.float64) * scale
    model = Model(languages, table, bias - mean @ table)
    held = np.flatnonzero(calibrates) if calibrates.any() else train
    z = model.scores(x[held])
    temperatures = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in temperatures]
    model.temperature = float(temperatures[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    order = np.argsort(-sure, kind="stable")
    accuracy = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(accuracy >= ACCEPTED_ACCURACY)
    model.threshold = float(sure[order[good[-1]]]) if len(good) else 1.0
    return model


def sample(labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows (draw, lang, text as bytes) to learn from, and all languages.

    The sample is drawn by a hash of id and text from the different rows of each language, so
    neither one id on very many rows nor repeated rows make it larger; null texts and languages
    are left out.  Every language that has a text is in it with at least one.
    """
    usable = labelled.select("doc_id", F.col("text").cast("binary").alias("text"), "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn(
            "draw", F.xxhash64(F.lit("lang"), "doc_id", "text"))
    place = F.pmod("draw", F.lit(1_000_000))
    counts = (usable.select("lang", "draw").distinct().groupBy("lang")
              .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).orderBy("lang").collect())
    if not counts:
        return usable.drop("doc_id").limit(0), []
    each = max(LEAST_EACH, MAX_TEXTS / len(counts))
    # the first row of a language is always below its limit
    limits = [x for r in counts for x in (F.lit(r["lang"]), F.lit(max(int(1e6 * min(1.0, each / r["n"])), r["first"] + 1)))]
    chosen = usable.where(place < F.create_map(*limits)[F.col("lang")]).dropDuplicates(["lang", "draw"])
    return chosen.drop("doc_id"), [r["lang"] for r in counts]


def learn(labelled: DataFrame) -> Model:
    """Fits on ``sample`` of ``labelled`` (doc_id, text, lang): all its languages are learned."""
    chosen, languages = sample(labelled)
    if not languages:
        return fit(np.zeros((0, BUCKETS)), np.zeros(0, int), [], np.zeros(0, bool))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        rows: dict[str, list] = {"draw": [], "lang": [], "x": []}
        for draw, lang, text in zip(*(batch.column(c).to_pylist() for c in ("draw", "lang", "text")), strict=True):
            words = clean(text).split()
            cut = [words[draw % max(1, len(words) - n + 1):][:n] for n in PIECES if len(words) > n]
            for part in ([words] if words else []) + cut:
                rows["draw"].append(draw)
                rows["lang"].append(lang)
                rows["x"].append(average(b" " + b" ".join(part) + b" ").astype(np.float16).tobytes())
        return rows

    slots = labelled.sparkSession.sparkContext.defaultParallelism
    rows = sorted(arrow_map(chosen.repartition(slots), run, "draw long, lang string, x binary").collect(),
                  key=lambda r: (r["lang"], r["draw"], r["x"]))
    x = np.empty((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r["x"], np.float16)
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[r["lang"]] for r in rows], int)
    # every fifth text of each language, never its first, so that none is left without one to learn from
    texts = {lang: {} for lang in languages}
    place = [texts[r["lang"]].setdefault(r["draw"], len(texts[r["lang"]])) for r in rows]
    return fit(x, y, languages, np.array([p % 5 == 4 for p in place], bool))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) from the text alone, in one pass without a shuffle.

    Null texts and texts without a letter are ``und`` with score 0; repeated rows get equal results.
    """
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = [model.predict(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "lang_pred": [f[0] for f in found],
                "score": [f[1] for f in found], "accepted": [f[2] for f in found]}

    return arrow_map(text_bytes(docs), run, "doc_id long, lang_pred string, score double, accepted boolean")


HELD_OUT = (4, 2)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(prepare(spark), folder, "documents")
    held = remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    found = identify(docs, learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
