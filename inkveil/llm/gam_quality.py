"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles over the features, each on the bins of one feature, then on
the bins of chosen pairs.  Their sum is a lookup table for each feature and pair, so a score is
a sum of table entries, looked up for all texts of a batch at once.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import arrow_map, prepare, read_table, remainder, stored, text_bytes

FEATURES = ("log_words", "word_bytes", "symbols", "marks", "capitals", "digits", "dup_lines", "distinct_words",
            "top_word", "line_words", "same_next", "beyond_ascii", "stops", "pipes", "distinct_pairs", "short_words")
#: At most about so many labelled rows are learned from, by a hash of the id.
MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 24, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.15, 5.0
#: Least score that predicts label 1.
THRESHOLD = 0.3


def features(text: bytes | None) -> list[float]:
    """One number for each of FEATURES; null and empty texts: all zero."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    letters = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    capitals, small = int(letters[65:91].sum()), int(letters[97:123].sum())
    lines = [line for line in text.split(b"\n") if line.strip()]
    counts = Counter(words)
    of = lambda chars: int(letters[list(chars)].sum())
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, of(b"#*$%&<>") / n, of(b"!?") / n,
        capitals / max(1, capitals + small), of(b"0123456789") / size, 1 - len(set(lines)) / len(lines),
        len(counts) / n, max(counts.values()) / n, n / len(lines), same / n,
        int(letters[128:].sum()) / size, of(b".") / n, of(b"|") / n,
        len(set(zip(words[1:], words[:-1], strict=True))) / max(1, n - 1), sum(len(w) <= 3 for w in words) / n,
    ]


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Quantile edges; a value's bin is the number of edges at or below it."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _bin(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with these gradient and curvature sums; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g), np.cumsum(h)
    gain = cg[:-1] ** 2 / (ch[:-1] + RIDGE) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + RIDGE) - cg[-1] ** 2 / (ch[-1] + RIDGE)
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to four leaves over the ordered bins, as a value for each bin."""
    out = np.empty(len(g))
    _, cut = _split(g, h)
    for part in (slice(0, cut), slice(cut, None)):
        pg, ph = g[part], h[part]
        if len(pg):
            gain, inner = _split(pg, ph)
            value = np.full(len(pg), _leaf(pg.sum(), ph.sum()))
            if gain > 0 and inner:
                value[:inner], value[inner:] = _leaf(pg[:inner].sum(), ph[:inner].sum()), _leaf(pg[inner:].sum(), ph[inner:].sum())
            out[part] = value
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A cut along one axis, then one along the other on each side; the better order of axes, with its gain."""
    best = (np.zeros_like(g), -1.0)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, cut = _split(a.sum(axis=1), b.sum(axis=1))
        out = np.zeros_like(a)
        for part in (slice(0, cut), slice(cut, None)):
            pg, ph = a[part].sum(axis=0), b[part].sum(axis=0)
            more, inner = _split(pg, ph)
            gain += more
            out[part, :inner], out[part, inner:] = _leaf(pg[:inner].sum(), ph[:inner].sum()), _leaf(pg[inner:].sum(), ph[inner:].sum())
        if gain > best[1]:
            best = (out.T if turned else out, gain)
    return best


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 by table lookups."""
        total = np.full(len(x), self.base)
        if len(x) and self.edges:
            bins, coarse = _bin(x, self.edges), _bin(x, self.pair_edges)
            for j, table in enumerate(self.tables):
                total += table[bins[:, j]]
            for i, j, table in self.pairs:
                total += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts main effects in cycles, then the pairs whose trees would gain most.

    Without rows the score is 0.5; with one label only it is near that label.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 2 or y.min() == y.max():
        return Model(base)
    edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    coarse_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins, coarse = _bin(x, edges), _bin(x, coarse_edges)
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)))
            table += step
            total += step[bins[:, j]]
    sizes = [len(e) + 1 for e in coarse_edges]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        at, n = coarse[:, i] * sizes[j] + coarse[:, j], sizes[i] * sizes[j]
        return np.bincount(at, g, n).reshape(sizes[i], sizes[j]), np.bincount(at, h, n).reshape(sizes[i], sizes[j])

    ranked = sorted(itertools.combinations(range(x.shape[1]), 2), key=lambda p: -_pair_tree(*sums(*p))[1])
    pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            step = RATE * _pair_tree(*sums(i, j))[0]
            table += step
            total += step[coarse[:, i], coarse[:, j]]
    return Model(base, edges, tables, coarse_edges, pairs)


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most about MAX_ROWS of the documents that ``labels`` (doc_id, quality 0/1) names.

    Null labels are left out; of several labels of one id, the majority counts, a tie as 1.  Ids are
    drawn first; were their different rows still more, as with one id on very many rows, these are drawn too.
    """
    known = (labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")))
    n = known.count()
    place = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_000)) / 1e6
    chosen = known.where(place < min(1.0, MAX_ROWS / max(1, n)))
    rows_of = text_bytes(docs.select("doc_id", "text").where(place < min(1.0, MAX_ROWS / max(1, n))).join(chosen, "doc_id"), F.col("y"))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"),
                "x": [features(t) for t in batch.column("text").to_pylist()]}

    found = stored(arrow_map(rows_of, run, "doc_id long, y double, x array<double>").distinct(), "quality-rows")
    row = F.pmod(F.xxhash64("doc_id", "x"), F.lit(1_000_000)) / 1e6
    rows = sorted(found.where(row < min(1.0, MAX_ROWS / max(1, found.count()))).collect(), key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], float))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) from the text alone, in one pass without a shuffle.

    Null and empty texts score as a text whose features are all zero; repeated rows score equally.
    """
    def run(batch: pa.RecordBatch) -> dict[str, list]:
        score = model.score(_matrix(batch.column("text").to_pylist()))
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return arrow_map(text_bytes(docs), run, "doc_id long, score double, predicted int")


HELD_OUT = (5, 0)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    held = remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    found = classify(docs, learn(docs.where(~held), labels.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")
