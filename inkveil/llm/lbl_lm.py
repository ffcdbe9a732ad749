"""Language-model scoring with log-bilinear models trained by noise-contrastive estimation.

A token's probability has two factors.  The first gives its class from the class of the token
before last and the word before: the most frequent tokens are classes of their own, all others
belong to a class named by their last two bytes.  Every word above a count has a context vector of
its own, a rarer one that of its ending.  The second gives the word within its class from the group of
the word before; groups are the k-means cells of the context vectors.  Words below the count
share one slot of their class and are drawn within it by their smoothed training count.

All counts come from all training texts.  Scoring takes one matrix product for a batch of contexts
and normalises it, so scores are log-probabilities over all words and one unseen word per class.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import prepare, read_table, remainder, stored, text_bytes

#: The end token: no word holds a blank.
END = b" "
SMOOTH = 0.1
TOP, SUFFIXES = 48, 48
CLASSES = TOP + SUFFIXES
WIDTH, NOISE, STEPS, RATE = 24, 10, 250, 0.03
#: Words with vectors of their own: at least this often, and the most frequent where more are.
OWN_COUNT, OWN = 10, 20_000
#: Endings (by the last three bytes) of a class; words without a vector share that of their ending.
ENDINGS = 32
#: Groups of context words that the choice within a class depends on.
GROUPS, GROUP_ROUNDS = 64, 12
WORD_STEPS, PRIOR = 120, 4.0
#: Contexts that are normalised at once.
CHUNK = 8_192
#: Most words whose counts are sent to every task; all other words meet their counts in a join.
COMMON = 100_000
#: Words that a task keeps in memory before it hands on or forgets them.
HELD = 500_000


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, then the end; null counts as empty."""
    return [*(text or b"").lower().split(), END]


def suffix_class(word: bytes) -> int:
    return TOP + zlib.crc32(word[-2:]) % SUFFIXES


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all tokens; a task adds up its words before they are shuffled."""
    def run(batches):
        counts: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(tokens(text))
            if len(counts) > HELD:
                yield out()
                counts.clear()
        yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """Codes of words, and what the models need of a code; other words' codes name class and ending.

    ``common`` holds the words with codes of their own, ``top`` those that are a class each.
    """

    common: list[bytes]
    top: list[bytes]
    klass: np.ndarray
    context: np.ndarray  # row of the context vectors
    slot: np.ndarray  # slot within the class: a word's own, or that of the class's other words
    n_own: int

    @classmethod
    def of(cls, counts: dict[bytes, int], top: list[bytes]) -> Words:
        """``counts`` of the common words, the most frequent first."""
        at = {w: i for i, w in enumerate(top)}
        endings = [ending(w) for w in counts]
        klass = [at.get(w, TOP + e // ENDINGS) for w, e in zip(counts, endings, strict=True)]
        own, context = 0, []
        for (w, n), e in zip(counts.items(), endings, strict=True):
            has = w in at or (n >= OWN_COUNT and own < OWN)
            context.append(own if has else -1 - e)
            own += has
        others = np.arange(SUFFIXES * ENDINGS)
        context = np.concatenate((np.array(context, np.int64), -1 - others))
        klass = np.concatenate((np.array(klass, np.int64), TOP + others // ENDINGS))
        slot = np.where(context >= 0, context, own + klass - TOP)
        return cls(list(counts), top, klass, np.where(context >= 0, context, own - 1 - context), slot, own)

    @property
    def n_contexts(self) -> int:
        return self.n_own + SUFFIXES * ENDINGS

    @property
    def n_slots(self) -> int:
        return self.n_own + SUFFIXES

    @property
    def is_own(self) -> np.ndarray:
        return self.slot < self.n_own

    def of_rows(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The class of each context row or slot (``rows`` are those of the codes)."""
        out = np.empty(n, np.int64)
        out[self.n_own:] = TOP + np.arange(n - self.n_own) * SUFFIXES // max(1, n - self.n_own)
        out[rows[self.is_own]] = self.klass[self.is_own]
        return out


def ending(word: bytes) -> int:
    """Number of a word's ending, by class: ENDINGS of each."""
    return (suffix_class(word) - TOP) * ENDINGS + zlib.crc32(word[-3:]) % ENDINGS


class Coder(dict):
    """Word -> code.  Words that are not common are forgotten when there are too many."""

    def __init__(self, common: list[bytes]):
        super().__init__()
        self.codes = {w: i for i, w in enumerate(common)}

    def __missing__(self, word: bytes) -> int:
        code = self.codes.get(word)
        if code is None:
            code = len(self.codes) + ending(word)
        self[word] = code
        return code

    def encode(self, words: list[bytes]) -> np.ndarray:
        if len(self) > len(self.codes) + HELD:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def before(values: np.ndarray, first: int) -> np.ndarray:
    """The value before each one; ``first`` stands before the text."""
    return np.concatenate(([first], values[:-1]))


def triples(classes: np.ndarray) -> np.ndarray:
    """Index of (second last, last, this) for each token; before a text stand two ends (class 0)."""
    last = before(classes, 0)
    return (before(last, 0) * CLASSES + last) * CLASSES + classes


def cell_counts(texts: DataFrame, words: Words, size: int, cells) -> np.ndarray:
    """How often each of ``size`` cells occurs; ``cells(codes)`` names those of a text's tokens.

    A task adds up all its texts, so it hands on ``size`` rows at most.
    """
    common = words.common

    def run(batches):
        coder = Coder(common)
        total = np.zeros(size, np.int64)
        for batch in batches:
            found = [cells(coder.encode(tokens(t))) for t in batch.column("text").to_pylist()]
            if found:
                at, n = np.unique(np.concatenate(found), return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["i", "n"])

    summed = texts.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.float32)
    out[summed.column("i").to_numpy()] = summed.column("n").to_numpy()
    return out


class Adam:
    """Gradient steps on arrays in place."""

    def __init__(self, params: list[np.ndarray], rate: float, steps: int):
        self.params, self.rate, self.steps, self.step = params, rate, steps, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def climb(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        rate = self.rate * min(1.0, 2 * (1 - self.step / (self.steps + 1)))
        for p, g, (m, v) in zip(self.params, grads, self.moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9 ** self.step)) / (np.sqrt(v / (1 - 0.999 ** self.step)) + 1e-12)


@dataclass
class ClassModel:
    """Scores of a class: (embed[last] @ near + embed[second last] @ far) @ out.T + bias."""

    embed: np.ndarray
    out: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """Class log10-probabilities (contexts, classes)."""
        both = np.arange(CLASSES ** 2)
        return normalised((self.embed[both % CLASSES] @ self.near + self.embed[both // CLASSES] @ self.far) @ self.out.T + self.bias)


def normalised(scores: np.ndarray) -> np.ndarray:
    """log10 of the softmax of each row."""
    scores = scores - scores.max(axis=1, keepdims=True)
    return (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.log(10)


def train(counts: np.ndarray, seed: int = 11) -> ClassModel:
    """A log-bilinear model of ``counts`` (contexts, classes): how often a class follows two classes.

    Noise-contrastive estimation tells the counts from NOISE draws of the class frequencies; both
    expectations are taken over all counts in each step, and Adam follows their gradient.
    """
    rng = np.random.default_rng(seed)
    k = CLASSES
    embed, out = rng.normal(0, 0.1, (k, WIDTH)), rng.normal(0, 0.1, (k, WIDTH))
    near, far = np.eye(WIDTH), 0.5 * np.eye(WIDTH)
    noise = counts.sum(axis=0) + 0.5
    noise = noise / noise.sum()
    bias = np.log(noise)
    seen = np.flatnonzero(counts.sum(axis=1))
    second, last = seen // k, seen % k
    data = counts[seen] / max(1, counts.sum())
    drawn = NOISE * data.sum(axis=1, keepdims=True) * noise
    offset = np.log(NOISE * noise)
    adam = Adam([embed, out, near, far, bias], RATE, STEPS)
    for _ in range(STEPS if len(seen) else 0):
        one, two = embed[last], embed[second]
        context = one @ near + two @ far
        slope = contrast(context @ out.T + bias - offset, data, drawn)
        back = slope @ out
        grad_embed = np.zeros_like(embed)
        np.add.at(grad_embed, last, back @ near.T)
        np.add.at(grad_embed, second, back @ far.T)
        adam.climb([grad_embed, slope.T @ context, one.T @ back, two.T @ back, slope.sum(axis=0)])
    return ClassModel(embed, out, near, far, bias)


def contrast(odds: np.ndarray, data: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """Gradient of the noise-contrastive objective by the scores."""
    sure = 1 / (1 + np.exp(-odds))
    return data * (1 - sure) - drawn * sure


def train_contexts(model: ClassModel, counts: np.ndarray, follows: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """Context vectors (rows, width) of words and endings, trained like ``train`` on ``counts`` (rows, classes).

    A row begins at its class's vector and leaves it as far as its counts outweigh the prior.  The
    token before last enters as its mean after the row's class; ``follows`` are the class pairs.
    """
    far = (follows / np.maximum(1, follows.sum(axis=0))).T @ (model.embed @ model.far)
    start = (model.embed @ model.near)[klass]
    out, fixed = model.out.astype(np.float32), (far[klass] @ model.out.T + model.bias).astype(np.float32)
    noise = counts.sum(axis=0) + 0.5
    noise = noise / noise.sum()
    total = max(1.0, float(counts.sum()))
    data = counts / np.float32(total)
    drawn = NOISE * data.sum(axis=1, keepdims=True) * noise
    fixed -= np.log(NOISE * noise).astype(np.float32)
    start = start.astype(np.float32)
    rows = start.copy()
    adam = Adam([rows], RATE, WORD_STEPS)
    for _ in range(WORD_STEPS):
        slope = contrast(rows @ out.T + fixed, data, drawn)
        adam.climb([slope @ out - (PRIOR / total) * (rows - start)])
    return rows


def groups_of(rows: np.ndarray, weight: np.ndarray, seed: int = 12) -> np.ndarray:
    """Number of each row's k-means cell; rows count as often as they occur, but by the root."""
    rng, weight = np.random.default_rng(seed), np.sqrt(weight) + 1e-3
    centers = rows[rng.choice(len(rows), min(GROUPS, len(rows)), replace=False, p=weight / weight.sum())].astype(np.float64)
    near = np.zeros(len(rows), np.int64)
    for _ in range(GROUP_ROUNDS):
        near = ((centers ** 2).sum(axis=1) - 2 * rows @ centers.T).argmin(axis=1)
        n = np.bincount(near, weight, len(centers))
        for d in range(rows.shape[1]):
            centers[:, d] = np.where(n > 0, np.bincount(near, weight * rows[:, d], len(centers)) / np.maximum(n, 1e-9), centers[:, d])
    return near


def train_members(counts: np.ndarray, klass: np.ndarray, seed: int = 13) -> np.ndarray:
    """log10-probabilities (slots, groups) of a slot within its class after a word of a group.

    A log-bilinear model per class with common group vectors, trained on ``counts`` (slots, groups)
    against draws of the class's slots by frequency.  Classes of one token have no choice: 0.
    """
    rng = np.random.default_rng(seed)
    member = klass >= TOP
    at = np.flatnonzero(member)
    k, counts = klass[at] - TOP, counts[at]
    freq = counts.sum(axis=1) + 0.5
    noise = (freq / np.bincount(k, freq, SUFFIXES)[k]).astype(np.float32)[:, None]
    total = max(1.0, float(counts.sum()))
    data = counts / np.float32(total)
    by_class = np.zeros((SUFFIXES, counts.shape[1]), np.float32)
    np.add.at(by_class, k, data)
    drawn = NOISE * by_class[k] * noise
    vectors = np.zeros((len(at), WIDTH), np.float32)
    groups = rng.normal(0, 0.5, (counts.shape[1], WIDTH)).astype(np.float32)
    bias = np.log(noise)
    offset = np.log(NOISE * noise)
    adam = Adam([vectors, groups, bias], RATE, WORD_STEPS)
    for _ in range(WORD_STEPS):
        slope = contrast(vectors @ groups.T + bias - offset, data, drawn)
        adam.climb([slope @ groups - (PRIOR / total) * vectors, slope.T @ vectors, slope.sum(axis=1, keepdims=True)])
    scores = vectors @ groups.T + bias
    most = np.full((SUFFIXES, scores.shape[1]), -np.inf, np.float32)
    np.maximum.at(most, k, scores)
    scores -= most[k]
    mass = np.zeros(most.shape)
    np.add.at(mass, k, np.exp(scores, dtype=np.float64))
    table = np.zeros((len(klass), scores.shape[1]), np.float32)
    table[at] = (scores - np.log(mass)[k]) / np.log(10)
    return table


@dataclass
class Model:
    counts: DataFrame  # (word, n) of the training tokens, a stored table
    train_tokens: int
    distinct: int
    scorer: Scorer


@dataclass
class Scorer:
    """What a task needs to score tokens; its size does not grow with the corpus."""

    words: Words
    n: np.ndarray  # training count of the common words
    others: np.ndarray  # log10 of the smoothed count of a class's words without a slot
    near: np.ndarray  # (contexts, width)
    far: np.ndarray  # (classes, width)
    out: np.ndarray
    bias: np.ndarray
    group: np.ndarray  # of each context
    member: np.ndarray  # (slots, groups)

    def logs(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """log10-probabilities of a text's tokens, in chunks.

        For words that are not common the log of their smoothed count is still to be added.
        """
        w, n_common = self.words, len(self.words.common)
        klass = w.klass[codes]
        last, second = before(codes, 0), before(before(klass, 0), 0)
        for i in range(0, len(codes), CHUNK):
            cut = slice(i, i + CHUNK)
            code, context = codes[cut], w.context[last[cut]]
            scores = (self.near[context] + self.far[second[cut]]) @ self.out.T
            scores += self.bias
            scores -= scores.max(axis=1, keepdims=True)
            own = scores[np.arange(len(code)), klass[cut]]
            by_class = (own - np.log(np.exp(scores, out=scores).sum(axis=1))) / np.log(10)
            slot = w.slot[code]
            rare = slot >= w.n_own
            counted = np.where(code < n_common, np.log10(self.n[np.minimum(code, n_common - 1)] + SMOOTH), 0.0)
            yield (by_class + self.member[slot, self.group[context]]
                   + np.where(rare, counted - self.others[np.maximum(klass[cut] - TOP, 0)], 0.0))


def learn(texts: DataFrame) -> Model:
    """Counts over all of ``texts`` (text as bytes), then the models on them."""
    counts = stored(word_counts(texts), "word-counts")
    size = F.floor(F.log2("n") * 8).cast("int")
    n_tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = sorted(((r["s"], r["k"]) for r in counts.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, room = 1 << 30, COMMON
    for s, n in sizes:
        if n > room:
            break
        least, room = s, room - n
    rows = counts.where((size >= least) | (F.col("word") == F.lit(bytearray(END)))).collect()
    common = {bytes(r["word"]): r["n"] for r in rows} | {END: max((r["n"] for r in rows if bytes(r["word"]) == END), default=0)}
    common = dict(sorted(common.items(), key=lambda x: (x[0] != END, -x[1], x[0])))  # the end has code 0
    top = list(common)[:TOP]
    words = Words.of(common, top)
    others = np.full(SUFFIXES, np.log10(SMOOTH))
    for k, n, v in _other_words(counts, words, common):
        others[k] = np.log10(n + SMOOTH * (v + 1))
    klass, context, slot = words.klass, words.context, words.slot
    n_triples = CLASSES ** 3

    def after_words(codes: np.ndarray) -> np.ndarray:
        k = klass[codes]
        return np.concatenate((triples(k), n_triples + context[before(codes, 0)] * CLASSES + k))

    found = cell_counts(texts, words, n_triples + words.n_contexts * CLASSES, after_words)
    by_class = found[:n_triples].reshape(-1, CLASSES)
    pairs = found[n_triples:].reshape(-1, CLASSES)
    model = train(by_class.astype(np.float64))
    follows = by_class.reshape(CLASSES, CLASSES, CLASSES).sum(axis=2)
    near = train_contexts(model, pairs, follows, words.of_rows(context, words.n_contexts))
    group = groups_of(near, pairs.sum(axis=1))
    of_code = group[context]
    within = cell_counts(texts, words, words.n_slots * GROUPS, lambda codes: slot[codes] * GROUPS + of_code[before(codes, 0)])
    member = train_members(within.reshape(-1, GROUPS), words.of_rows(slot, words.n_slots))
    f32 = np.float32
    scorer = Scorer(words, np.fromiter(common.values(), float), others, near, (model.embed @ model.far).astype(f32),
                    model.out.astype(f32), model.bias.astype(f32), group, member)
    return Model(counts, int(n_tokens), int(distinct), scorer)


def _other_words(counts: DataFrame, words: Words, common: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(class, tokens, words) of the words without a slot of their own: all words less those with one."""
    klass = F.crc32(F.expr("substring(word, -2, 2)")) % SUFFIXES
    found = {r["k"]: [r["n"], r["v"]] for r in
             counts.groupBy(klass.alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    for (word, n), own in zip(common.items(), words.is_own.tolist(), strict=False):
        if own and n:
            group = found[suffix_class(word) - TOP]
            group[0] -= n
            group[1] -= 1
    return [(k, n, v) for k, (n, v) in found.items()]


def log_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    One pass sums what the models and the common words give; the other words of a text, once
    each with their number, meet their counts in a join on the word and return as sums by row.
    Null and empty texts are one end token; repeated rows are scored each on its own.
    """
    scorer = model.scorer
    n_common = len(scorer.words.common)

    def run(batches):
        coder = Coder(scorer.words.common)
        blank = np.zeros(SUFFIXES * ENDINGS)
        log_count = np.concatenate((np.log10(scorer.n + SMOOTH), blank))
        known = np.concatenate((scorer.n > 0, blank))
        for batch in batches:
            rows, ids, words, kinds, values = [], [], [], [], []
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                ws = tokens(text)
                codes = coder.encode(ws)
                lm = sum(float(part.sum(dtype=np.float64)) for part in scorer.logs(codes))
                rare = Counter([ws[i] for i in np.flatnonzero(codes >= n_common).tolist()])
                own = (float(len(ws)), float(known[codes].sum()), float(log_count[codes].sum()), lm)
                n = len(rare) + len(own)
                rows += [row] * n
                ids += [doc] * n
                words += [*rare, *[b" %d" % row] * len(own)]  # no word begins with a blank
                kinds += [0] * len(rare) + [1, 2, 3, 4]
                values += [*rare.values(), *own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(words, pa.binary()),
                 pa.array(kinds, pa.int32()), pa.array(values, pa.float64())], names=["row", "doc_id", "word", "kind", "value"])

    parts = (text_bytes(docs).withColumn("row", F.monotonically_increasing_id())
             .mapInArrow(run, "row long, doc_id long, word binary, kind int, value double")
             .join(model.counts, "word", "left"))
    own = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    is_word = F.col("kind") == 0
    logs = F.sum(F.when(is_word, F.col("value") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).otherwise(0.0))
    found = F.sum(F.when(is_word & (F.col("n") > 0), F.col("value")).otherwise(0.0))
    z = float(np.log10(model.train_tokens + SMOOTH * (model.distinct + 1)))
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), own(1).alias("n"), own(2).alias("known"),
                                    own(3).alias("logs"), own(4).alias("lm"), logs.alias("rare"), found.alias("found"))
    return sums.select(
        "doc_id", F.col("n").cast("long").alias("n_tokens"), (F.col("known") + F.col("found")).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare") - F.col("n") * z).alias("base_score"),
        (F.col("lm") + F.col("rare")).alias("score"))


HELD_OUT = (10, 0)


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(prepare(spark), folder, "documents")
    held = remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    scored = log_scores(docs, learn(text_bytes(docs.where(~held))))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
