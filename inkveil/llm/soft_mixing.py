"""Mixing to target weights by soft membership.

A classifier learned from a labelled table gives every document a probability for each domain.
Least squares by projected gradient then finds a nonnegative rate for each document such that the
expected tokens of each domain meet their targets.  All work on documents is DataFrame expressions.
A document's probabilities are those measured on labelled documents like it (its cell), so rates
are one per cell: Spark sums the tokens of each cell, and the descent runs on these few sums.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import prepare, read_table, stored
from inkveil.session import spread

#: About so many labelled documents are learned from, by a hash of the id; two fifths of them measure the cells.
MAX_ROWS, HELD = 20_000, 2
#: Code points of a stem.  A stem is evidence if one domain's documents hold it more often than chance
#: allows by SURE standard deviations, in at least LEAST of them and a share of SUPPORT; the model has
#: the STEMS surest.  Every domain is given AVERAGE documents of the average kind.
STEM, SURE, LEAST, SUPPORT, STEMS, AVERAGE = 5, 5.0, 4, 0.02, 300, 2.0
#: Shape of a text, cut into so many bins each.
BINS = 8
#: A cell: the likeliest domain, how far its evidence leads (log-ratio), and the number of tokens.
LEADS, LENGTHS = (0.5, 1.0, 2.0, 4.0, 8.0), (16, 64, 256, 1024, 4096)
#: Documents of the wider cell that each cell is given.
SMOOTH = 4.0
#: EASE weighs the squared distance of the rates from 1 against the squared gap in token shares: it limits
#: how far a mix may go.  The descent ends at steps below PRECISION; a gap above MET is reported.
EASE, PRECISION, MET = 1e-4, 1e-12, 5e-3
#: Token shares wanted from the domains of the labelled table, whatever shares a table has: nearly all
#: good, a little poor text for breadth, and only as much toxic text as it takes to recognise it.
TARGETS = {"good": 0.92, "poor": 0.05, "toxic": 0.03}

_SPACE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts: none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(trimmed), "[ \\t-\\r]+"))


def shape(text: Column, tokens: Column, distinct: Column) -> list[Column]:
    """Bins 0 to BINS - 1: symbols to a word, distinct words and words to a line."""
    raw = F.coalesce(text, F.lit(""))
    n = F.greatest(F.size(tokens), F.lit(1))
    symbols = F.regexp_count(raw, F.lit("[#*$%&|<>!]")) / n
    lines = F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit("\n"), F.lit(""))) + 1
    whole = lambda x: F.least(F.lit(BINS - 1), F.floor(x)).cast("int")
    return [whole(F.log2(symbols * 128 + 1)), whole(F.size(distinct) / n * BINS), whole(F.log2(n / lines + 1))]


def featured(rows: DataFrame) -> DataFrame:
    """``rows`` with __n_tokens, __stems (beginnings of the distinct words) and __shape of their ``__text``."""
    split = rows.withColumn("__words", words(F.col("__text")))
    known = split.withColumn("__distinct", F.array_distinct("__words"))
    return known.select(
        *rows.columns, F.size("__words").cast("long").alias("__n_tokens"),
        F.transform("__distinct", lambda w: F.substring(w, 1, STEM)).alias("__stems"),
        F.array(*shape(F.col("__text"), F.col("__words"), F.col("__distinct"))).alias("__shape"))


def _table(values: list) -> Column:
    """A constant array of numbers, or of arrays of numbers."""
    return F.array(*(_table(v) if isinstance(v, list) else F.lit(float(v)) for v in values))


def _bin(value: Column, edges: tuple) -> Column:
    return reduce(lambda found, e: found + (value >= e).cast("int"), edges, F.lit(0))


@dataclass
class Classifier:
    """Evidence from stems and shape as log-ratios to the first domain, and the probabilities of each cell."""

    domains: list[str]
    start: list[float]
    stems: dict[str, list[float]]
    shape: list[list[list[float]]]
    cells: list[list[float]]

    def placed(self, rows: DataFrame) -> DataFrame:
        """``featured`` rows with __cell in place of __stems and __shape."""
        names = list(self.stems)
        others = [c for c in rows.columns if c not in ("__stems", "__shape")]
        if names:
            met = F.array_intersect("__stems", F.array(*map(F.lit, names)))
        else:
            met = F.array().cast("array<string>")
        ratios = F.map_from_arrays(F.array(*map(F.lit, names)), _table(list(self.stems.values()))) if names else None
        found = rows.select(*others, "__shape", met.alias("__met"))
        if names:
            found = found.withColumn("__met", F.transform("__met", lambda s: F.element_at(ratios, s)))

        def evidence(k: int) -> Column:
            total = F.lit(self.start[k])
            for j, bins in enumerate(self.shape[k]):
                total = total + F.get(_table(bins), F.get("__shape", F.lit(j)))
            if not names:
                return total
            return F.aggregate("__met", total, lambda a, ratio: a + F.get(ratio, F.lit(k)))

        k = len(self.domains)
        scored = found.select(*others, F.array(F.lit(0.0), *(evidence(i) for i in range(1, k))).alias("__z"))
        ranked = F.sort_array("__z", asc=False)
        lead = F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)) if k > 1 else F.lit(LEADS[-1])
        best = (F.array_position("__z", F.array_max("__z")) - 1).cast("int")
        cell = (best * (len(LEADS) + 1) + _bin(lead, LEADS)) * (len(LENGTHS) + 1) + _bin(F.col("__n_tokens"), LENGTHS)
        return scored.select(*others, cell.alias("__cell"))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> Classifier:
    """From ``labelled`` (doc_id, domain); ids named twice count for each of their domains.

    Null ids and other domains are left out.  Without labels all domains are equally likely.
    """
    known = labelled.select("doc_id", "domain").where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).distinct()
    place = lambda: F.pmod(F.xxhash64(F.lit("mixing"), F.col("doc_id")), F.lit(1_000_000)) / 1e6
    share = min(1.0, MAX_ROWS / max(1, known.count()))
    rows = spread(docs.select("doc_id", F.col("text").alias("__text")).where(place() < share)).join(known.where(place() < share), "doc_id")
    held = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(5)) < HELD
    sample = stored(featured(rows).select("domain", "__n_tokens", "__stems", "__shape", held.alias("held")), "labelled")
    learned = sample.where(~F.col("held"))
    k_of = {d: k for k, d in enumerate(domains)}
    docs_of = [0] * len(domains)
    for r in learned.groupBy("domain").count().collect():
        docs_of[k_of[r["domain"]]] = r["count"]
    n = max(1, sum(docs_of))
    bins = [[[1.0] * BINS for _ in range(3)] for _ in domains]
    for r in learned.select("domain", F.posexplode("__shape").alias("j", "b")).groupBy("domain", "j", "b").count().collect():
        bins[k_of[r["domain"]]][r["j"]][r["b"]] += r["count"]
    stems, absent = {}, [0.0] * len(domains)
    for r in _telling(learned, domains, docs_of).collect():
        average = (r["total"] + 1) / (n + 2)
        chance = [(r[f"c{k}"] + AVERAGE * average) / (m + AVERAGE) for k, m in enumerate(docs_of)]
        present = [math.log(p / chance[0]) for p in chance]
        without = [math.log((1 - p) / (1 - chance[0])) for p in chance]
        stems[r["stem"]] = [a - b for a, b in zip(present, without, strict=True)]
        absent = [a + b for a, b in zip(absent, without, strict=True)]
    log = lambda x: [math.log(v / sum(x)) for v in x]
    less = lambda x, y: [p - q for p, q in zip(log(x), log(y), strict=True)]
    start = [math.log((m + 1) / (docs_of[0] + 1)) + a for m, a in zip(docs_of, absent, strict=True)]
    model = Classifier(domains, start, stems, [[less(b, bins[0][j]) for j, b in enumerate(own)] for own in bins], [])
    counts = model.placed(sample.where("held")).groupBy("__cell", "domain").count().collect()
    model.cells = _measured([(r["__cell"], k_of[r["domain"]], r["count"]) for r in counts], len(domains))
    return model


def _telling(learned: DataFrame, domains: list[str], docs_of: list[int]) -> DataFrame:
    """(stem, total, c0, c1, …) of the stems that one domain's documents hold surely more often than others."""
    n = max(1, sum(docs_of))
    counts = (learned.select("domain", F.explode(F.array_distinct("__stems")).alias("stem")).groupBy("stem")
              .agg(F.count(F.lit(1)).alias("total"),
                   *(F.count(F.when(F.col("domain") == d, 1)).alias(f"c{k}") for k, d in enumerate(domains))))
    deviations = []
    for k, m in enumerate(docs_of):
        expected = F.col("total") * m / n
        above = (F.col(f"c{k}") - expected) / F.sqrt(expected * (1 - m / n) + 1e-9)
        deviations.append(F.when(F.col(f"c{k}") >= max(LEAST, SUPPORT * m), above).otherwise(0.0))
    sure = counts.withColumn("sure", F.greatest(*deviations) if len(deviations) > 1 else deviations[0])
    return sure.where(F.col("sure") > SURE).orderBy(F.desc("sure"), "stem").limit(STEMS)


def _measured(counts: list[tuple[int, int, int]], k: int) -> list[list[float]]:
    """Shares of the domains among the held-out documents of each cell, each smoothed towards the wider cell."""
    leads, lengths = len(LEADS) + 1, len(LENGTHS) + 1
    levels = [lambda c: 0, lambda c: c // lengths // leads, lambda c: c // lengths, lambda c: c]
    sums = [{} for _ in levels]
    for cell, domain, n in counts:
        for level, found in zip(levels, sums, strict=True):
            found.setdefault(level(cell), [0] * k)[domain] += n
    out = []
    for cell in range(k * leads * lengths):
        share = [1 / k] * k
        for level, found in zip(levels, sums, strict=True):
            own = found.get(level(cell), [0] * k)
            share = [(a + SMOOTH * s) / (sum(own) + SMOOTH) for a, s in zip(own, share, strict=True)]
        out.append(share)
    return out


def solve_rates(tokens: list[float], chances: list[list[float]], targets: list[float]) -> list[float]:
    """A rate for each cell of ``tokens`` and ``chances``; 1 if there are no tokens.

    Minimises half the squared gap between the domains' expected token shares and the targets plus
    EASE / 2 times the mean squared distance of the rates from 1, by projected gradient steps with
    momentum (a cell weighs as its tokens).  Rates are cut at 0.  The problem is strictly convex,
    so the end is the one best mix; a gap that remains is reported by a warning.
    """
    total = sum(tokens)
    rates = ahead = [1.0] * len(tokens)
    if not total:
        return rates
    weights = [t / total for t in tokens]

    def gap(at: list[float]) -> list[float]:
        taken = [w * r for w, r in zip(weights, at, strict=True)]
        return [sum(t * p[k] for t, p in zip(taken, chances, strict=True)) - want for k, want in enumerate(targets)]

    length, root = 1 / (1 + EASE), math.sqrt(EASE / (1 + EASE))
    momentum = (1 - root) / (1 + root)
    while True:
        g = gap(ahead)
        new = [max(0.0, r - length * (sum(a * b for a, b in zip(g, p, strict=True)) + EASE * (r - 1)))
               for r, p in zip(ahead, chances, strict=True)]
        moved = max(abs(a - b) for a, b in zip(new, ahead, strict=True))
        ahead = [a + momentum * (a - b) for a, b in zip(new, rates, strict=True)]
        rates = new
        if moved < PRECISION:
            break
    g = gap(rates)
    if max(map(abs, g)) > MET:
        warnings.warn("targets cannot be met; the nearest shares within the limit are "
                      + ", ".join(f"{t + d:.4f} for {t}" for d, t in zip(g, targets, strict=True)), stacklevel=2)
    return rates


def _rated(docs: DataFrame, kept: list[Column], labelled: DataFrame,
           targets: Mapping[str, float]) -> tuple[DataFrame, Classifier, list[float]]:
    """``kept`` columns with __n_tokens, __cell, __rate and __copies: every text is scored once."""
    model = learn(docs, labelled, list(targets))
    drawn = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    rows = spread(docs).select(*kept, drawn.alias("__drawn"), F.col("text").alias("__text"))
    members = stored(model.placed(featured(rows)).drop("__text"), "members")
    sums = {r["__cell"]: float(r["n"]) for r in members.groupBy("__cell").agg(F.sum("__n_tokens").alias("n")).collect()}
    filled = sorted(c for c, n in sums.items() if n)
    solved = solve_rates([sums[c] for c in filled], [model.cells[c] for c in filled], list(targets.values()))
    rates = [1.0] * len(model.cells)
    for c, r in zip(filled, solved, strict=True):
        rates[c] = r
    # texts without tokens are no part of the mix
    rate = F.when(F.col("__n_tokens") == 0, 1.0).otherwise(F.get(_table(rates), F.col("__cell")))
    floor = F.floor("__rate")
    copies = (floor + (F.col("__drawn") < F.col("__rate") - floor).cast("long")).cast("long")
    return members.withColumn("__rate", rate).withColumn("__copies", copies), model, rates


def mixed(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies) of each row of ``docs``.

    ``targets`` are shares of the documents' tokens for each domain.  ``copies`` is how often a
    document is taken: the rate, rounded by a hash of its id and text.  Null and blank texts have no
    tokens, the posterior of their shape and a rate of 1; repeated rows get equal rates; an empty
    table gives an empty result.
    """
    rated, model, _ = _rated(docs, [F.col("doc_id")], labelled, targets)
    return rated.select("doc_id", F.col("__n_tokens").alias("n_tokens"),
                        F.get(_table(model.cells), F.col("__cell")).alias("posterior"),
                        F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """Rows of ``docs``, each as often as its copies say, all columns as they are."""
    rated = _rated(docs, [F.struct(*docs.columns).alias("__row")], labelled, targets)[0]
    each = rated.select("__row", F.explode_outer(F.array_repeat(F.lit(1), F.col("__copies").cast("int"))).alias("__copy"))
    return each.where(F.col("__copy").isNotNull()).select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the table of labels: toxic, else good or poor by quality; without either label: none."""
    domain = (F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor"))
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(prepare(spark), folder, "documents")
    return mixed(docs, domains_of(read_table(spark, folder, "labels")))
