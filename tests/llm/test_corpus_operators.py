"""Operators over the whole corpus: components, fingerprints, vectors, shards, mixing, scoring, pipeline."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest_odd import ODD
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from inkveil.llm import golay, graph, hash_tree, lbl_lm, multi_index, simhash, soft_mixing
from inkveil.llm.common import gapless, read_table

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


def least_reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)] + [(5, None)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    assert got == least_reachable({n for p in real for n in p}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gapless_with_a_hot_group(spark):
    frame = spark.range(3_000).selectExpr("id", "if(id % 3 = 0, 1, id % 50) AS k")
    counts = Counter(r["k"] for r in frame.collect())
    got = {}
    for r in gapless(frame, ["k"], ["id"], "n").collect():
        got.setdefault(r["k"], []).append(r["n"])
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in counts.items()}


# SimHash

def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for _ in range(4):
        y = x.copy()
        for _ in range(2):
            y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
        both = [{} for _ in range(2)]
        for side, v in zip(both, (x, y), strict=True):
            for row, key in zip(*golay.keys(v), strict=True):
                side.setdefault(int(row), set()).add(int(key))
        assert all(both[0][i] & both[1][i] for i in range(len(x)))
    words = np.arange(1 << 12) * 2047 % (1 << 23)
    for bit in range(23):
        a, b = golay.indices(words), golay.indices(words ^ (1 << bit))
        assert all((set(p) & set(q)) - {-1} for p, q in zip(a, b, strict=True))


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_all_pairs(spark, docs):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 40
    texts = [*ODD, *(base + f"end{i}" for i in range(25)), *(r["text"] for r in table(spark, "documents"))]
    rows = {r["doc_id"]: r for r in simhash.simhash_components(docs(texts)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r["fp"] % (1 << 64) for i, r in rows.items()} == prints
    assert {i: r["component_id"] for i, r in rows.items()} == least_reachable(prints, links)
    assert simhash.simhash_components(docs([])).count() == 0


def test_one_of_each_group_stays(spark, docs):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 40
    texts = [*ODD, *(base + f"end{i}" for i in range(25)), *(r["text"] for r in table(spark, "documents"))]
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    groups = least_reachable(prints, links)
    frame = docs(texts)
    for rows in (frame, frame.union(frame)):
        kept = simhash.keep_one_of_each(rows.withColumn("fp", F.create_map(F.lit("a"), F.lit(1))))
        assert kept.columns == [*frame.columns, "fp"]
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))
    assert simhash.keep_one_of_each(frame.limit(0)).count() == 0


def test_texts_with_equal_ids_stay_and_copies_without_an_id_go(docs):
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "c"), (None, "c"), (3, "d"), (3, "d"), (2, "b")]
    frame = docs([]).sparkSession.createDataFrame([(i, texts[k]) for i, k in rows], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"][0]) for r in simhash.keep_one_of_each(frame).collect()}
    assert kept == {(1, "a"), (1, "b"), (None, "c"), (3, "d")} and simhash.keep_one_of_each(frame).count() == 4


# vectors

def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    vectors = [list(map(float, r["embedding"])) for r in table(spark, "embeddings")][:300]
    for v in list(vectors[:40]):
        side = rng.normal(size=len(v))
        vectors += [v, (np.array(v) + side / np.linalg.norm(side) * np.linalg.norm(v) * rng.uniform(0.1, 0.4)).tolist()]
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows = [(i, v, 0, "x") for i, v in enumerate([*vectors, *bad])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    got = {r["vec_id"]: r for r in multi_index.near_vectors(frame).collect()}
    x = np.array(vectors, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if a < b]
    links = Counter(n for p in pairs for n in p)
    found = sum(got[i]["n_links"] for i in range(len(vectors)))
    assert 0.97 * 2 * len(pairs) <= found <= 2 * len(pairs)
    assert all(got[i]["n_links"] <= links[i] for i in range(len(vectors)))
    want = least_reachable(range(len(vectors)), pairs)
    assert sum(got[i]["component_id"] == want[i] for i in want) >= 0.97 * len(want)
    for i in range(len(vectors), len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert multi_index.near_vectors(frame.limit(0)).count() == 0


def test_traversal_visits_nearest_cells_first():
    rng = np.random.default_rng(4)
    grid = multi_index.Grid(rng.normal(size=(12, 3)), rng.normal(size=(12, 3)), 20)
    x = rng.normal(size=(30, 6))
    p, q = grid.halves(x)
    for i, cells in enumerate(grid.traverse(x)):
        total = (p[i][:, None] + q[i][None, :]).ravel()
        assert np.allclose(total[cells], np.sort(total)[:20])


def test_traversal_of_all_cells_visits_each_once():
    rng = np.random.default_rng(6)
    p, q = (sorted(rng.integers(0, 4, n).tolist()) for n in (5, 9))  # many ties
    seen = multi_index.multi_sequence(p, q, 45)
    assert len(set(seen)) == 45
    assert [p[i] + q[j] for i, j in seen] == sorted(a + b for a in p for b in q)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_links_to_planted_partners(spark, kind):
    """The given 2,000 vectors and a partner of every second one, at cosines from 0.95 on."""
    rng = np.random.default_rng(8)
    x = np.array([r["embedding"] for r in table(spark, "embeddings", "/root/testdata/sf0.1")], np.float64)
    side = rng.normal(size=x[::2].shape)
    cosine = rng.uniform(0.95, 0.999, (len(side), 1))
    unit = multi_index.unit(x[::2])
    side = multi_index.unit(side - (side * unit).sum(axis=1, keepdims=True) * unit)
    partner = cosine * unit + np.sqrt(1 - cosine ** 2) * side
    x = np.concatenate((x, partner)).astype(np.float32 if kind == "float" else np.float64)
    frame = spark.createDataFrame(list(enumerate(x.tolist())), f"vec_id long, embedding array<{kind}>")
    unit = multi_index.unit(x.astype(np.float64))
    links = dict(enumerate(((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()))
    assert sum(links.values()) > 1_900
    assert {r["vec_id"]: r["n_links"] for r in multi_index.near_vectors(frame).collect()} == links


# shards

def test_sharding(spark, docs):
    texts = [*ODD, *(f"text {i}" for i in range(3_000))]
    frame = docs(texts)
    rows = hash_tree.place(frame.union(frame.limit(5))).collect()
    slots = {}
    for r in rows:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0.08 < sum(r["grown_shard"] == 8 for r in rows) / len(rows) < 0.15
    assert all(0.09 < len(s) / len(rows) < 0.16 for s in slots.values())
    assert hash_tree.place(frame.limit(0)).count() == 0


def test_a_changed_weight_moves_rows_in_its_subtree_only(spark):
    from pyspark.sql import functions as F

    before = hash_tree.Tree.of(8)
    regions = [[list(rack) for rack in region] for region in before.regions]
    regions[1][0][0] = (4, 3.0)
    after = hash_tree.Tree(tuple(tuple(tuple(map(tuple, rack)) for rack in region) for region in regions))
    key = F.col("id").cast("string")
    rows = spark.range(4_000).select(hash_tree.shard_of(key, before).alias("a"), hash_tree.shard_of(key, after).alias("b")).collect()
    moved = [r for r in rows if r["a"] != r["b"]]
    assert moved and all(r["b"] // 4 == 1 for r in moved)  # only into the region that gained
    assert all(r["b"] // 2 == 2 for r in moved if r["a"] // 4 == 1)  # inside it only into the rack that gained
    assert 0.25 < sum(r["b"] == 4 for r in rows) / len(rows) < 0.36


# mixing

def objective(rates, tokens, p, targets):
    w = tokens / tokens.sum()
    return ((w * rates) @ p - targets) @ ((w * rates) @ p - targets) / 2 + soft_mixing.EASE / 2 * (w @ (rates - 1) ** 2)


def test_rates_are_the_least_squares(recwarn):
    rng = np.random.default_rng(8)
    tokens = rng.integers(1, 500, 200).astype(float)
    for kind, targets in (([8, 1, 1], [0.92, 0.05, 0.03]), ([3, 1.8, 0.3], [0.8, 0.08, 0.12]), ([2, 1, 1], [0.4, 0.3, 0.3])):
        p = rng.dirichlet(kind, len(tokens))
        rates = np.array(soft_mixing.solve_rates(tokens.tolist(), p.tolist(), targets))
        assert (rates >= 0).all() and abs((tokens * rates).sum() / tokens.sum() - 1) < 0.01
        assert np.abs((tokens * rates) @ p / tokens.sum() - targets).max() < 3 * soft_mixing.MET
        least = objective(rates, tokens, p, np.array(targets))
        for _ in range(200):  # no step to any side is better
            other = np.maximum(0, rates + rng.normal(0, 10 ** rng.uniform(-4, 0), len(rates)))
            assert objective(other, tokens, p, np.array(targets)) >= least - 1e-12
    recwarn.clear()
    soft_mixing.solve_rates([10.0, 20.0], [[0.9, 0.1], [0.8, 0.2]], [0.1, 0.9])
    assert "cannot be met" in str(recwarn.pop().message)
    assert soft_mixing.solve_rates([], [], [1.0]) == [] and soft_mixing.solve_rates([0.0], [[1.0]], [1.0]) == [1.0]


def test_cells_are_smoothed_shares():
    cells = soft_mixing._measured([(0, 0, 90), (0, 1, 10), (107, 1, 50)], 3)
    assert len(cells) == 3 * 6 * 6 and all(abs(sum(c) - 1) < 1e-12 for c in cells)
    assert 0.85 < cells[0][0] < 0.95 and cells[107][1] > 0.9
    assert soft_mixing._measured([], 2)[5] == [0.5, 0.5]


def test_mixing_rows(spark, docs):
    frame = docs([*ODD, *(f"good words here {i} and there" for i in range(40)), *(f"%%% ### $$$ {i}" for i in range(40))])
    labelled = spark.createDataFrame([(i, "good" if i < 50 else "poor") for i in range(10, 90)] + [(None, "good"), (1, "other")],
                                     "doc_id long, domain string")
    targets = {"good": 0.8, "poor": 0.2}
    rows = soft_mixing.mixed(frame, labelled, targets).collect()
    assert len(rows) == 90 and all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-9 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_tokens"] == by[2]["n_tokens"] == 0 and by[5]["n_tokens"] == 2
    assert by[20]["posterior"][0] > 0.5 > by[70]["posterior"][0]
    mixed = soft_mixing.mix(frame, labelled, targets)
    assert mixed.columns == frame.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    assert soft_mixing.mixed(frame.limit(0), labelled.limit(0), targets).count() == 0
    without = frame.withColumn("doc_id", F.lit(None).cast("long"))  # nothing to learn from: all domains alike
    assert {tuple(r["posterior"]) for r in soft_mixing.mixed(without, labelled, targets).collect()} == {(0.5, 0.5)}


def mixing_figures(rows):
    tokens = np.array([r["n_tokens"] for r in rows])
    share = lambda rates: (tokens * rates) @ np.array([r["posterior"] for r in rows]) / tokens.sum()
    rates, copies = (np.array([r[c] for r in rows]) for c in ("rate", "copies"))
    return share(np.ones(len(rows))), share(rates), share(copies), (copies > 0).mean(), rates.max(), (tokens * copies).sum() / tokens.sum()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_mixing_moves_the_tables_to_the_targets(spark, folder):
    targets = np.array(list(soft_mixing.TARGETS.values()))
    documents, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    domains = soft_mixing.domains_of(labels)
    domain = {r["doc_id"]: r["domain"] for r in domains.collect()}
    for docs in (documents, corpus_pipeline.quality_rules(spark, documents, folder)):
        rows = soft_mixing.mixed(docs, domains).collect()
        present, rated, taken, kept, highest, total = mixing_figures(rows)
        assert np.abs(rated - targets).max() < soft_mixing.MET and abs(total - 1) < 0.05
        assert np.abs(taken - targets).sum() < np.abs(present - targets).sum() / 2
        assert kept > 0.8 and highest < 2.5
        # the labels' own shares, which no posterior enters, move to the targets too
        marked = [r for r in rows if r["doc_id"] in domain]
        true = lambda n: np.array([sum(r["n_tokens"] * n(r) for r in marked if domain[r["doc_id"]] == d) for d in soft_mixing.TARGETS])
        before, after = (x / x.sum() for x in (true(lambda r: 1), true(lambda r: r["copies"])))
        assert np.abs(after - targets).sum() < 0.6 * np.abs(before - targets).sum()


# language model

def test_scores(spark):
    folder = FOLDER
    rows = {r["doc_id"]: r for r in E.queries()["op3_lm_scoring"](spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents", folder)}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_class_model_is_normalised_and_learns_contexts():
    counts = np.ones((lbl_lm.CLASSES ** 2, lbl_lm.CLASSES)) * 0.01
    after = np.arange(lbl_lm.CLASSES ** 2) % lbl_lm.CLASSES
    counts[np.arange(len(after)), (after + 1) % lbl_lm.CLASSES] += 5
    table_ = lbl_lm.train(counts).table()
    assert np.allclose((10 ** table_).sum(axis=1), 1)
    assert (table_.argmax(axis=1) == (after + 1) % lbl_lm.CLASSES).mean() > 0.9


def training_texts(spark, folder=FOLDER):
    from pyspark.sql import functions as F

    docs_ = read_table(spark, folder, "documents")
    return docs_, lbl_lm.text_bytes(docs_.where(lbl_lm.remainder(F.col("doc_id"), 10) != 0))


def test_scores_are_probabilities_over_all_words(spark, monkeypatch):
    """After any two words the probabilities of all words and the unseen word of each class add up to 1."""
    monkeypatch.setattr(lbl_lm, "OWN", 300)
    model = lbl_lm.learn(training_texts(spark)[1])
    counts = {bytes(r["word"]): r["n"] for r in model.counts.collect()}
    scorer, coder = model.scorer, lbl_lm.Coder(model.scorer.words.common)
    for first in (b"the", min(counts), b"neverseen"):
        total, unseen = 0.0, np.zeros(lbl_lm.SUFFIXES)
        for word, n in counts.items():
            codes = coder.encode([first, word])
            log = np.concatenate(list(scorer.logs(codes)))[1]
            common = codes[1] < len(scorer.words.common)
            total += 10 ** (log + (0 if common else np.log10(n + lbl_lm.SMOOTH)))
        for k in range(lbl_lm.SUFFIXES):  # any code of a word that is not common, of each class
            codes = np.array([coder.encode([first])[0], len(scorer.words.common) + k * lbl_lm.ENDINGS])
            unseen[k] = 10 ** (np.concatenate(list(scorer.logs(codes)))[1] + np.log10(lbl_lm.SMOOTH))
        assert math.isclose(total + unseen.sum(), 1, rel_tol=1e-3), first


def test_vectors_of_words_beat_classes_alone(spark, monkeypatch):
    """Held-out gain over the counts alone, per token, with and without vectors beyond the frequent words."""
    from pyspark.sql import functions as F

    docs_, texts = training_texts(spark, "/root/testdata/sf0.1")
    held = docs_.where(lbl_lm.remainder(F.col("doc_id"), 10) == 0)

    def gain():
        r = lbl_lm.log_scores(held, lbl_lm.learn(texts)).agg(
            (F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).alias("gain")).first()
        return r["gain"]

    assert gain() > 0.42
    monkeypatch.setattr(lbl_lm, "OWN", 0)
    assert gain() < 0.35


def test_chunks_do_not_change_scores(spark, monkeypatch):
    model = lbl_lm.learn(training_texts(spark)[1])
    codes = np.random.default_rng(3).integers(0, len(model.scorer.words.common), 1_000)
    whole = np.concatenate(list(model.scorer.logs(codes)))
    monkeypatch.setattr(lbl_lm, "CHUNK", 7)
    assert np.allclose(np.concatenate(list(model.scorer.logs(codes))), whole, atol=1e-4)


def test_scores_of_odd_rows(docs, monkeypatch):
    from pyspark.sql import functions as F

    frame = docs(ODD)
    text = frame.select("doc_id", F.col("text").cast("binary").alias("text"))
    score = lambda: sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6))
                           for r in lbl_lm.log_scores(frame, lbl_lm.learn(text)).collect())
    all_common = score()
    monkeypatch.setattr(lbl_lm, "COMMON", 1)  # now the words meet their counts in the join
    joined = score()
    assert all_common == joined and len(joined) == len(ODD)
    none = lbl_lm.learn(text.limit(0))
    assert none.train_tokens == 0
    assert [r["n_known"] for r in lbl_lm.log_scores(frame.limit(1), none).collect()] == [0]


# pipeline

def test_pipeline(spark):
    documents = read_table(spark, FOLDER, "documents")
    at, before = documents, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, FOLDER).cache()
        assert at.columns == documents.columns, name
        assert 0 < at.count()
        assert {r["doc_id"] for r in at.collect()} <= {r["doc_id"] for r in before.collect()}
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in at.collect()}
    assert all(r["length"] <= 4096 for r in packed)
