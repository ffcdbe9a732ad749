"""Spelling variants: the index against all pairs, and the operator against a plain count."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest_odd import ODD

from inkveil.llm import spelling
from inkveil.llm.fm_index import Vocabulary, one_edit

FOLDER = "/root/testdata/sf0.001"


def slow_one_edit(x, y):
    near = {x[:i] + x[i + 1:] for i in range(len(x))}
    if y in near or x in {y[:i] + y[i + 1:] for i in range(len(y))}:
        return x != y
    return len(x) == len(y) and sum(a != b for a, b in zip(x, y)) == 1


def found(index, queries):
    out = []
    for right in (True, False):
        for q, w in zip(*index.near(queries, right)):
            x, y = queries[q], index.words[w]
            assert y.startswith(x[:len(x) // 2]) if right else y.endswith(x[len(x) // 2:])
            out.append((right, x, y))
    assert len(out) == len(set(out))
    return {(x, y) for _, x, y in out}


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3_000):
        x, y = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in "xy")
        assert one_edit(x, y) == slow_one_edit(x, y)


@pytest.mark.parametrize("letters", ["ab", "abcé", "a"])
def test_index_against_all_pairs(letters):
    rng = random.Random(5)
    for _ in range(40):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(7, 11))) for _ in range(rng.randrange(1, 60))})
        rng.shuffle(words)
        asked = sorted({"".join(rng.choice(letters + "z") for _ in range(rng.randrange(7, 11))) for _ in range(20)} | set(words))
        assert found(Vocabulary(words), asked) == {(x, y) for x in asked for y in words if slow_one_edit(x, y)}


def test_very_long_words():
    x, ab = "x" * 300, "ab" * 200
    words = [x, x + "x", "y" + x, x[:150] + "q" + x[151:], ab, ab + "a", "b" + ab, "shortab", "shortbb"]
    assert found(Vocabulary(words), words) == {(p, q) for p in words for q in words if slow_one_edit(p, q)}


def plain(rows):
    """The whole operator by loops over (doc_id, text)."""
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    less = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            less.setdefault(v, set()).add(w)
    near = {w: set() for w in words}
    for group in less.values():
        for w in group:
            near[w] |= {v for v in group if v != w and v not in near[w] and slow_one_edit(w, v)}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def result(frame):
    rows = frame.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert result(spelling.op12_spelling_variants(spark, FOLDER)) == plain(rows)


def test_chains_ties_and_crowded_cells(spark, docs, monkeypatch):
    monkeypatch.setattr(spelling, "MOST", 40)  # several indexes a cell
    texts = []
    for word, n in {"alphabet": 4000, "alphabed": 300, "alphaqed": 20, "alphaqeds": 2, "betatest": 30, "betatesd": 30, "betatesk": 3,
                    "Éclairée": 40, "éclairée": 3, "alphabetagamma": 2}.items():
        texts += [f"{word}, "] * n
    rng = random.Random(1)
    texts += [" ".join("".join(rng.choice("ab") for _ in range(8)) for _ in range(40)) for _ in range(30)]
    got = result(spelling.variants(docs(texts)))
    assert got == plain(list(enumerate(texts)))
    assert got["alphaqed"][:2] == ("alphabed", "alphabet")


def test_odd_rows(spark, docs):
    texts = [*ODD, "x" * 50_000, "letters letters" * 3, "letters letters" * 3]
    assert result(spelling.variants(docs(texts))) == plain(list(enumerate(texts)))
    assert spelling.variants(docs([])).count() == 0
    without = spark.createDataFrame([(None, "wordword wordword"), (None, "wordword"), (None, None)], "doc_id long, text string")
    assert result(spelling.variants(without)) == plain([(None, "wordword wordword"), (None, "wordword")])
