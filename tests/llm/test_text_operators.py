"""Operators on single texts: rules, personal data, language, quality, tokens."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from conftest_odd import ODD
from tokenizers import Tokenizer

import __spark_entry__ as E
from inkveil.llm import compression_rules, gam_quality, lang_id, packing, pii

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def noise(seed, n, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


# quality rules

def plain_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_counts_match_plain_version():
    for text in [*noise(1, 300, "ab \n\t#|é"), "a b c a b c", "a a a a", "x\n x\nx\n\n\n"]:
        assert compression_rules.counts(text.encode()) == plain_counts(text)


def test_bands():
    prose = " ".join(noise(2, 400, "abcdefghij"))
    import zstandard
    zip_ = zstandard.ZstdCompressor(level=3)
    assert compression_rules.verdict(prose.encode(), zip_)["kept"]
    assert not compression_rules.verdict(("the same words again " * 200).encode(), zip_)["kept"]
    # repetitive only in chunks: distinct words, then a long run
    assert not compression_rules.verdict((prose + " " + "aaaa" * 5_000).encode(), zip_)["kept"]


def test_rules_on_odd_rows(docs):
    frame = docs(ODD)
    rows = compression_rules.quality_rules(frame).collect()
    assert len(rows) == len(ODD) and all(r["base_failed"] for r in rows)
    assert compression_rules.keep_good(frame).count() == 0
    assert compression_rules.keep_good(frame).columns == frame.columns
    assert compression_rules.quality_rules(frame.limit(0)).count() == 0


# personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return [(s, e, k) for s, k, e in sorted(out)]


def test_base_spans_match_plain_patterns():
    texts = noise(3, 3000, "0123456789@.+- (a") + noise(4, 3000, "12@.a") + noise(5, 3000, "4 -11")
    texts += ["mail a@b.c@d.e.f x@y", "4111 1111-1111 1111", "1.2.3.4.5.6.7.8 000000001.2.3.255", "é+1 (555) 555-1234."]
    for text in texts:
        assert [x[:3] for x in pii.spans(text) if x[2] < 4] == plain_base(text), text


def test_checksums_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    text = "bank iban GB82 WEST 1234 5698 7654 32 ok"
    assert [text[s:e] for s, e, k, _ in pii.spans(text) if pii.KINDS[k] == "iban"] == ["GB82 WEST 1234 5698 7654 32"]
    short = "4222222222222"  # thirteen digits that pass Luhn: only with context
    assert not [x for x in pii.spans(short) if x[2] == 5]
    assert [x for x in pii.spans("visa card " + short) if x[2] == 5]
    assert pii.redact("me a@b.cd, you", pii.spans("me a@b.cd, you")) == "me [EMAIL], you"


@pytest.mark.parametrize("text, number", [
    ("IBAN GB82 WEST 1234 5698 7654 32 BIC", "GB82 WEST 1234 5698 7654 32"),
    ("DE89 3704 0044 0532 0130 00 Please pay", "DE89 3704 0044 0532 0130 00"),
    ("DE89 3704 0044 0532 0130 00 USD 500", "DE89 3704 0044 0532 0130 00"),
    ("DE89370400440532013000 A B", "DE89370400440532013000"),
    ("XY12 DE89370400440532013000", "DE89370400440532013000"),  # a start that fails hides none behind it
    ("DE89370400440532013000x", None), ("DE88370400440532013000", None), ("DE89 3704 0044", None),
])
def test_account_numbers_end_where_they_should(text, number):
    found = [text[s:e] for s, e, k, _ in pii.spans(text) if pii.KINDS[k] == "iban"]
    assert found == ([number] if number else [])


def test_account_numbers_of_every_country():
    rng = random.Random(5)
    for country, n in pii.IBAN_LENGTH.items():
        body = "".join(rng.choice("0123456789ABCXYZ") for _ in range(n - 4))
        check = next(f"{c:02}" for c in range(2, 99) if pii.mod97(f"{country}{c:02}{body}"))
        whole = f"{country}{check}{body}"
        grouped = " ".join(whole[i:i + 4] for i in range(0, n, 4))
        for written in (whole, grouped):
            text = f"to {written} EUR 12, or"
            assert [text[s:e] for s, e in pii.ibans(text)] == [written]


@pytest.mark.parametrize("unit", ["a", "a.", "1", "1.", "1 ", "+1", "+1(", "@", "a@", "a@b.", "AB12 "])
def test_patterns_are_linear(unit):
    start = time.perf_counter()
    pii.spans(unit * (400_000 // len(unit)) + "!")
    assert time.perf_counter() - start < 4


def test_pii_on_odd_rows(docs):
    frame = docs([*ODD, "write to a.b@c.de"])
    found = pii.find_pii(frame).collect()
    assert [len(r["spans"]) for r in found] == [0] * len(ODD) + [1]
    clean = {r["doc_id"]: r for r in pii.redact_documents(frame).collect()}
    assert clean[len(ODD)]["text"] == "write to [EMAIL]" and clean[len(ODD)]["n_chars"] == 16
    assert clean[0]["text"] is None and clean[7]["text"] == ODD[7]
    assert pii.redact_documents(frame.limit(0)).count() == 0


def test_pii_query_digest(spark):
    rows = E.queries()["op9_pii"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[2] == i for x in base) for i in range(4)]
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


# language

def test_language_held_out_accuracy(spark):
    folder = FOLDER.replace("0.001", "0.01")
    rows = E.queries()["op4_language_id"](spark, folder).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs):
    model = lang_id.learn(docs(["the house and the tree"] * 8 + [None]))
    assert model.languages == ["en"]
    found = [r["lang_pred"] for r in lang_id.identify(docs(["12 34 !", *ODD]), model).collect()]
    assert found[:4] == ["und"] * 4 and found[4] == "en"
    nothing = lang_id.learn(docs([]))
    assert [r["lang_pred"] for r in lang_id.identify(docs(["a"]), nothing).collect()] == ["und"]


def test_every_language_is_learned(spark):
    """Three hundred languages, each with words of its own and ids of one remainder; one has a single text."""
    rng = random.Random(3)
    words = {f"l{i:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for i in range(300)}
    rows = [(j * 300 + i, " ".join(rng.choices(w, k=30)), lang)
            for i, (lang, w) in enumerate(words.items()) for j in range(1 if i == 0 else 12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.learn(frame)
    assert model.languages == sorted(words)
    found = lang_id.identify(frame, model).join(frame, "doc_id").where("lang_pred = lang").count()
    assert found > 0.97 * len(rows)


def test_language_sample_is_bounded(spark):
    """Very many rows of one id, and repeated rows, do not make the sample larger."""
    one_id = spark.range(100_000).selectExpr(
        "CAST(NULL AS BIGINT) AS doc_id", "concat('text number ', id) AS text", "'en' AS lang")
    repeated = spark.range(20_000).selectExpr("1L AS doc_id", "'der text' AS text", "'de' AS lang")
    chosen, languages = lang_id.sample(one_id.unionByName(repeated))
    n = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    assert languages == ["de", "en"] and n["de"] == 1
    assert 0.7 * lang_id.MAX_TEXTS / 2 < n["en"] < 1.3 * lang_id.MAX_TEXTS / 2


def test_uncertain_languages_are_rejected():
    rng = np.random.default_rng(0)
    text = lambda letters, n: bytes(rng.choice(list(letters), n))
    texts = [text(b"abcde ", 80) for _ in range(60)] + [text(b"vwxyz ", 80) for _ in range(60)]
    x = np.array([lang_id.average(lang_id.clean(t)) for t in texts])
    model = lang_id.fit(x, np.repeat([0, 1], 60), ["a", "v"], np.arange(120) % 5 == 0)
    assert model.predict(text(b"abcde ", 60))[0] == "a" and model.predict(text(b"abcde ", 60))[2]
    assert model.predict(b"abcde vwxyz " * 5)[1] < model.predict(text(b"vwxyz ", 60))[1]


# quality

def test_quality_held_out(spark):
    folder = FOLDER.replace("0.001", "0.01")
    rows = {r["doc_id"]: r for r in E.queries()["op8_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    ranked = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ranked > 0.85
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


def test_quality_sample_is_bounded(spark, monkeypatch):
    """One labelled id on many rows: no more rows reach the driver than the bound allows."""
    monkeypatch.setattr(gam_quality, "MAX_ROWS", 200)
    seen = []
    monkeypatch.setattr(gam_quality, "fit", lambda x, y: seen.append(len(x)))
    docs = spark.range(4_000).selectExpr("1L AS doc_id", "concat(repeat('word ', CAST(id % 1000 AS INT)), id) AS text")
    gam_quality.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert 0 < seen[0] < 300
    gam_quality.learn(docs.selectExpr("doc_id", "'the same' AS text"), spark.createDataFrame([(1, 0)], "doc_id long, quality int"))
    assert seen[1] == 1


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam_quality.fit(x, y)
    test = rng.random((500, 3))
    assert ((model.score(test) > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))).mean() > 0.9
    assert {(i, j) for i, j, _ in model.pairs} >= {(0, 1)}
    assert np.allclose(gam_quality.fit(x[:0], y[:0]).score(x[:2]), 0.5)


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    frame = docs(ODD)
    rows = gam_quality.classify(frame, gam_quality.learn(frame, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = gam_quality.learn(frame.limit(0), labels.limit(0))
    assert gam_quality.classify(frame.limit(0), empty).count() == 0


# packing

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary_path())


def test_ids_are_the_tokenizers(spark, tokenizer):
    ids = packing.WordIds(packing.vocabulary_path())
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    texts += ["Don't we've 'S a<|endoftext|>b <|ENDOFTEXT|> ΣΑΣ é İx ²½  x　y x\x1cz ñ <|x 'there", "", " \n\na", "\x85 a ÿß÷×ªº"]
    texts += noise(6, 400, "aZß' é.1́中 <|>Ω")
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.ids(text.encode()), "<u4").tolist() == want, text


def valid_plan(histogram, capacity):
    used, seen = {}, {}
    for length, rank, n, each, first, offset in packing.plan(histogram, capacity):
        for i in range(n):
            for j in range(each):
                assert used.setdefault(first + i, 0) == offset + j * length
                used[first + i] += length
                seen.setdefault(length, []).append(rank + i * each + j)
    assert all(sorted(r) == list(range(histogram[k])) for k, r in seen.items()) and set(seen) == set(histogram)
    assert all(u <= capacity for u in used.values()) and sorted(used) == list(range(len(used)))
    return len(used)


def best_fit(lengths, capacity):
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= x]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - x)
        else:
            free.append(capacity - x)
    return len(free)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(rng.randrange(1, 300))]
        histogram = {k: lengths.count(k) for k in set(lengths)}
        assert valid_plan(histogram, 40) <= best_fit(lengths, 40)
    assert packing.plan({}) == []


def test_slots_of_one_length_are_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(packing, "RUN", 5_000)
    found = packing.slots(spark, packing.plan({1: 400_000, 7: 3}))
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 400_003 and max(tasks) < 400_000 / 2
    ranks = found.where("length = 1").select("rank").distinct()
    assert ranks.count() == 400_000 and ranks.agg(F.max("rank")).first()[0] == 399_999
    assert found.select("sequence_id", "offset").distinct().count() == 400_003


def test_packing_rows(docs, tokenizer):
    texts = [*ODD, *("w " * n for n in range(1, 60))]
    frame = docs(texts)
    rows = packing.pack(frame.union(frame)).collect()
    places, of = {}, {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        of.setdefault(r["doc_id"], []).append(r)
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        want = sorted((p, s, min(4096, len(ids) - s), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes()))
                      for p, s in enumerate(range(0, len(ids), 4096)) for _ in range(2))
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in of[i]) == want
    assert packing.pack(frame.limit(0)).count() == 0


def test_word_memory_is_bounded_and_right(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED", 7)
    ids = packing.WordIds(packing.vocabulary_path())
    texts = ["the cat sat on the mat", " ".join(f"word{i} the" for i in range(50)), "", "Größe naïve 日本 the"]
    for text in texts * 2:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids.ids(text.encode()), "<u4").tolist() == want
        for memory in (ids.words, ids.pieces):
            assert len(memory) <= 7 and len(memory.old) <= 7
