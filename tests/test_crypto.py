"""Encryption: round trip, unchanged rows, wrong password, secrecy of the key."""

import base64

import pytest
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.functions import crypto
from inkveil.operators import encryption as EN

ROWS = ["plain text", "", "   ", None, " ", "éü 😀 \n two lines", "x" * 5000,
        "⧙ENC:already", "before ⧙ENC:abc:ENC⧘ after", "⧙ENC:abc:ENC⧘"]


@pytest.fixture(scope="module")
def key(spark):
    return crypto.key_frame(spark, "pässword", bytes(range(16)), "run")[0]


@pytest.fixture(scope="module")
def encrypted(texts, key):
    df = texts(ROWS).withColumn("plain", F.col("text"))
    return EN.encrypt_columns(df, ["text"], key)


def test_round_trip(encrypted, key):
    rows = EN.decrypt_columns(encrypted, ["text"], key).collect()
    assert all(r.text == r.plain for r in rows)


def test_blank_and_marked_rows_stay(encrypted):
    rows = {r.id: r for r in encrypted.collect()}
    for i in (1, 2, 3, 4, 7, 9):
        assert rows[i].text == rows[i].plain
    for i in (0, 5, 6, 8):
        assert rows[i].text.startswith(C.ENC_PREFIX) and rows[i].text.endswith(C.ENC_SUFFIX)
        assert "\n" not in rows[i].text and rows[i].plain not in rows[i].text


def test_encrypting_twice_changes_nothing(encrypted, key):
    stored = encrypted.sparkSession.createDataFrame(encrypted.collect(), encrypted.schema)
    again = EN.encrypt_columns(stored, ["text"], key)
    assert sorted(map(str, again.collect())) == sorted(map(str, stored.collect()))


def test_wrong_password_leaves_tokens(spark, encrypted):
    wrong = crypto.key_frame(spark, "other", bytes(range(16)))[0]
    stored = spark.createDataFrame(encrypted.collect(), encrypted.schema)
    out = EN.decrypt_columns(stored, ["text"], wrong)
    assert sorted(map(str, out.collect())) == sorted(map(str, stored.collect()))


def test_equal_texts_get_different_tokens(texts, key):
    out = EN.encrypt_columns(texts(["same", "same"]), ["text"], key).collect()
    assert out[0].text != out[1].text


def test_key_derivation_is_the_standard_one():
    a = crypto.derive_key("pw", b"0" * 16)
    assert a == crypto.derive_key("pw", b"0" * 16) and len(a) == 32
    assert a != crypto.derive_key("pw", b"1" * 16)
    assert len(crypto.new_salt()) == 16 and crypto.new_salt() != crypto.new_salt()


def test_key_is_in_no_plan(encrypted):
    raw = crypto.derive_key("pässword", bytes(range(16)))
    plan = encrypted._jdf.queryExecution().toString()
    for form in (raw.hex(), raw.hex().upper(), base64.b64encode(raw).decode()):
        assert form not in plan
    assert str(list(raw))[1:40] not in plan
    assert "Join" not in plan


def test_marker_per_document(spark):
    df = spark.createDataFrame([(1, "a"), (1, "⧙ENC:x"), (2, "b"), (3, None)], "d int, text string")
    assert {r.d: r.encrypted for r in EN.encrypted_documents(df, "d").collect()} == {
        1: True, 2: False, 3: False}


def test_one_key_per_document(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "d")], "d int, text string")
    salts = spark.createDataFrame([(1, bytearray(b"1" * 16)), (2, bytearray(b"2" * 16))], "d int, salt binary")
    with pytest.warns(UserWarning, match="per document"):
        keys = EN.document_keys(salts, "d", "pw")
    enc = EN.encrypt_by_document(df, "d", ["text"], keys)
    assert enc.filter(crypto.is_encrypted(F.col("text"))).count() == 3
    dec = EN.decrypt_by_document(enc, "d", ["text"], keys)
    assert sorted(dec.collect()) == sorted(df.collect())


def test_status(spark):
    df = spark.createDataFrame([("docx",), ("xlsx",), ("pdf",), ("image",), (None,)], "k string")
    got = [r[0] for r in df.select(EN.encrypt_status(F.col("k"))).collect()]
    assert got == ["encrypted"] * 2 + ["skipped_unsupported"] * 3
