"""Text encryption: authenticated AES in JVM, key from a password.

A key must not be a literal: literals show in plans, event logs and the UI.  It is kept
in a one-row DataFrame and read by a scalar subquery, whose value no plan prints.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil import constants as C


def new_salt() -> bytes:
    return os.urandom(C.SALT_BYTES)


def derive_key(password: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac(
        "sha256", password.encode(), salt, C.KDF_ITERATIONS, dklen=C.KEY_BYTES)


def key_frame(
    spark: SparkSession, password: str, salt: bytes | None = None, run_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(key, manifest): one derivation per run, on the driver.

    ``key``      one row, ``(run_id, key)``; never store it
    ``manifest`` one row, ``(run_id, salt)``; store it with the output
    """
    salt = salt or new_salt()
    run_id = run_id or uuid.uuid4().hex
    key = spark.createDataFrame([(run_id, bytearray(derive_key(password, salt)))],
                                "run_id string, key binary")
    manifest = spark.createDataFrame([(run_id, bytearray(salt))], "run_id string, salt binary")
    return key, manifest


def key_of(key: DataFrame) -> Column:
    return key.select("key").scalar()


def is_encrypted(text: Column) -> Column:
    return F.coalesce(text.startswith(C.ENC_PREFIX), F.lit(False))


def _blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(rf"(?=\S)[^{C.SPACE_CHARS}]")


def encrypt_text(text: Column, key: Column) -> Column:
    """Blank or already encrypted text stays as it is."""
    token = F.translate(F.base64(F.aes_encrypt(text, key, F.lit("GCM"))), "\r\n", "")
    return F.when(_blank(text) | is_encrypted(text), text).otherwise(
        F.concat(F.lit(C.ENC_PREFIX), token, F.lit(C.ENC_SUFFIX)))


def decrypt_text(text: Column, key: Column) -> Column:
    """A whole token that opens with the key; anything else stays as it is."""
    token = F.regexp_extract(
        text, rf"\A{C.ENC_PREFIX}([A-Za-z0-9+/=]+){C.ENC_SUFFIX}\z", 1)
    plain = F.try_aes_decrypt(F.unbase64(token), key, F.lit("GCM")).cast("string")
    return F.when(is_encrypted(text) & (token != ""), F.coalesce(plain, text)).otherwise(text)
