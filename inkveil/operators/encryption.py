"""Encryption of text columns and of documents."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil import constants as C
from inkveil.functions import crypto


def encrypt_columns(df: DataFrame, columns: Iterable[str], key: DataFrame) -> DataFrame:
    """Encrypt text columns in place; ``key`` is the one-row frame of ``key_frame``."""
    return df.withColumns({c: crypto.encrypt_text(F.col(c), crypto.key_of(key)) for c in columns})


def decrypt_columns(df: DataFrame, columns: Iterable[str], key: DataFrame) -> DataFrame:
    return df.withColumns({c: crypto.decrypt_text(F.col(c), crypto.key_of(key)) for c in columns})


def document_keys(salts: DataFrame, doc_id: str, password: str) -> DataFrame:
    """One key per document from ``(doc_id, salt)``.

    Costs the full key derivation for every document; one salt per run is the default.
    """
    warnings.warn("one key derivation per document; prefer one salt per run", stacklevel=2)
    id_type = dict(salts.dtypes)[doc_id]

    def derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                doc_id: batch[doc_id],
                "key": [crypto.derive_key(password, bytes(s)) for s in batch["salt"]],
            })

    return salts.select(doc_id, "salt").mapInPandas(derive, f"`{doc_id}` {id_type}, key binary")


def encrypt_by_document(
    df: DataFrame, doc_id: str, columns: Iterable[str], keys: DataFrame,
) -> DataFrame:
    """Encrypt with each document's own key (equi-join on the document)."""
    order = df.columns
    joined = df.join(keys.withColumnRenamed("key", "_key"), doc_id, "left")
    return joined.withColumns(
        {c: crypto.encrypt_text(F.col(c), F.col("_key")) for c in columns}).select(*order)


def decrypt_by_document(
    df: DataFrame, doc_id: str, columns: Iterable[str], keys: DataFrame,
) -> DataFrame:
    order = df.columns
    joined = df.join(keys.withColumnRenamed("key", "_key"), doc_id, "left")
    return joined.withColumns(
        {c: crypto.decrypt_text(F.col(c), F.col("_key")) for c in columns}).select(*order)


def encrypt_status(kind: Column) -> Column:
    """Only some kinds can be encrypted; the others say so."""
    return F.when(kind.isin(*C.ENCRYPTABLE_KINDS), "encrypted").otherwise("skipped_unsupported")


def encrypted_documents(units: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """Per document: does any unit carry the marker?"""
    return units.groupBy(doc_id).agg(
        F.bool_or(crypto.is_encrypted(F.col(text))).alias("encrypted"))
