"""Deterministic texts planted from the given tables.

The raw texts hold no value for some rules, so a projection writes some: one SQL
expression per text, valid in Spark and in DuckDB alike, and next to it the matches
the text must give.  The expected side holds no pattern at all, it only repeats the
pieces that were planted.  Every recipe mixes in near misses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from inkveil.sources.tables import read_table


@dataclass(frozen=True)
class Recipe:
    table: str
    id: str
    text: str
    expected: str     # matches, joined by "|"
    n: str            # how many


def _by(key: str, *branches: str) -> str:
    """CASE over key % len(branches)."""
    arms = " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(branches))
    return f"(CASE {key} % {len(branches)} {arms} END)"


def _s(expr: str, width: int | None = None) -> str:
    text = f"CAST({expr} AS STRING)"
    return f"lpad({text}, {width}, '0')" if width else text


_PRICE = _s("CAST(floor(o_totalprice) AS BIGINT)")
_K = "o_orderkey"
_YEAR = _s("year(o_orderdate)")
_REF = f"{_YEAR} || '/' || {_s(_K, 6)}"
_NIN_HEAD = f"{_s(f'{_K} % 100', 2)} || '-'"
_NIN_TAIL = f"'-' || {_s(f'{_K} % 89', 2)}"
_NIN = f"{_NIN_HEAD} || {_s(f'{_K} % 1000000', 6)} || '-' || {_s(f'{_K} * 7 % 1000000', 6)} || {_NIN_TAIL}"
_NIN7 = f"{_NIN_HEAD} || {_s(f'{_K} % 1000000', 6)} || '-' || {_s(f'{_K} * 7 % 1000000', 7)} || {_NIN_TAIL}"
_HEX = "md5(c_name)"
_JWT = f"'eyJ' || {_HEX} || '-_.' || {_HEX} || '.' || md5(c_mktsegment)"
_H = [f"substr(md5(s_name), {4 * i + 1}, 4)" for i in range(8)]
_FULL_V6 = " || ':' || ".join(_H)

RECIPES: dict[str, Recipe] = {
    "currency": Recipe(
        "orders", _K,
        _by(_K,
            f"'Paid USD ' || {_PRICE} || ' today'",
            f"'Owed UGX' || {_PRICE} || '.5, then EUR  ' || {_s(_K)} || ',000.25.'",
            f"'Paid XUSD ' || {_PRICE} || ' today'",
            f"'Paid USDT ' || {_PRICE}",
            f"'Paid ' || {_PRICE} || ' KES'"),
        _by(_K,
            f"'USD ' || {_PRICE}",
            f"'UGX' || {_PRICE} || '.5|EUR  ' || {_s(_K)} || ',000.25'",
            "''", "''", "''"),
        _by(_K, "1", "2", "0", "0", "0"),
    ),
    "ref_code": Recipe(
        "orders", _K,
        _by(_K,
            f"'See MOF/BUD/' || {_REF} || ' now'",
            f"'Refs AB-x9-' || {_YEAR} || '-' || {_s(_K)} || '7, CD/y8/' || {_REF} || '.'",
            f"'See mof/bud/' || {_REF}",
            f"'See MOF/BUD/' || substr({_YEAR}, 3, 2) || '/' || {_s(_K, 6)}",
            f"'See XMOF/B/' || {_REF}"),
        _by(_K,
            f"'MOF/BUD/' || {_REF}",
            f"'AB-x9-' || {_YEAR} || '-' || {_s(_K)} || '7|CD/y8/' || {_REF}",
            "''", "''", "''"),
        _by(_K, "1", "2", "0", "0", "0"),
    ),
    "nin": Recipe(
        "orders", _K,
        _by(_K,
            f"'Id ' || {_NIN} || ' given'",
            f"'Id ' || {_NIN7} || '.'",
            f"'Id 9' || {_NIN}",
            f"'Id ' || {_NIN_HEAD} || '12345-' || {_s(f'{_K} % 1000000', 6)} || {_NIN_TAIL}",
            f"'Id ' || {_NIN} || '5'"),
        _by(_K, _NIN, _NIN7, "''", "''", "''"),
        _by(_K, "1", "1", "0", "0", "0"),
    ),
    "jwt": Recipe(
        "customer", "c_custkey",
        _by("c_custkey",
            f"'Bearer ' || {_JWT} || ' sent'",
            f"'(' || {_JWT} || ') and ' || {_JWT} || '.'",
            f"'Bearer x' || {_JWT}",
            f"'Bearer eyJ' || {_HEX} || '.' || {_HEX}"),
        _by("c_custkey", _JWT, f"{_JWT} || '|' || {_JWT}", "''", "''"),
        _by("c_custkey", "1", "2", "0", "0"),
    ),
    "api_key": Recipe(
        "customer", "c_custkey",
        _by("c_custkey",
            f"'Key sk-' || {_HEX} || ' used'",
            f"'Keys AKIA' || upper({_HEX}) || ', ghp_' || {_HEX} || '.'",
            f"'Key sk-' || substr({_HEX}, 1, 7)",
            f"'Key ask-' || {_HEX}",
            f"'Key pk-' || {_HEX} || '- end'"),
        _by("c_custkey",
            f"'sk-' || {_HEX}",
            f"'AKIA' || upper({_HEX}) || '|ghp_' || {_HEX}",
            "''", "''",
            f"'pk-' || {_HEX}"),
        _by("c_custkey", "1", "2", "0", "0", "1"),
    ),
    "ipv6": Recipe(
        "supplier", "s_suppkey",
        _by("s_suppkey",
            f"'Host ' || {_FULL_V6} || ' up'",
            f"'Host 2001:db8::' || {_H[0]} || ':' || {_H[1]} || ' up'",
            f"'Host fe80::' || {_H[0]} || '%eth0 up'",
            f"'Host ::' || {_H[0]} || ' and 2001:db8:: up'",
            f"'Call std::' || s_name || ' at 12:30'",
            f"'Host [' || {_H[0]} || '::1] up'"),
        _by("s_suppkey",
            _FULL_V6,
            f"'2001:db8::' || {_H[0]} || ':' || {_H[1]}",
            f"'fe80::' || {_H[0]} || '%eth0'",
            f"'::' || {_H[0]} || '|2001:db8::'",
            "''",
            f"{_H[0]} || '::1'"),
        _by("s_suppkey", "1", "1", "1", "2", "0", "1"),
    ),
    "confidential": Recipe(
        "part", "p_partkey",
        _by("p_partkey",
            "'The ' || p_name || ' plan is Confidential. It ships soon.'",
            "'It ships soon. The ' || p_name || ' has a TRADE SECRET! Done. My password?'",
            "'The ' || p_name || ' is confidential'",
            "'The ' || p_name || ' was deconfidentialised. Opinions vary.'"),
        _by("p_partkey",
            "'The ' || p_name || ' plan is Confidential.'",
            "' The ' || p_name || ' has a TRADE SECRET!| My password?'",
            "''", "''"),
        _by("p_partkey", "1", "2", "0", "0"),
    ),
}

# A token of 16 hex digits stays below the entropy limit, one that mixes both cases
# and other letters is above it.  The expected side is computed from frequencies.
TOKEN_TABLE, TOKEN_ID = "customer", "c_custkey"
TOKEN_TEXT = _by(
    "c_custkey",
    f"'Token ' || {_HEX} || ' end'",
    f"'Token ' || {_HEX} || upper(md5(c_mktsegment)) || 'ghijKLMNopqr#!' || ' end'",
    f"'Token ' || upper({_HEX}) || '/xyzXYZ~qwQWvV' || ' end'",
)

# Card-like numbers of 13 to 20 digits, some with separators.
CARD_TABLE, CARD_ID = "orders", _K
CARD_NUMBER = (
    f"lpad({_s(f'{_K} * 7919 + o_custkey')}, CAST(13 + {_K} % 8 AS INT), '4')"
)
CARD_TEXT = f"substr({CARD_NUMBER}, 1, 4) || {_by(_K, chr(39) * 2, chr(39) + ' ' + chr(39), chr(39) + '-' + chr(39))} || substr({CARD_NUMBER}, 5)"


def planted(spark: SparkSession, folder: str, rule: str) -> DataFrame:
    """``(id, text)`` of one rule."""
    r = RECIPES[rule]
    return read_table(spark, folder, r.table).selectExpr(f"{r.id} AS id", f"{r.text} AS text")


def planted_sql(rule: str) -> str:
    """The matches that the planted texts must give, straight from the tables."""
    r = RECIPES[rule]
    return (
        f"SELECT {r.id} AS id, CAST({r.n} AS BIGINT) AS n, {r.expected} AS matches "
        f"FROM {r.table}"
    )
