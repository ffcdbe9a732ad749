"""All queries and all DuckDB statements by name."""

from __future__ import annotations

from workload import (
    batch_oracles,
    batch_queries,
    metadata_oracles,
    metadata_queries,
    text_oracles,
    text_queries,
)


def queries():
    return {**text_queries.QUERIES, **metadata_queries.QUERIES, **batch_queries.QUERIES}


def oracles():
    return {**text_oracles.ORACLES, **metadata_oracles.ORACLES, **batch_oracles.ORACLES}
