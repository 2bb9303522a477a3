"""Queries of this subpackage over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import contamination, html, licenses, minhash, mixing, quality, secrets, sharding, tokens, urls
from terrace.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Shards of the sharding query.
SHARDS = 24


def queries() -> dict[str, Query]:
    """One query per operator, over the whole of its tables."""
    return {
        "op1_mixing": lambda s, d: mixing.production(table(s, d, "documents")),
        "op2_minhash": lambda s, d: minhash.near_duplicates(table(s, d, "documents"), width=2),
        "op3_html": lambda s, d: html.extracted(table(s, d, "pages")),
        "op4_quality": lambda s, d: quality.judged(table(s, d, "documents")),
        "op5_urls": lambda s, d: urls.judged_urls(table(s, d, "pages"), table(s, d, "labels")),
        "op6_secrets": lambda s, d: secrets.production(table(s, d, "documents"), table(s, d, "labels")),
        "op7_tokens": lambda s, d: tokens.production(table(s, d, "documents")),
        "op8_shards": lambda s, d: sharding.byte_shards(table(s, d, "documents"), SHARDS),
        "op9_contamination": lambda s, d: contamination.contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_licenses": lambda s, d: licenses.licenses(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op1_mixing": mixing.oracle(),
        "op2_minhash": minhash.oracle(2),
        "op4_quality": quality.oracle(),
        "op5_urls": urls.oracle(),
        "op6_secrets": secrets.oracle(),
        "op8_shards": sharding.oracle(SHARDS),
        "op9_contamination": contamination.oracle(),
        "op10_licenses": licenses.oracle(),
    }
