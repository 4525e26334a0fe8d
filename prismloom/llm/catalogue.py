"""Queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismloom.llm import bpe, codebooks, decontamination, embednear, htmlmain, langid, linededup, maxent, ngramjoin, pii, sharding, warc, whitening

_MODULES = (decontamination, bpe, htmlmain, linededup, sharding, warc, pii, ngramjoin, langid, embednear, codebooks, whitening, maxent)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
