"""Queries of the training-data operators: opN_<name> over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contracts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(contracts.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(contracts.ORACLE)
