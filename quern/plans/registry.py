"""Every registered query of the reference's own operators, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import (
    calibration_queries, catalog_queries, detail_queries, evaluation_queries, ledger_queries, retrieval_queries, storage_queries, text_queries,
    tuning_queries, workbench_queries,
)

GROUPS = (retrieval_queries, calibration_queries, text_queries, ledger_queries, workbench_queries, evaluation_queries, catalog_queries, tuning_queries, detail_queries, storage_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
