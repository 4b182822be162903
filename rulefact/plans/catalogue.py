"""All registered queries of the reasoning library with their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from rulefact.plans import registry

MODULES = ["queries_scalar", "queries_rules", "queries_tables", "queries_beliefs", "queries_sources", "queries_more", "queries_proofs", "queries_streams"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"rulefact.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return registry.QUERIES["i9_verdicts"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
