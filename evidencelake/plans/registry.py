"""Registered queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}
_MODULES = ("scalar", "ledger", "pages", "search", "reports", "streams", "tables")


class Tables:
    """The tables of one folder, read as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Adapter text that Spark and DuckDB both read; {table} names a table."""
        wanted = {n: getattr(self, n) for n in ("pages", "documents", "labels", "events", "orders", "conversations", "benchmark") if "{" + n + "}" in text}
        return self.spark.sql(text, **wanted, **frames)


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of Tables under its own name, with SQL of the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        text = sql
        for n in ("pages", "documents", "labels", "events", "orders", "conversations", "benchmark"):
            text = text.replace("{" + n + "}", n) if text else text
        _QUERIES[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), text)
        return f

    return add


def _loaded() -> dict[str, tuple[Query, str | None]]:
    for m in _MODULES:
        importlib.import_module(f"evidencelake.plans.{m}")
    return _QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded()["gate_report"][0](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _loaded().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _loaded().items() if s}
