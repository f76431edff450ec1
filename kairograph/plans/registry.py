"""The registered queries by name, and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapter import Tables
from .oracle import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan over the domain tables under ``name``, with the DuckDB SQL of the same result."""

    def wrap(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return plan

    return wrap


for _module in ("relational", "scalars", "graph", "atlas", "ingest", "validation", "profiles", "client", "readmodel", "merges"):
    if importlib.util.find_spec(f"{__package__}.{_module}"):
        importlib.import_module(f"{__package__}.{_module}")
