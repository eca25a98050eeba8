"""Collects the queries of every module in ``plans``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("badges", "details", "discovery", "evidence", "finding", "honours", "insights", "library", "listening", "outlook", "periods", "receipts", "recs", "resolution", "sessions", "texts", "threads", "words", "worklists")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out.update(import_module(f"playlore.plans.{name}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"playlore.plans.{name}").ORACLE)
    return out
