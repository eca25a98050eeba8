"""How a query is declared: its tables, its function of DataFrames, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playlore.sources import adapters

Queries = dict[str, Callable[[SparkSession, str], DataFrame]]


class Catalogue:
    """Collects the queries of a module."""

    def __init__(self) -> None:
        self.queries: Queries = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, *tables: str, sql: str | None = None):
        """Registers a function of the named tables. sql: a SELECT, or common table expressions and a SELECT; the tables are given."""

        def register(f):
            self.queries[name] = lambda spark, sf_dir: f(*[adapters.TABLES[t](spark, sf_dir) for t in tables])
            if sql is not None:
                given = ", ".join(f"{t} AS ({adapters.SQL[t]})" for t in tables if t in adapters.SQL)
                body = sql.strip()
                alone = body[:6].upper() == "SELECT"
                self.oracle[name] = f"WITH RECURSIVE {given}{' ' if alone else ', ' if given else ''}{body}" if given or not alone else body
            return f

        return register
