"""Queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and oracles of a module by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query with its SQL (none: it is compared in tests only)."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def exon_text(exons: Column | None = None) -> Column:
    """Exons as text, so that results compare as plain values."""
    e = F.col("exons") if exons is None else exons
    return F.array_join(F.transform(e, lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("exons")
