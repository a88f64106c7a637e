"""The registered queries, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwell.plans.catalogue import VIEWS, Catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None, views: bool = True):
    """Register a query of a catalogue; ``sql`` follows the views' definitions unless ``views`` is false."""

    def add(f: Callable[[Catalogue], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        if sql:
            SQL[f.__name__] = (VIEWS if views else "") + sql
        return f

    return add
