"""Queries by name, each with its SQL form where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register ``f(spark, sf_dir)``; ``views`` are common table expressions that ``sql`` reads."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = ("WITH RECURSIVE " + ",".join(views) + "\n" if views else "") + sql
        return f

    return put
