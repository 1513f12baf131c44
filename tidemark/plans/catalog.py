"""The registered queries and their independent checks."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SECTIONS = "words retrieval ingest corpus health listings signals mining evaluation answers healing streams".split()


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name``, with its check if it has one."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def oracle(name: str) -> str:
    """The check of a query registered before, for another way to the same rows."""
    return ORACLES[name]


def load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"{__package__}.queries_{section}")
