"""Catalogue of the engine's queries over the test tables and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, landing, life, search, traffic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = search.QUERIES | traffic.QUERIES | life.QUERIES | corpus.QUERIES | landing.QUERIES
ORACLES: dict[str, str] = search.ORACLES | traffic.ORACLES | life.ORACLES | corpus.ORACLES | landing.ORACLES
