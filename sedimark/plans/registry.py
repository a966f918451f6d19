"""Collects the registered queries of all sections."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SECTIONS: tuple[str, ...] = ("scalars", "indexing", "matching", "reporting", "drivers", "streams")


def _all(what: str) -> dict:
    out: dict = {}
    for name in SECTIONS:
        found = getattr(importlib.import_module(f"sedimark.plans.{name}"), what)
        if clash := out.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= found
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("sedimark.plans.matching").flagship(spark, sf_dir)
