"""All queries of the core package by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans import catalog, preparation, surface


def queries() -> dict:
    return preparation.QUERIES | catalog.QUERIES | surface.QUERIES


def oracle_sql() -> dict[str, str]:
    return preparation.SQL | catalog.SQL | surface.SQL


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.QUERIES["flagship"](spark, folder)
