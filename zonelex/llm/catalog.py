"""Every query of this subpackage and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import distinctive, frequency, leakage, markup, packing, reading, residue, subjects

MODULES = (residue, subjects, distinctive, frequency, markup, packing, leakage, reading)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
