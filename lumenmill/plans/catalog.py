"""All queries of the library and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenmill.plans import drawings, oracle, queries as q, records


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout, stencil, aggregate, policy and report in one: the quality summary of all rasters."""
    return q.raster_quality_summary(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*q.ALL, *drawings.ALL, *records.ALL)}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | drawings.SQL | records.SQL
