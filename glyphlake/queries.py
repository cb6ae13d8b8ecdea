"""Queries over the text-quality operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from glyphlake.plans import channel_queries, error_queries, registry, report_queries, stage_queries, text_queries

MODULES = (text_queries, error_queries, report_queries, channel_queries, stage_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Python workers that share the driver's files find the package here; on a cluster it is installed or sent with --py-files.
            spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
            return f(spark, sf_dir)

        return run

    return {k: ready(f) for k, f in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
