"""Models in a folder: count tables as Parquet, settings as one line of JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from glyphlake.sources import tables


def save_model(spark: SparkSession, folder: str, found: dict[str, DataFrame], settings: dict) -> None:
    """Tables under their names; the settings come last, so that a folder with settings is complete."""
    for name, rows in found.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    line = json.dumps({**settings, "tables": sorted(found)}, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/settings")


def load_model(spark: SparkSession, folder: str, known: dict) -> tuple[dict[str, DataFrame], dict]:
    """(tables, settings): `known` has the settings' defaults; what it does not name is dropped. Raises where the folder is not complete."""
    saved = tables.document(spark, f"{folder}/settings")
    if not isinstance(saved, dict):
        raise FileNotFoundError(f"{folder}: no settings")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in saved["tables"]}, {k: saved.get(k, v) for k, v in known.items()}


def first_document(spark: SparkSession, paths: list[str], default=None):
    """The first of the small JSON documents that is there; the default if none is, or if it is broken."""
    return next((tables.document(spark, p, default) for p in paths if tables.exists(spark, p)), default)
