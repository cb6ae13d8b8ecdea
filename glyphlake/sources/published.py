"""Tables per book that are published as a whole.

A commit writes the rows of new and changed books under a run of its own, table by table, and last a row per book into the run's provenance.
Spark marks a folder with _SUCCESS when a job ends; a run counts once its provenance and all its tables have that mark, so a reader never sees
half a commit, and a lost one leaves rows that nobody reads. Of each book the latest run is read. One writer at a time.
Null keys are no books. A key whose digest is null has been taken away.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.sources.tables import exists, written

PROVENANCE, SCHEMAS = "provenance", "schemas"


def _runs(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Runs that are whole, oldest first; there is one for each commit."""
    if not exists(spark, f"{folder}/{PROVENANCE}"):
        return []
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{PROVENANCE}")
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    runs = sorted(name.removeprefix("run=") for name in (s.getPath().getName() for s in found) if name.startswith("run="))
    return [r for r in runs if all(exists(spark, f"{folder}/{t}/run={r}/_SUCCESS") for t in (PROVENANCE, SCHEMAS, *names))]


def _of(spark: SparkSession, folder: str, name: str, runs: list[str]) -> DataFrame:
    """The rows of these runs with `run`, under the schema that the last of them gives; a partitioned table without rows has no file to tell it."""
    told = spark.read.parquet(f"{folder}/{SCHEMAS}/run={runs[-1]}").filter(F.col("name") == name).first()["schema"]  # a row for each table
    schema = T.StructType.fromJson(json.loads(told)).add("run", "string")
    return spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(*[f"{folder}/{name}/run={r}" for r in runs])


def latest(spark: SparkSession, folder: str, names: list[str], key: str = "book") -> DataFrame | None:
    """(key, digest, run) of the books that are published; None before the first commit."""
    runs = _runs(spark, folder, names)
    if not runs:
        return None
    rows = _of(spark, folder, PROVENANCE, runs).groupBy(key).agg(F.max_by(F.struct("digest", "run"), "run").alias("x"))
    return rows.select(key, "x.*").filter("digest is not null")


def pending(content: DataFrame, known: DataFrame | None, key: str = "book") -> DataFrame:
    """(key, digest) of the books of `content` that are new or changed, and of those it lacks, with a null digest."""
    own = content.select(key, "digest").filter(F.col(key).isNotNull())
    if known is None:
        return own
    both = own.join(known.select(key, F.col("digest").alias("_was")), key, "full")
    return both.filter(~F.col("digest").eqNullSafe(F.col("_was"))).select(key, "digest")


def commit(spark: SparkSession, folder: str, found: dict[str, DataFrame], content: DataFrame, key: str = "book", by: tuple[str, ...] = ()) -> str:
    """Publishes tables that all have the key, partitioned by columns they have; returns the run."""
    before = _runs(spark, folder, [])
    run = f"r{int(before[-1][1:9]) + 1 if before else 0:08d}-{uuid.uuid4().hex[:8]}"
    for name, rows in found.items():
        rows.write.partitionBy(*[c for c in by if c in rows.columns]).parquet(f"{folder}/{name}/run={run}")
    last = content.select(key, "digest")
    told = [(name, rows.schema.json()) for name, rows in [*found.items(), (PROVENANCE, last)]]
    spark.createDataFrame(told, "name string, schema string").write.parquet(f"{folder}/{SCHEMAS}/run={run}")
    last.write.parquet(f"{folder}/{PROVENANCE}/run={run}")
    return run


def read(spark: SparkSession, folder: str, name: str, names: list[str], key: str = "book") -> DataFrame:
    """The published rows of one of the tables `names`: those of each book's latest run. Runs that no book is read from are not scanned."""
    known = latest(spark, folder, names, key)
    if known is None:
        raise FileNotFoundError(f"{folder}: nothing is published")
    known = written(known)  # a row for each book
    runs = sorted(r["run"] for r in known.select("run").distinct().collect())  # at most one for each commit
    rows = _of(spark, folder, name, runs or _runs(spark, folder, names)[-1:])
    return rows.join(known.select(key, "run"), [key, "run"], "left_semi").drop("run")


def digest(known: DataFrame, key: str = "book") -> str:
    """One digest of what is published, which does not depend on order or on the runs."""
    row = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(key, "digest").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("x")).first()
    return f"{row['n']}:{row['x']}"
