"""Readers of pairs and documents that say what they drop.

A pair's fate is `equal` (both sides alike, two empty ones included), `empty` (a side is null or blank), `lengths` or `unlike` (the quality rules), else
`kept`; the first that holds counts, after both sides are trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions.edits import ratio_udf
from glyphlake.operators.manifest import LOW, VERY_LOW
from glyphlake.sources import tables

FATES = ("kept", "equal", "empty", "lengths", "unlike")
#: Tables that a document of the first phase may have; without the first it does not count.
STAGE_TABLES = ("char_ops", "word_ops", "word_boundary_errors", "matched_pairs")


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def trimmed(c: str, space: str = r"(?U:\s)") -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{space}+|{space}+\z", "")


def judged(pairs: DataFrame, min_ratio: float = 0.5, max_delta: float = 0.5, space: str = r"(?U:\s)") -> DataFrame:
    """The rows with sides trimmed of `space` and their `fate`. A minimum ratio of 0 compares no letters."""
    rows = pairs.withColumn("noisy", trimmed("noisy", space)).withColumn("clean", trimmed("clean", space))
    delta = F.abs(F.length("noisy") - F.length("clean")) / F.greatest(F.length("clean"), F.lit(1))
    sound = F.when(F.col("noisy") == F.col("clean"), "equal").when((F.col("noisy") == "") | (F.col("clean") == ""), "empty").when(delta > max_delta, "lengths").otherwise("kept")
    rows = rows.withColumn("fate", sound)
    if min_ratio <= 0:
        return rows
    asked = F.when(F.col("fate") == "kept", F.col("noisy")), F.when(F.col("fate") == "kept", F.col("clean"))
    return rows.withColumn("fate", F.when(ratio_udf(*asked) < min_ratio, "unlike").otherwise(F.col("fate")))


def fates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each fate per key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("fate") == f).alias(f) for f in FATES])


def real_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(split, doc_id, noisy, clean) of <folder>/split=*/doc_id=*/matched_pairs.json. Raises where there is no file."""
    if not matches(spark, f"{folder}/split=*/doc_id=*/matched_pairs.json"):
        raise FileNotFoundError(f"{folder}: no matched_pairs.json")
    return tables.stage_tables(spark, folder, "matched_pairs", "noisy string, clean string, split string, doc_id string")


def synthetic_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, noisy, clean) of <doc>_pairs.jsonl files, all rows. Raises where there is no file."""
    if not matches(spark, f"{folder}/*_pairs.jsonl"):
        raise FileNotFoundError(f"{folder}: no *_pairs.jsonl")
    rows = spark.read.schema(tables.PAIR).json(f"{folder}/*_pairs.jsonl")
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*)_pairs\.jsonl$", 1).alias("doc_id"), "noisy", "clean")


def store(spark: SparkSession, rows: DataFrame, folder: str, name: str) -> dict[str, int]:
    """Writes the kept rows of judged ones to <folder>/<name>; counts of each fate are observed as they are written and go to the table of runs.

    The rows are written by the stage that counts them, so a task that runs twice is counted once.
    """
    seen = Observation(f"fates of {name}")
    counted = rows.observe(seen, *[F.count_if(F.col("fate") == f).alias(f) for f in FATES])
    counted.filter("fate = 'kept'").drop("fate").write.mode("overwrite").parquet(f"{folder}/{name}")
    found = {f: int(seen.get[f]) for f in FATES}
    tables.append_run(spark, f"{folder}/drops", {"name": name, **found})
    return found


def pair_report(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document of kept pairs: how like its pairs are without regard to case: mean, upper median, extremes, shares of low ones."""
    w = Window.partitionBy(key)
    rows = pairs.select(key, ratio_udf(F.lower("noisy"), F.lower("clean")).alias("r")).withColumn("at", F.row_number().over(w.orderBy("r"))).withColumn("n", F.count(F.lit(1)).over(w))
    middle = F.max(F.when(F.col("at") == F.floor(F.col("n") / 2) + 1, F.col("r")))
    share = lambda least: F.avg((F.col("r") < least).cast("double"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), middle.alias("median"), F.min("r").alias("low"), F.max("r").alias("high"), share(LOW).alias("low_share"), share(VERY_LOW).alias("very_low_share"))


def document_index(spark: SparkSession, folder: str, allowed: DataFrame | None = None, splits: list[str] | None = None) -> DataFrame:
    """(split, doc_id, one count per table of STAGE_TABLES): documents with edits of characters; other files may be missing (0). Raises where no document has any."""
    out = None
    for name in STAGE_TABLES:
        if matches(spark, f"{folder}/split=*/doc_id=*/{name}.json"):
            rows = tables.stage_tables(spark, folder, name, "split string, doc_id string", allowed)
            counts = rows.groupBy("split", "doc_id").agg(F.count(F.lit(1)).alias(name))
        elif out is None:
            raise FileNotFoundError(f"{folder}: no {name}.json")
        else:
            counts = out.select("split", "doc_id").limit(0).withColumn(name, F.lit(0).cast("long"))
        out = counts if out is None else out.join(counts, ["split", "doc_id"], "left").na.fill(0, [name])
    return out.filter(F.col("split").isin(splits)) if splits else out
