"""Sources and sinks of the pipelines. Schemas are given, never inferred."""

from __future__ import annotations

import json
import tempfile
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = "op string, noisy string, clean string"
PAIR = "noisy string, clean string"
MANIFEST = "doc_id string, split string, subset_domain string, sample_id string, order_key int, token_or_sentence_level string, noisy string, clean string, source_type string"
PREDICTION = "doc_id string, split string, subset_domain string, sample_id string, input_noisy string, prediction string, changed_flag boolean"

#: Names that a corrected text may have beside a raw one, by priority; %s is the book (fixed values).
CORRECTED = ("%s_corrected.txt", "%s поправено_corrected.txt", "%s_поправено_corrected.txt", "%s_поправено.txt", "%s поправено.txt")
#: Characters of a run by which names are looked up.
RUN = 3
RAW = r"^(.*)_ocr_raw\.txt(?:\.txt)?$"


def written(df: DataFrame) -> DataFrame:
    """The rows written to the folder that the cluster names in spark.checkpoint.dir; one of this machine only where Spark is local and none is named."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(name, path, text), one row per whole file."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows


def book_pairs(spark: SparkSession, raw_folder: str, corrected_folder: str) -> DataFrame:
    """(book, noisy, clean): raw texts with the corrected text of the best matching name; books without one do not come (see `unmatched`)."""
    raw = texts(spark, raw_folder).withColumn("book", F.regexp_extract("name", RAW, 1)).filter("book <> ''").groupBy("book").agg(F.min_by("text", "name").alias("text"))
    fixed = texts(spark, corrected_folder).select(F.col("name").alias("file"), F.col("text").alias("clean"))
    best = resolved_names(raw.select("book"), fixed.select("file"), "book").select("book", "file").join(fixed, "file")
    return raw.select("book", F.col("text").alias("noisy")).join(best.select("book", "clean"), "book")


def book_versions(spark: SparkSession, raw_folder: str, corrected_folder: str) -> DataFrame:
    """(book, version) of the books of `book_pairs`: names, sizes and times of both files. No text is read."""

    def files(folder: str) -> DataFrame:
        rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
        return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.concat_ws(":", "length", F.unix_micros("modificationTime")).alias("state"))

    raw = files(raw_folder).select(F.regexp_extract("name", RAW, 1).alias("book"), F.struct("name", "state").alias("own")).filter("book <> ''").groupBy("book").agg(F.min("own").alias("own"))
    fixed = files(corrected_folder).select(F.col("name").alias("file"), "state")
    best = resolved_names(raw.select("book"), fixed.select("file"), "book").select("book", "file").join(fixed, "file")
    return raw.join(best, "book").select("book", F.concat_ws("|", "own.name", "own.state", "file", "state").alias("version"))


def _runs(name: Column) -> Column:
    """The distinct runs of up to RUN characters of a name."""

    def of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - k + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(k)))

    return F.array_distinct(F.flatten(F.array(*map(of, range(1, RUN + 1)))))


def resolved_names(names: DataFrame, files: DataFrame, name: str = "name", file: str = "file") -> DataFrame:
    """Per distinct name that has one: the name, its file, rank and how many files match at that rank (more than one: it is ambiguous).

    First the names of CORRECTED in their order, then, ranked behind them, any file whose stem holds the name without regard to case and either ends in
    "corrected" or has "поправено" in it. Of several the smallest file name is taken. Names meet files by the run of characters of theirs that the
    fewest files have, so no file is compared with all names. Null and empty names and files match nothing.
    """
    bases = names.select(F.col(name).alias("name")).filter("name <> ''").distinct()
    listed = files.select(F.col(file).alias("file")).filter("file <> ''").distinct()
    exact = bases.select("name", F.posexplode(F.array(*[F.format_string(c.replace("%s", "%1$s"), "name") for c in CORRECTED])).alias("rank", "file")).join(listed, "file").select("name", "rank", "file")
    stem = F.lower(F.regexp_replace("file", r"\.[^.]*$", ""))
    loose = listed.withColumn("stem", stem).filter(F.col("stem").endswith("corrected") | F.lower("file").contains("поправено"))
    index = written(loose.select("file", "stem", F.explode(_runs(F.col("stem"))).alias("run")))
    common = index.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    low = bases.withColumn("low", F.lower("name"))
    asked = low.select("name", "low", F.explode(F.filter(_runs(F.col("low")), lambda x: F.length(x) == F.least(F.lit(RUN), F.length("low")))).alias("run")).join(common, "run", "left")
    rarest = asked.groupBy("name", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("x")).filter("x.n > 0").select("name", "low", "x.run")
    held = rarest.join(index, "run").filter(F.expr("contains(stem, low)")).select("name", F.lit(len(CORRECTED)).alias("rank"), "file")
    found = exact.unionByName(held).groupBy("name", "rank").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("matches"))
    return found.groupBy("name").agg(F.min(F.struct("rank", "file", "matches")).alias("x")).select(F.col("name").alias(name), F.col("x.file").alias(file), "x.rank", "x.matches")


def unmatched(spark: SparkSession, raw_folder: str, corrected_folder: str) -> DataFrame:
    raw = texts(spark, raw_folder).select(F.regexp_extract("name", RAW, 1).alias("book")).filter("book <> ''").distinct()
    return raw.join(book_pairs(spark, raw_folder, corrected_folder).select("book"), "book", "left_anti")


def stage_tables(spark: SparkSession, folder: str, name: str, schema: str, allowed: DataFrame | None = None) -> DataFrame:
    """Rows of <folder>/split=*/doc_id=*/<name>.json, arrays of records; only of allowed documents if given."""
    rows = spark.read.schema(schema).option("multiLine", True).option("basePath", folder).json(f"{folder}/split=*/doc_id=*/{name}.json")
    return rows.join(allowed, "doc_id", "left_semi") if allowed is not None else rows


def synthetic_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, noisy, clean) of <doc>_pairs.jsonl files; empty and equal pairs do not come."""
    rows = spark.read.schema(PAIR).json(folder, pathGlobFilter="*_pairs.jsonl")
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(.*)_pairs\.jsonl$", 1).alias("doc_id"), "noisy", "clean").filter("noisy <> '' and clean <> '' and noisy <> clean")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank lines do not come, a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path) if exists(spark, path) else spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def document(spark: SparkSession, path: str, default=None):
    """A small JSON document by any path Spark can read; the default if it is missing or broken."""
    if not exists(spark, path):
        return default
    try:
        return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError:
        return default


def wide_confusions(spark: SparkSession, path: str) -> DataFrame:
    """(clean, noisy, n) from a wide CSV with a row per clean and a column per noisy character."""
    wide = spark.read.option("header", True).option("quote", '"').csv(path)
    first, *rest = wide.columns
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("noisy"), F.col(f"`{c}`").cast("double").alias("n")) for c in rest]))
    return wide.select(F.col(f"`{first}`").alias("clean"), parts.alias("x")).select("clean", "x.noisy", "x.n").filter("n > 0")


# Sinks


def write_partitioned(df: DataFrame, folder: str, *keys: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*keys).format(fmt).save(folder)


def write_verified(df: DataFrame, folder: str, fmt: str = "json") -> int:
    """Writes, counts what was written, and raises if it differs; a directory appears as a whole."""
    n = df.count()
    df.write.mode("overwrite").format(fmt).save(folder)
    got = df.sparkSession.read.schema(df.schema).format(fmt).load(folder).count()
    if got != n:
        raise OSError(f"{folder}: {got} of {n} rows")
    return n


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """A report table as one CSV; report tables have a row per model, regime and group."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(str(PurePosixPath(folder) / name))


def append_run(spark: SparkSession, folder: str, row: dict) -> None:
    """One row of the table of runs: model, regime, seed, status, hash."""
    spark.createDataFrame([row]).write.mode("append").parquet(folder)


def finished(spark: SparkSession, folder: str, content_hash: str) -> bool:
    """Whether a run with this content is complete in the table of runs."""
    return exists(spark, folder) and spark.read.parquet(folder).filter((F.col("hash") == content_hash) & (F.col("status") == "complete")).limit(1).count() > 0
