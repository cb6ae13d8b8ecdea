"""Structured Streaming forms of the column operators: an extension, the batch pipelines do not need it.

Cleaning, tokens, gates and positional error counts are column expressions and work on streams as they stand. Error rates per window
need a watermark, so that late pages are counted or dropped by a rule and state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphlake.functions import text as T

PAGES = "page_id string, doc_id string, ts timestamp, noisy string, clean string"


def pages(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Arriving JSON files of pages."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def cleaned(stream: DataFrame) -> DataFrame:
    return stream.withColumn("noisy", T.without_dash_noise(T.without_batch_lines(T.without_page_markers(F.col("noisy")))))


def windowed_errors(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Edit distance and reference length per document and window; pages later than the watermark are dropped, a page that comes twice counts once."""
    rows = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["page_id"])
    errors, length = F.levenshtein("noisy", "clean"), F.length("clean")
    out = rows.groupBy("doc_id", F.window("ts", width).alias("w")).agg(F.sum(errors).alias("errors"), F.sum(length).alias("ref_total"), F.count(F.lit(1)).alias("pages"))
    return out.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "errors", "ref_total", "pages", (F.col("errors") / F.greatest("ref_total", F.lit(1))).alias("cer"))


def run(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
