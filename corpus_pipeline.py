"""A corpus pipeline of five stages over the table of documents.

quality rules -> n-gram Jaccard join -> substring dedup -> secret scans -> best-fit packing. Each stage is a function of (spark, docs, sf_dir)
that returns a DataFrame, which is written as Parquet and read again as the next stage's documents. All but the last return the columns
of the documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import jaccard, packing, quality, repeats, secrets
from glyphlake.llm.words import bitmap, importable, in_bitmap, saved, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    importable(spark)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang")  # no column can clash with those of the rules
    return quality.quality(rows, ["_row"]).filter("kept").select("_row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates on five-word shingles at a similarity of 0.8: of each group the document with the smallest id stays.

    Of rows that share an id the one with the smallest text stays (ties: by the row as JSON). Only rows that may be affected are joined; the other texts are not moved.
    """
    importable(spark)
    found = jaccard.near_duplicates(docs, size=5, percent=80)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    twice = found.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    touched = saved(gone.withColumn("gone", F.lit(True)).unionByName(twice.withColumn("gone", F.lit(False))).groupBy("doc_id").agg(F.max("gone").alias("gone")).filter("doc_id is not null"))
    slots = saved(bitmap(touched, "doc_id"))
    rest = in_bitmap(docs, "doc_id", slots, keep=False).select(*docs.columns)
    near = in_bitmap(docs, "doc_id", slots).join(touched, "doc_id", "left")
    single = near.filter("gone is null").select(*docs.columns)
    row = F.struct(*docs.columns)
    first = F.min_by(row, F.struct("text", F.to_json(row)))  # the same one however the rows are dealt out
    repeated = near.filter("not gone").groupBy("doc_id").agg(first.alias("_row")).select("_row.*")
    return rest.unionByName(single).unionByName(repeated)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words of passages that a document with a smaller id has go; a text that loses none stays as it is."""
    importable(spark)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]  # no column can clash with those of the operator
    out = repeats.remove_repeats(docs.select("doc_id", "text", F.struct(F.lit(0), *rest).alias("_row"))).select("doc_id", text.alias("text"), "_row.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: what the forest takes for a secret becomes [SECRET]; all documents stay."""
    importable(spark)
    path = "source" if "source" in docs.columns else None
    spans = secrets.findings(docs, path=path).filter("is_secret").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    spans = saved(spans)
    slots = saved(bitmap(spans, "doc_id"))
    clean = in_bitmap(docs, "doc_id", slots, keep=False).select(*docs.columns)
    masked = F.expr("aggregate(_spans, struct(0 as at, '' as out), (a, s) -> if(s.start < a.at, a, struct(s.end as at, concat(a.out, substring(text, a.at + 1, s.start - a.at), '[SECRET]') as out)), a -> concat(a.out, substring(text, a.at + 1)))")
    hit = in_bitmap(docs, "doc_id", slots).join(spans, "doc_id", "left").withColumn("text", F.when(F.col("_spans").isNotNull(), masked).otherwise(F.col("text")))
    return clean.unionByName(hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the texts' tokens into sequences."""
    import public_tokenizers

    importable(spark)
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache=120_000)  # of chunks, as workers hold memory of the stages before


STAGES = [("quality rules", keep_good), ("n-gram Jaccard join", keep_one_of_each_group), ("substring dedup", without_repeats), ("secret scans", without_secrets), ("best-fit packing", packed)]

#: SQL can express neither the tokenizer nor the forest; the stages are tested against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what goes between them is written to the shared checkpoint folder, where the last stage's rows stay."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
