"""Manifests of training pairs, splits and folds, and the checks that keep them apart."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "split", "subset_domain", "sample_id", "order_key", "token_or_sentence_level", "noisy", "clean", "source_type")
# Fixed values of the quality check.
VERY_LOW, LOW, MAX_VERY_LOW, MAX_LOW, MIN_MEAN = 0.30, 0.45, 0.40, 0.75, 0.40


def manifest(pairs: DataFrame, splits: DataFrame, domains: DataFrame, source_type: str, level: str = "sentence") -> DataFrame:
    """Rows of a manifest from (doc_id, pos, noisy, clean); pairs without a change or a side do not enter, unknown documents raise."""
    rows = pairs.filter("noisy <> '' and clean <> '' and noisy <> clean").join(splits, "doc_id", "left").join(domains, "doc_id", "left")
    known = F.coalesce("split", F.raise_error(F.concat(F.lit("no split for "), F.col("doc_id").cast("string"))).cast("string"))
    return rows.select(F.col("doc_id"), known.alias("split"), F.col("subset_domain"), F.concat_ws("-", F.lit(source_type), "doc_id", "pos").alias("sample_id"), F.col("pos").cast("int").alias("order_key"), F.lit(level).alias("token_or_sentence_level"), "noisy", "clean", F.lit(source_type).alias("source_type"))


def repetitions(n_large: int, n_small: int, ratio: float = 4.0) -> int:
    """How often the small source is taken so that the large one is about `ratio` times it; halves go to the even number."""
    return max(1, round(n_large / n_small / ratio)) if n_small else 1


def oversampled(rows: DataFrame, reps: int, train_only: bool = True) -> DataFrame:
    """Copies with __dup1, __dup2, ... in their ids; validation and test rows stay single unless train_only is off."""
    n = F.when(F.col("split") == "train", F.lit(reps)).otherwise(F.lit(1)) if train_only else F.lit(reps)
    each = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    return each.withColumn("sample_id", F.when(F.col("_k") > 0, F.concat("sample_id", F.lit("__dup"), F.col("_k"))).otherwise(F.col("sample_id"))).drop("_k")


def combined(real: DataFrame, synthetic: DataFrame, ratio: float = 4.0, train_only: bool = True) -> DataFrame:
    reps = repetitions(synthetic.count(), real.count(), ratio)
    return oversampled(real, reps, train_only).unionByName(synthetic)


def duplicates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "sample_id", "source_type").count().filter("count > 1")


def summary(regimes: dict[str, DataFrame]) -> DataFrame:
    """Counts by regime, split and source, with totals (nulls) by rollup."""
    out = None
    for name, rows in regimes.items():
        part = rows.groupBy("split", "source_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("regime"), "split", "source_type", "n")
        out = part if out is None else out.unionByName(part)
    return out.rollup("regime", "split", "source_type").agg(F.sum("n").alias("n"))


def pair_quality(pairs: DataFrame, ratio: Column, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(ratio).alias("mean"), F.min(ratio).alias("low"), F.max(ratio).alias("high"), F.avg((ratio < LOW).cast("double")).alias("low_share"), F.avg((ratio < VERY_LOW).cast("double")).alias("very_low_share"))


def check_quality(quality: DataFrame) -> None:
    bad = quality.filter((F.col("n") == 0) | (F.col("very_low_share") > MAX_VERY_LOW) | (F.col("low_share") > MAX_LOW) | (F.col("mean") < MIN_MEAN)).limit(5).collect()
    if bad:
        raise ValueError(f"pairs of low quality: {[r.asDict() for r in bad]}")


def folds(docs: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(fold, key, split): each document is a test document in one fold and a validation document in another."""
    if k < 2:
        raise ValueError("two folds at least")
    home = docs.select(key, F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int").alias("home"))
    each = home.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = F.when(F.col("home") == F.col("fold"), "test").when(F.col("home") == (F.col("fold") + 1) % k, "val").otherwise("train")
    return each.select("fold", key, split.alias("split"))


def overlap(splits: DataFrame, key: str) -> DataFrame:
    """Documents that are in two splits of a fold."""
    return splits.groupBy("fold", key).agg(F.countDistinct("split").alias("n")).filter("n > 1")


def leaked(rows: DataFrame, allowed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of rows that are not allowed."""
    return rows.select(key).distinct().join(allowed, key, "left_anti")


def assert_empty(df: DataFrame, what: str) -> None:
    found = df.limit(5).collect()
    if found:
        raise AssertionError(f"{what}: {[r.asDict() for r in found]}")


def resolved(docs: DataFrame, aliases: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys replaced by what an alias table (alias, name) says."""
    return docs.join(aliases.withColumnRenamed("alias", key), key, "left").withColumn(key, F.coalesce("name", key)).drop("name")


def content_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("doc_id", "order_key", "source_type", "sample_id")


def first_rows(rows: DataFrame, group: str, n: int) -> DataFrame:
    """The first n of each group in manifest order: the tuning caps."""
    w = Window.partitionBy(group).orderBy("doc_id", "order_key", "source_type", "sample_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
