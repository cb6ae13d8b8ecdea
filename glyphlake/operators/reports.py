"""Report tables over stored predictions, and the runs that make them.

Records have sample_id, model, regime, seed, subset_domain and the measures cer, wer, chrf, input_cer, changed. A report has a row per model, regime
and bin or rival, so lists of models and regimes come to the driver; records never do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.operators import manifest, metrics
from glyphlake.sources import tables

KEYS = ["model", "regime"]
TOKENS = ("corrupted_rare", "rare_tokens", "corrupted_proper", "proper_tokens")


def efficiency(records: DataFrame, keys: list[str], ms: str = "ms") -> DataFrame:
    """Upper median and 95th percentile by rank per group. Equal times are counted before they are ranked."""
    counts = records.groupBy(*keys, F.col(ms).alias("_ms")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_n").over(group.orderBy("_ms").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(group))
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_ms")))
    return ranked.groupBy(*keys).agg(at(F.floor(F.col("_all") / 2)).alias("median_ms_per_sentence"), at(F.least(F.col("_all") - 1, F.floor(0.95 * F.col("_all")))).alias("p95_ms_per_sentence"))


def main_table(records: DataFrame, costs: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """One row per group: means, edit outcomes, corrupted rare words and names, and the columns of `costs` (per group) where there are any."""
    keys = keys or KEYS
    missing = [F.lit(None).cast("long").alias(c) for c in TOKENS if c not in records.columns]
    flagged = records.select("*", *missing).withColumn("worse", F.col("cer") > F.col("input_cer"))
    names = {
        "mean_input_cer": "input_cer", "mean_cer": "cer", "reduction": "cer_reduction_rate", "mean_wer": "wer", "mean_chrf": "chrf", "exact_match": "sentence_accuracy", "correction_rate": "correction_rate",
        "overcorrection": "overcorrection_rate", "useful_rate": "useful_correction_rate",
    }
    rounded = [F.round(a, 5).alias(b) for a, b in names.items()]
    out = metrics.aggregate(records, keys).select(*keys, "n", *rounded, F.col("edited").alias("edited_count"))
    if {"is_rare", "is_proper"} <= set(records.columns):
        lost = metrics.token_corruption(flagged, keys).select(*keys, F.round("rare_corruption", 5).alias("rare_word_corruption_rate"), F.round("proper_corruption", 5).alias("proper_name_corruption_rate"))
        out = out.join(lost, keys)
    return out.join(costs, keys, "left") if costs is not None else out


def calibration_table(records: DataFrame, confidence: str, correct: str, temperatures: DataFrame | None = None, keys: list[str] | None = None, bins: int = metrics.BINS) -> DataFrame:
    """All bins of each group with the group's expected error; `temperatures` (per group: temperature, token_ece_pre, token_ece_post) may be missing."""
    keys = keys or KEYS
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    b = F.least(F.lit(bins - 1), F.floor(c * bins)).cast("int")
    found = records.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg(c).alias("mean_confidence"), F.avg(correct).alias("mean_accuracy"))
    gap = F.sum(F.col("count") * F.abs(F.col("mean_confidence") - F.col("mean_accuracy"))) / F.sum("count")
    every = found.groupBy(*keys).agg(F.round(gap, 5).alias("ece")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(found, [*keys, "bin"], "left").select(*keys, "ece", (F.col("bin") / bins).alias("bin_lo"), ((F.col("bin") + 1) / bins).alias("bin_hi"), F.coalesce("count", F.lit(0)).alias("count"), *[F.round(F.coalesce(m, F.lit(0.0)), 5).alias(m) for m in ("mean_confidence", "mean_accuracy")])
    if temperatures is None:
        return out.withColumns({c: F.lit(None).cast("double") for c in ("temperature", "token_ece_pre", "token_ece_post")})
    return out.join(temperatures.select(*keys, *[F.round(c, 5).alias(c) for c in ("temperature", "token_ece_pre", "token_ece_post")]), keys, "left")


def significance_table(records: DataFrame, baseline: str = "identity", rival: str = "classical", resamples: int = 1000) -> DataFrame | None:
    """Paired bootstraps of each system against the baseline and the rival, per regime. Where the two have not the same samples, there is no row; None without any."""
    runs = records.select("regime", "model", "sample_id")
    sizes = {(r["regime"], r["model"]): r["n"] for r in runs.groupBy("regime", "model").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per run
    others = runs.filter(F.col("model").isin(baseline, rival)).withColumnRenamed("model", "other")
    shared = runs.join(others, ["regime", "sample_id"]).groupBy("regime", "model", "other").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for r in sorted(shared.collect(), key=lambda r: (r["regime"], r["model"], r["other"] == rival)):  # at most two rows per run
        regime, system, other = r["regime"], r["model"], r["other"]
        if system in (baseline, other) or not r["n"] == sizes[regime, system] == sizes[regime, other]:
            continue
        of = lambda m, regime=regime: records.filter((F.col("regime") == regime) & (F.col("model") == m)).select("sample_id", "cer", "wer")
        both = of(system).join(of(other).withColumnsRenamed({"cer": "cer0", "wer": "wer0"}), "sample_id")
        drawn = metrics.bootstraps(both.select("sample_id", *[(F.col(m) - F.col(f"{m}0")).alias(m) for m in ("cer", "wer")]), ["cer", "wer"], resamples=resamples)
        row = drawn.select(
            F.lit(regime).alias("regime"), F.lit(system).alias("system"), F.lit(other).alias("vs_baseline"), "n", F.round("cer.mean", 6).alias("cer_mean_delta"), F.round("cer.low", 6).alias("cer_ci_low"), F.round("cer.high", 6).alias("cer_ci_high"), F.round("cer.p", 5).alias("cer_p_value"),
            F.round("wer.mean", 6).alias("wer_mean_delta"), F.round("wer.p", 5).alias("wer_p_value"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def seed_variance_table(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and population deviation over the seeds' means."""
    keys = keys or KEYS
    per = metrics.aggregate(records, [*keys, "seed"])
    mean, std = lambda m: F.round(F.avg(m), 5), lambda m: F.round(F.stddev_pop(m), 5)
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"), mean("mean_cer").alias("cer_mean"), std("mean_cer").alias("cer_std"), mean("mean_wer").alias("wer_mean"), std("mean_wer").alias("wer_std"), mean("mean_chrf").alias("chrf_mean"), mean("exact_match").alias("sent_acc_mean")
    )


def payload(records: DataFrame, confidence: str, correct: str, domain: str = "subset_domain") -> DataFrame:
    """All measures of a run in one row: those of `main_table`, `per_domain` (a map from the domain to its measures), `calibration` (its bins) and `ece`."""
    keys = [*KEYS, "seed"]
    per = metrics.aggregate(records, [*keys, domain])
    measures = [c for c in per.columns if c not in (*keys, domain)]
    domains = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.col(domain).cast("string"), F.lit("unknown")), F.struct(*measures)))).alias("per_domain"))
    bins = calibration_table(records, confidence, correct, keys=keys)
    listed = bins.groupBy(*keys).agg(F.max("ece").alias("ece"), F.array_sort(F.collect_list(F.struct("bin_lo", "bin_hi", "count", "mean_confidence", "mean_accuracy"))).alias("calibration"))
    return main_table(records, keys=keys).join(domains, keys).join(listed, keys)


def all_tables(records: DataFrame, confidence: str, correct: str, primary_seed: int, costs: DataFrame | None = None, temperatures: DataFrame | None = None, alignment_quality: DataFrame | None = None) -> dict[str, DataFrame]:
    """The report tables by name; all but the seeds' spread read the primary seed's records. Tables without rows to report are missing."""
    own = records.filter(F.col("seed") == primary_seed)
    ranks = own.withColumn("rank", (F.col("model") != "identity").cast("int"))
    out = {
        "main_table": main_table(own, costs), "cross_domain": metrics.aggregate(own, KEYS, "subset_domain"), "calibration": calibration_table(own, confidence, correct, temperatures), "oracle": oracle_table(ranks),
        "significance": significance_table(own), "seed_variance": seed_variance_table(records), "headroom_curve": metrics.headroom_curve(own, group="regime"), "alignment_quality": alignment_quality,
    }
    return {k: v for k, v in out.items() if v is not None}


def oracle_table(ranked: DataFrame) -> DataFrame:
    """Per regime the mean error rates of the best system for each sample; the lower rank, then the name, wins ties."""
    best = ranked.groupBy("regime", "sample_id").agg(F.min_by(F.struct("cer", "wer"), F.struct("cer", "rank", "model")).alias("b"))
    return best.groupBy("regime").agg(F.round(F.avg("b.cer"), 5).alias("oracle_cer"), F.round(F.avg("b.wer"), 5).alias("oracle_wer"), F.count(F.lit(1)).alias("n"))


def write_all(found: dict[str, DataFrame], folder: str) -> None:
    """Each table as one CSV under its name."""
    for name, rows in found.items():
        tables.write_table(rows, folder, name)


def run_all(spark: SparkSession, folder: str, systems: dict[str, Callable[[DataFrame, int], DataFrame]], regimes: dict[str, DataFrame], seeds: list[int], version: str = "") -> DataFrame:
    """Records of each system on each regime's rows with each seed, stored under `folder`; a run that is complete for the same version is not made again.

    A system takes (rows, seed) and returns records with their measures. The table of runs gets a row as each run ends.
    """
    for model, predict in systems.items():
        for regime, rows in regimes.items():
            for seed in seeds:
                path = f"{folder}/predictions/model={model}/regime={regime}/seed={seed}"
                key = manifest.content_hash({"model": model, "regime": regime, "seed": seed, "version": version})
                if tables.finished(spark, f"{folder}/runs", key):
                    continue
                predict(rows, seed).drop("model", "regime", "seed").write.mode("overwrite").parquet(path)
                tables.append_run(spark, f"{folder}/runs", {"model": model, "regime": regime, "seed": seed, "status": "complete", "hash": key})
    return spark.read.parquet(f"{folder}/predictions")
