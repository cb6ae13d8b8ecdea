"""Quality of predictions, significance, calibration and the report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.edits import reduction
from glyphlake.sources.tables import written

BINS = 10
REQUIRED = ("doc_id", "split", "subset_domain", "sample_id", "input_noisy", "prediction", "changed_flag")


def aggregate(records: DataFrame, keys: list[str], domain: str | None = None) -> DataFrame:
    """Macro means and edit outcomes per group; with a domain, groups and group-domains in one pass, where a null domain is the group's own row.

    Columns read: cer, wer, chrf, input_cer, changed. An edit is harmful if the output is no better than the input.
    """
    edited = F.col("changed")
    harmful = edited & (F.col("cer") >= F.col("input_cer"))
    measures = [
        F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"), F.avg("chrf").alias("mean_chrf"), F.avg("input_cer").alias("mean_input_cer"), F.avg(edited.cast("double")).alias("correction_rate"),
        (F.count_if(harmful) / F.greatest(F.count_if(edited), F.lit(1))).alias("overcorrection"), (F.count_if(edited & (F.col("cer") < F.col("input_cer"))) / F.greatest(F.count_if(edited), F.lit(1))).alias("useful_rate"),
        F.count_if(edited).alias("edited"), F.avg((F.col("cer") == 0).cast("double")).alias("exact_match"), F.count(F.lit(1)).alias("n"),
    ]
    if domain is None:
        out = records.groupBy(*keys).agg(*measures)
    else:
        cols = [F.col(k) for k in keys]
        out = records.groupingSets([cols, [*cols, F.col(domain)]], *cols, F.col(domain)).agg(*measures)
    return out.withColumn("reduction", reduction(F.col("mean_input_cer"), F.col("mean_cer")))


def token_corruption(records: DataFrame, keys: list[str]) -> DataFrame:
    """Corrupted over all rare and proper tokens; where token counts are missing the sentence's flags count."""
    part = lambda kind: (F.sum(F.coalesce(f"corrupted_{kind}", (F.col(f"is_{kind}") & F.col("worse")).cast("long"), F.lit(0))) / F.greatest(F.sum(F.coalesce(f"{kind}_tokens", F.col(f"is_{kind}").cast("long"), F.lit(0))), F.lit(1))).alias(f"{kind}_corruption")
    return records.groupBy(*keys).agg(part("rare"), part("proper"))


def calibration_bins(records: DataFrame, confidence: str, correct: str, bins: int = BINS) -> DataFrame:
    """bin, n, mean confidence, mean accuracy; all bins are there."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    b = F.least(F.lit(bins - 1), F.floor(c * bins)).cast("int")
    found = records.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("confidence"), F.avg(correct).alias("accuracy"))
    every = records.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n")), F.lit(0.0)).alias("ece"))


def oracle_best(variants: DataFrame, sample: str = "sample_id", rank: str = "rank") -> DataFrame:
    """Mean error rates of the best system per sample; the lower rank wins ties."""
    best = variants.groupBy(sample).agg(F.min_by(F.struct("cer", "wer"), F.struct("cer", rank)).alias("b"))
    return best.agg(F.avg("b.cer").alias("oracle_cer"), F.avg("b.wer").alias("oracle_wer"), F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """The rows with `i`, their place from 0 in the order. Ranges of the order are sorted and written, then counted, so no task sees all rows."""
    dealt = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return dealt.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("i", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def bootstraps(deltas: DataFrame, columns: list[str], order: str = "sample_id", resamples: int = 1000, salt: str = "boot") -> DataFrame:
    """`n` and, per column of deltas, a struct of its mean, its 95 % interval and two-sided p from resamples drawn by hash: draw k of resample b takes row
    md5(b:k:salt) mod n. All columns are taken from the same draws.

    Rows are numbered within ranges of the order, which are then set one after another. Deltas are per-sample scores of an evaluation set.
    """
    n = deltas.count()
    if not n:
        none = F.struct(F.lit(0.0).alias("mean"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(1.0).alias("p"))
        return deltas.sparkSession.range(1).select(F.lit(0).cast("long").alias("n"), *[none.alias(c) for c in columns])
    rows = numbered(deltas.select(order, *columns), order).select("i", *columns)
    grid = deltas.sparkSession.range(resamples * n).select(F.floor(F.col("id") / n).alias("b"), (F.col("id") % n).alias("k"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "b", "k", F.lit(salt))), 1, 8), 16, 10).cast("bigint") % n
    means = grid.select("b", pick.alias("i")).join(rows, "i").groupBy("b").agg(*[F.avg(c).alias(c) for c in columns])
    listed = means.agg(*[F.sort_array(F.collect_list(c)).alias(f"{c}_m") for c in columns])  # `resamples` numbers each
    whole = rows.agg(*[F.avg(c).alias(c) for c in columns])
    low, high = int(0.025 * resamples), int(0.975 * resamples) - 1

    def found(c: str) -> Column:
        m = F.col(f"{c}_m")
        opposite = F.when(F.col(c) < 0, F.size(F.filter(m, lambda x: x >= 0))).otherwise(F.size(F.filter(m, lambda x: x <= 0))) / resamples
        return F.struct(F.col(c).alias("mean"), m[low].alias("low"), m[high].alias("high"), F.least(F.lit(1.0), 2 * opposite).alias("p")).alias(c)

    return whole.crossJoin(listed).select(F.lit(n).cast("long").alias("n"), *map(found, columns))  # one row each


def bootstrap(deltas: DataFrame, delta: str = "delta", order: str = "sample_id", resamples: int = 1000, salt: str = "boot") -> DataFrame:
    """`bootstraps` of one column: mean, low, high, p, n."""
    return bootstraps(deltas.select(order, F.col(delta).alias("d")), ["d"], order, resamples, salt).select("d.*", "n")


def latency(records: DataFrame, ms: str = "ms") -> DataFrame:
    """Upper median and 95th percentile by rank."""
    s = F.sort_array(F.collect_list(ms))
    at = lambda i: F.element_at("s", (i + 1).cast("int"))
    return records.agg(s.alias("s")).filter(F.size("s") > 0).select(at(F.floor(F.size("s") / 2)).alias("median_ms"), at(F.least(F.size("s") - 1, F.floor(0.95 * F.size("s")))).alias("p95_ms"))


def spread(values: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation over folds or seeds, to six places; nulls are left out."""
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), *[F.bround(F.avg(m), 6).alias(f"{m}_mean") for m in metrics], *[F.bround(F.coalesce(F.stddev_pop(m), F.lit(0.0)), 6).alias(f"{m}_std") for m in metrics])


def headroom_curve(records: DataFrame, bins: int = 10, group: str | None = None, compat: bool = False) -> DataFrame:
    """Mean input and output error rates per quantile bin of the input's, per group and for all (null). compat: edges belong to both bins."""
    rows = records.withColumn("g", F.lit(None).cast("string"))
    if group:
        rows = rows.unionByName(records.withColumn("g", F.col(group).cast("string")))
    edges = rows.groupBy("g").agg(F.percentile("input_cer", F.array(*[F.lit(k / bins) for k in range(bins + 1)])).alias("edges"))
    placed = rows.join(edges.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2"))).drop("g2")
    cut = placed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    low, high = F.col("edges")[F.col("bin")], F.col("edges")[F.col("bin") + 1]
    upper = (F.col("input_cer") <= high) if compat else (F.col("input_cer") < high) | ((F.col("bin") == bins - 1) & (F.col("input_cer") <= high))
    return cut.filter((F.col("input_cer") >= low) & upper).groupBy(F.col("g").alias("group"), "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("input_cer").alias("mean_input_cer"), F.avg("cer").alias("mean_cer"), (F.avg("input_cer") - F.avg("cer")).alias("mean_reduction"))


def ols(rows: DataFrame, features: list[str], target: str) -> list[float]:
    """Intercept and weights from one aggregate of sums; zeros if the sums are singular."""
    import numpy as np

    cols: list[Column] = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k = len(cols)
    sums = rows.agg(*[F.sum(cols[i] * cols[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(cols[i] * F.col(target)).alias(f"y{i}") for i in range(k)]).first()
    a = np.array([[sums[f"x{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    y = np.array([sums[f"y{i}"] or 0.0 for i in range(k)])
    try:
        return np.linalg.solve(a, y).tolist()
    except np.linalg.LinAlgError:
        return [0.0] * k


def threshold_sweep(records: DataFrame, thresholds: list[float], estimate: str = "estimate") -> DataFrame:
    """Per threshold: what keeping only sentences estimated at or over it gives (others fall back to the input)."""
    grid = records.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    rows = records.crossJoin(F.broadcast(grid)).withColumn("kept", F.col(estimate) >= F.col("threshold"))  # a short grid
    out = F.when(F.col("kept"), F.col("cer")).otherwise(F.col("input_cer"))
    edited = F.col("kept") & F.col("changed")
    return rows.groupBy("threshold").agg(F.avg(out).alias("mean_cer"), F.avg("input_cer").alias("mean_input_cer"), F.avg(F.col("kept").cast("double")).alias("kept_share"), (F.count_if(edited & (F.col("cer") > F.col("input_cer"))) / F.greatest(F.count_if(edited), F.lit(1))).alias("overcorrection"))


def chosen_threshold(sweep: DataFrame, budget: float, least_kept: float) -> float:
    """Most reduction within the overcorrection budget and with enough kept; else without the latter; else the least error. Ties: the smaller threshold."""
    rows = sorted(sweep.collect(), key=lambda r: r["threshold"])  # one row per threshold
    gain = lambda r: r["mean_input_cer"] - r["mean_cer"]
    for ok in ([r for r in rows if r["overcorrection"] <= budget and r["kept_share"] >= least_kept], [r for r in rows if r["overcorrection"] <= budget]):
        if ok:
            return max(ok, key=lambda r: (gain(r), -r["threshold"]))["threshold"]
    return min(rows, key=lambda r: (r["mean_cer"], r["threshold"]))["threshold"]


def fused(scores: DataFrame, weights: tuple[float, float, float], sample: str = "sample_id") -> DataFrame:
    """The best candidate per sample by weighted scores lm, channel and neural, with its lead over the identity candidate."""
    total = weights[0] * F.col("lm") + weights[1] * F.col("channel") + weights[2] * F.col("neural")
    rows = scores.withColumn("total", total)
    return rows.groupBy(sample).agg(F.max_by("cand", F.struct("total", "cand")).alias("best"), (F.max("total") - F.max(F.when(F.col("is_identity"), F.col("total")))).alias("lead"))


def grid_search(scores: DataFrame, grid: list[tuple[float, float, float, float]], sample: str = "sample_id") -> DataFrame:
    """Per cell (w_lm, w_channel, w_neural, margin): mean error rate and change rate when the best candidate must lead the identity by the margin. Columns: cand, lm, channel, neural, cer, is_identity."""
    cells = scores.sparkSession.createDataFrame([(i, *map(float, g)) for i, g in enumerate(grid)], "cell int, w_lm double, w_ch double, w_nn double, margin double")
    rows = scores.crossJoin(F.broadcast(cells)).withColumn("total", F.col("w_lm") * F.col("lm") + F.col("w_ch") * F.col("channel") + F.col("w_nn") * F.col("neural"))  # a short grid
    keys = ["cell", "w_lm", "w_ch", "w_nn", "margin"]
    best = rows.groupBy(*keys, sample).agg(F.max_by(F.struct("cand", "cer", "is_identity", "total"), F.struct("total", "cand")).alias("b"), F.max(F.when(F.col("is_identity"), F.struct("total", "cer"))).alias("same"))
    takes = ~F.col("b.is_identity") & (F.col("b.total") - F.col("same.total") >= F.col("margin"))
    return best.groupBy(*keys).agg(F.avg(F.when(takes, F.col("b.cer")).otherwise(F.col("same.cer"))).alias("mean_cer"), F.avg(takes.cast("double")).alias("change_rate"))


def best_cell(cells: DataFrame, tie: float = 1e-6) -> dict:
    """In grid order; a later cell wins by a lower error beyond the tie, or within it by a lower change rate."""
    best = None
    for r in sorted(cells.collect(), key=lambda r: r["cell"]):  # one row per cell
        if best is None or r["mean_cer"] < best["mean_cer"] - tie or (abs(r["mean_cer"] - best["mean_cer"]) <= tie and r["change_rate"] < best["change_rate"]):
            best = r
    return best.asDict() if best else {}


def gated(records: DataFrame, delta: str, margin: float, extra_name: float = 1.0, extra_rare: float = 1.0) -> DataFrame:
    """`decision` and `final` of a prediction by its score's lead over the input; names and rare words raise the margin."""
    need = margin + extra_name * F.col("has_name").cast("double") + extra_rare * F.col("has_rare").cast("double")
    d = F.col(delta)
    label = F.when(F.col("prediction") == F.col("input_noisy"), "identity").when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), "kept_unscored").when(d < need, "reverted_to_input").otherwise("kept_pred")
    return records.withColumn("decision", label).withColumn("final", F.when(F.col("decision") == "reverted_to_input", F.col("input_noisy")).otherwise(F.col("prediction")))


def temperature(logits: DataFrame, grid: list[float]) -> DataFrame:
    """Mean negative log-likelihood per temperature from rows (logits array, target index)."""
    t = logits.sparkSession.createDataFrame([(float(x),) for x in grid], "temperature double")
    rows = logits.crossJoin(F.broadcast(t))  # a short grid
    scaled = F.transform("logits", lambda x: x / F.col("temperature"))
    top = F.array_max(scaled)
    norm = F.log(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
    return rows.groupBy("temperature").agg(F.avg(norm - F.element_at(scaled, F.col("target") + 1)).alias("nll"))


#: Temperatures tried; 1 is always among them.
TEMPERATURES = (0.5, 0.7, 0.85, 1.0, 1.15, 1.3, 1.5, 1.75, 2.0, 2.5)
BINS = 10


def temperature_table(logits: DataFrame, grid: tuple[float, ...] = TEMPERATURES, bins: int = BINS) -> DataFrame:
    """Per temperature: mean negative log-likelihood, expected calibration error and number of rows, from rows (logits array, target index).

    A row becomes a short array of its figures at all temperatures; one aggregate by temperature and bin of confidence has all of them. The predicted index is
    the first of the largest logits.
    """
    temperatures = sorted({float(t) for t in grid} | {1.0})
    rows = logits.filter("target is not null and size(logits) > target and target >= 0").select("logits", "target", F.array_max("logits").alias("_top"))
    hit = (F.array_position("logits", F.col("_top")) - 1 == F.col("target")).cast("double")
    gold = F.element_at("logits", (F.col("target") + 1).cast("int"))

    def at(t: float) -> Column:
        mass = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("_top")) / max(t, 1e-3)))
        return F.struct(F.lit(t).alias("temperature"), (1.0 / mass).alias("confidence"), (F.log(mass) - (gold - F.col("_top")) / max(t, 1e-3)).alias("nll"))

    flat = rows.select(hit.alias("hit"), F.explode(F.array(*map(at, temperatures))).alias("x")).select("hit", "x.*")
    flat = flat.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)))
    binned = flat.groupBy("temperature", "bin").agg(F.sum("confidence").alias("c"), F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n"), F.sum("nll").alias("nll"))
    out = binned.groupBy("temperature").agg(F.sum("n").alias("n_tokens"), (F.sum("nll") / F.sum("n")).alias("nll"), (F.sum(F.abs(F.col("c") - F.col("h"))) / F.sum("n")).alias("ece"))
    return out.select("temperature", "nll", "ece", "n_tokens")


def calibrated_temperature(logits: DataFrame, grid: tuple[float, ...] = TEMPERATURES, bins: int = BINS) -> dict:
    """The temperature of the least negative log-likelihood (ties: nearest 1), with likelihood and calibration error before and after."""
    rows = {r["temperature"]: r for r in temperature_table(logits, grid, bins).collect()}  # a row per temperature
    if not rows:
        return {"temperature": 1.0, "n_tokens": 0}
    best = min(rows, key=lambda t: (rows[t]["nll"], abs(t - 1.0), t))
    return {"temperature": best, "pre_nll": rows[1.0]["nll"], "post_nll": rows[best]["nll"], "pre_ece": rows[1.0]["ece"], "post_ece": rows[best]["ece"], "n_tokens": rows[1.0]["n_tokens"]}


def valid_predictions(records: DataFrame, blind: bool = False) -> DataFrame:
    """Rows that break the schema, with the reason; none if all is well."""
    missing = [c for c in REQUIRED if c not in records.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    bad = F.when(F.greatest(*[F.col(c).isNull() for c in REQUIRED]), "missing value")
    if blind and "cer" in records.columns:
        bad = F.coalesce(bad, F.when(F.col("cer").isNotNull(), "metric in a blind record"))
    return records.withColumn("reason", bad).filter("reason is not null")
