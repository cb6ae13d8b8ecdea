"""How like real errors made ones are: profiles, divergences and distances of distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12


def profile(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, p): shares of counts; zeros if there are none."""
    total = counts.agg(F.sum(n).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, F.coalesce(F.try_divide(F.col(n), F.col("total")), F.lit(0.0)).alias("p"))  # one row


def js_divergence(p: DataFrame, q: DataFrame, key: str, n: str = "n") -> DataFrame:
    """One row `js`, base 2, of two count tables over the union of their keys; each count gets a small part before normalizing."""
    both = p.select(key, F.col(n).cast("double").alias("a")).join(q.select(key, F.col(n).cast("double").alias("b")), key, "full").na.fill(0.0, ["a", "b"])
    sums = both.agg(F.sum(F.col("a") + EPSILON).alias("sa"), F.sum(F.col("b") + EPSILON).alias("sb"))
    rows = both.crossJoin(F.broadcast(sums)).select(((F.col("a") + EPSILON) / F.col("sa")).alias("p"), ((F.col("b") + EPSILON) / F.col("sb")).alias("q"))  # one row
    m = (F.col("p") + F.col("q")) / 2
    return rows.agg(F.coalesce(0.5 * F.sum(F.col("p") * F.log2(F.col("p") / m)) + 0.5 * F.sum(F.col("q") * F.log2(F.col("q") / m)), F.lit(0.0)).alias("js"))


def ks_distance(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row `ks`: the largest difference of the two empirical distributions of a number; 0 if either is empty.

    Values are counted first, so the running sums go over distinct values: within ranges, cut at quantiles, and over the ranges' totals.
    """
    rows = a.select(F.col(value).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(value).alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    per = rows.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    per = per.filter("v is not null")
    ranges = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.broadcast(per.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)] or [0.5]).alias("cuts")))  # one row
    dealt = per.crossJoin(cuts).withColumn("range", F.size(F.filter(F.coalesce("cuts", F.array()), lambda c: c <= F.col("v")))).drop("cuts")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = dealt.groupBy("range").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).select("range", F.coalesce(F.sum("x").over(before), F.lit(0)).alias("bx"), F.coalesce(F.sum("y").over(before), F.lit(0)).alias("by"))
    w = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.join(F.broadcast(base), "range").select((F.col("bx") + F.sum("x").over(w)).alias("cx"), (F.col("by") + F.sum("y").over(w)).alias("cy"))
    total = per.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    return run.crossJoin(F.broadcast(total)).agg(F.coalesce(F.max(F.abs(F.try_divide(F.col("cx"), F.col("nx")) - F.try_divide(F.col("cy"), F.col("ny")))), F.lit(0.0)).alias("ks"))  # one row


def quantile_difference(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row `diff`: the mean absolute difference of the deciles .1 to .9; 0 if either is empty."""
    deciles = F.array(*[F.lit(k / 10) for k in range(1, 10)])
    q = lambda df, name: df.agg(F.percentile(value, deciles).alias(name))
    both = q(a, "qa").crossJoin(q(b, "qb"))  # one row each
    return both.select(F.coalesce(F.aggregate(F.zip_with("qa", "qb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 9, F.lit(0.0)).alias("diff"))


def length_ratio(pairs: DataFrame, noisy: str = "noisy", clean: str = "clean") -> DataFrame:
    return pairs.withColumn("length_ratio", F.length(noisy) / F.greatest(F.length(clean), F.lit(1)))


def evaluation(real_ops: DataFrame, made_ops: DataFrame, real_pairs: DataFrame, made_pairs: DataFrame) -> DataFrame:
    """One row that compares made noise with real noise: error profiles, confusions, and length ratios (macro means)."""
    from glyphlake.operators.confusion import confusion

    def kinds(ops: DataFrame) -> DataFrame:
        return ops.filter("op <> 'match'").groupBy("op").agg(F.count(F.lit(1)).alias("n"))

    def cells(ops: DataFrame) -> DataFrame:
        return confusion(ops, errors_only=True).select(F.concat_ws("\x1f", "clean", "noisy").alias("cell"), "n")

    ra, rb = length_ratio(real_pairs), length_ratio(made_pairs)
    parts = [
        js_divergence(kinds(real_ops), kinds(made_ops), "op").toDF("profile_js"), js_divergence(cells(real_ops), cells(made_ops), "cell").toDF("confusion_js"), ks_distance(ra, rb, "length_ratio").toDF("length_ks"),
        quantile_difference(ra, rb, "length_ratio").toDF("length_diff"), ra.agg(F.avg("length_ratio").alias("real_length_ratio")), rb.agg(F.avg("length_ratio").alias("made_length_ratio")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
