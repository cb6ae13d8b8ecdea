"""Choice of the correctors' weights and margins on validation rows, and acceptance token by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions import edits
from glyphlake.operators import metrics, models

#: Factors of the default margin for names and for rare words (fixed values).
NAME, RARE = 1.5, 1.3


def accepted(rows: DataFrame, margin: float, name: float | None = None, rare: float | None = None, tokens: str = "tokens", best: str = "best", lead: str = "lead", leads: str = "leads", is_rare: str = "is_rare") -> DataFrame:
    """`chosen`, `confidence` and `prediction` of the best candidate, taken token by token.

    A changed token is taken if the candidate's lead over the input, or the token's own in `leads`, reaches its margin, which is raised for names
    and for tokens flagged in `is_rare`. Tokens without a partner stay. Without a change the prediction is `text`.
    """
    name, rare = NAME * margin if name is None else name, RARE * margin if rare is None else rare
    own = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.get(best, i).alias("b"), F.greatest(F.col(lead), F.coalesce(F.get(leads, i), F.lit(0.0))).alias("m"), F.coalesce(F.get(is_rare, i), F.lit(False)).alias("r")))

    def taken(x: Column) -> Column:
        need = F.greatest(F.lit(margin), F.when(models.is_name(x["t"]), name).otherwise(0.0), F.when(x["r"], rare).otherwise(0.0))
        return x["b"].isNotNull() & (x["b"] != x["t"]) & (x["m"] >= need)

    out = rows.withColumn("_own", own)
    out = out.withColumn("chosen", F.transform("_own", lambda x: F.when(taken(x), x["b"]).otherwise(x["t"])))
    out = out.withColumn("confidence", F.transform("_own", lambda x: F.when(x["b"].isNull() | (x["b"] == x["t"]), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["m"] / max(margin, 1e-6))))))
    joined = F.regexp_replace(F.array_join("chosen", " "), r"\s+([,.;:!?])", "$1")
    return out.withColumn("prediction", F.when(F.col("chosen") == F.col(tokens), F.col("text")).otherwise(joined)).drop("_own")


def classical_grid(val: DataFrame, key: str, options: DataFrame, counts: dict[int, DataFrame], channel: DataFrame, margins=(1.0, 1.5, 2.0), lm=(0.5, 1.0, 1.5), ch=(0.3, 0.6, 1.0), extra: float = 1.0) -> DataFrame:
    """Mean error and change rate per cell (margin, lambda_lm, lambda_channel) over unique keys with noisy and clean; `metrics.best_cell` chooses.

    The weights decide what the beam finds; the margin only decides whether it is taken, so texts are searched once per pair of weights.
    """
    found = None
    for i, a in enumerate(lm):
        for j, b in enumerate(ch):
            done = models.corrected(val, key, "noisy", options, counts, channel, margin=-1e18, extra=0.0, weights=(a, b, 0.3))
            one = done.select(key, "prediction", "gain", "changed", "raised", F.lit(a).alias("lambda_lm"), F.lit(b).alias("lambda_channel"), F.lit(i * len(ch) + j).alias("at"))
            found = one if found is None else found.unionByName(one)
    rated = val.select(key, "noisy", "clean").join(found, key).select("*", edits.cer(F.col("clean"), F.col("noisy")).alias("before"), edits.cer(F.col("clean"), F.col("prediction")).alias("after"))
    cells = rated.withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(m)).alias("margin")) for k, m in enumerate(margins)])))
    taken = F.col("changed") & (F.col("gain") >= F.col("m.margin") + extra * F.col("raised").cast("double"))
    cell = F.col("m.k") * (len(lm) * len(ch)) + F.col("at")
    return cells.groupBy(cell.alias("cell"), F.col("m.margin").alias("margin"), "lambda_lm", "lambda_channel").agg(F.avg(F.when(taken, F.col("after")).otherwise(F.col("before"))).alias("mean_cer"), F.avg((taken & (F.col("prediction") != F.col("noisy"))).cast("double")).alias("change_rate"))


def classical(val: DataFrame, key: str, options: DataFrame, counts: dict[int, DataFrame], channel: DataFrame, **grid) -> dict:
    """The best cell; of equal errors the one that changes less."""
    return metrics.best_cell(classical_grid(val, key, options, counts, channel, **grid))
