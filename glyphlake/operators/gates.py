"""Gates around a corrector: the headroom estimate before it, and windows of single edits after it.

A scorer is anything with `score(noisy, target) -> (log-probability, per-byte log-probabilities of the target)`. A neural model plugs in there;
`CharScorer` is the stand-in from character counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions import text as X
from glyphlake.functions.profiles import MACEDONIAN, Profile
from glyphlake.operators import metrics, models

#: Latin letters that pass for others within words of another script (fixed values).
LOOKALIKES = "ceoaCEOA"


# Before: how much there is to correct


def suspicious(text: Column, sources: str = "", profile: Profile = MACEDONIAN) -> Column:
    """Look-alikes and frequent error sources (letters outside the script) within words of the script."""
    foreign = "".join(c for c in sources if not re.match(f"[{profile.script}]", c))
    kept = "[^" + "".join("\\" + c if not c.isalnum() else c for c in sorted(set(LOOKALIKES + foreign))) + "]"
    inside = F.filter(X.gate_tokens(text), lambda t: X.in_script(t, profile))
    return F.length(F.regexp_replace(F.array_join(inside, ""), kept, ""))


def features(rows: DataFrame, key: str, text: str, counts: DataFrame, lexicon: DataFrame, sources: str = "", profile: Profile = MACEDONIAN) -> DataFrame:
    """(key, ppl, oov, susp): perplexity per character, share of the script's words not in the lexicon, and suspicious characters per hundred."""
    base = rows.select(key, X.stripped(F.col(text)).alias("s"), F.col(text).alias("t"))
    scored = models.char_scores(base.select("s"), counts, "s")
    ppl = base.join(scored, "s", "left").select(key, F.when(F.col("s") == "", 0.0).otherwise(-F.col("logp") / F.greatest(F.length("s"), F.lit(1))).alias("ppl"))
    tokens = base.select(key, F.explode(F.filter(X.gate_tokens(F.col("t")), lambda t: X.in_script(t, profile))).alias("w")).withColumn("word", F.lower("w"))
    oov = tokens.join(lexicon.select("word", F.lit(1).alias("known")), "word", "left").groupBy(key).agg(F.avg(F.col("known").isNull().cast("double")).alias("oov"))
    susp = base.select(key, (100.0 * suspicious(F.col("t"), sources, profile) / F.greatest(F.length("t"), F.lit(1))).alias("susp"))
    return ppl.join(susp, key).join(oov, key, "left").withColumn("oov", F.coalesce("oov", F.lit(0.0)))


def standard(train: DataFrame) -> tuple[float, float]:
    """Mean and deviation of the perplexity; a deviation of nearly nothing is 1."""
    r = train.agg(F.avg("ppl").alias("m"), F.stddev_pop("ppl").alias("s")).first()
    return r["m"] or 0.0, r["s"] if r["s"] and r["s"] >= 1e-6 else 1.0


def estimated(rows: DataFrame, mean: float, deviation: float, weights: list[float]) -> DataFrame:
    """`estimate` of the input's error rate, from 0 to 1."""
    z = (F.col("ppl") - mean) / deviation
    x = F.lit(weights[0]) + weights[1] * z + weights[2] * F.col("oov") + weights[3] * F.col("susp")
    return rows.withColumn("z_ppl", z).withColumn("estimate", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def fitted(train: DataFrame, val: DataFrame, thresholds: list[float], budget: float, least_kept: float) -> dict:
    """Gate from features of train, and of val with input_cer, cer and changed."""
    mean, deviation = standard(train)
    rows = val.withColumn("z_ppl", (F.col("ppl") - mean) / deviation)
    weights = metrics.ols(rows, ["z_ppl", "oov", "susp"], "input_cer")
    sweep = metrics.threshold_sweep(estimated(val, mean, deviation, weights), thresholds)
    return {"mean": mean, "deviation": deviation, "weights": weights, "threshold": metrics.chosen_threshold(sweep, budget, least_kept)}


def skipped(rows: DataFrame, threshold: float, apply: bool = True) -> Column:
    """Whether a sentence stays as it is because little is expected to be wrong."""
    return (F.col("estimate") < threshold) if apply else F.lit(False)


# After: single edits


class CharScorer:
    """Character n-grams, and a channel term for what differs; a stand-in for a model."""

    def __init__(self, counts: dict[str, int], channel: dict[tuple[str, str], float] | None = None, order: int = models.CHAR_ORDER, k: float = models.ADD_K):
        self.counts, self.channel, self.order, self.k = counts, channel or {}, order, k
        self.context: dict[str, int] = {}
        for g, n in counts.items():
            self.context[g[:-1]] = self.context.get(g[:-1], 0) + n
        self.symbols = max(1, len({g[-1] for g in counts}))

    def score(self, noisy: str, target: str) -> tuple[float, list[float]]:
        per_byte: list[float] = []
        padded = "^" * (self.order - 1) + target
        for i, c in enumerate(target):
            g = padded[i : i + self.order]
            p = math.log((self.counts.get(g, 0) + self.k) / (self.context.get(g[:-1], 0) + self.k * self.symbols))
            per_byte += [p / len(c.encode())] * len(c.encode())
        return sum(per_byte) / ((5 + len(per_byte)) / 6) ** 0.6 + models.channel_logp(noisy, target, self.channel), per_byte


def _bytes_before(text: str) -> list[int]:
    out = [0]
    for c in text:
        out.append(out[-1] + len(c.encode()))
    return out


def gate_edits(noisy: str, prediction: str, scorer, margin: float = 0.2, edit_margin: float = 0.2, extra: float = 1.0, rare: frozenset[str] = frozenset(), whitelist: frozenset[tuple[str, str]] | None = None) -> tuple[str, str, int, int]:
    """(final, decision, kept windows, reverted windows). The sentence must gain the margin; then each edit its own, more for names and for rare words; one letter for another only if the pair is on the whitelist."""
    if prediction == noisy:
        return noisy, "identity", 0, 0
    own, own_bytes = scorer.score(noisy, noisy)
    new, new_bytes = scorer.score(noisy, prediction)
    if not (math.isfinite(own) and math.isfinite(new)):
        return prediction, "kept_unscored", 0, 0
    if new - own < margin:
        return noisy, "reverted_to_input", 0, 0
    a_at, b_at = _bytes_before(noisy), _bytes_before(prediction)
    out, kept, back = [], 0, 0
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+", noisy)]
    for tag, a, b, c, d in SequenceMatcher(None, noisy, prediction, False).get_opcodes():
        if tag == "equal":
            out.append(noisy[a:b])
            continue
        word = next((w for s, e, w in words if s <= a < e), "")
        need = edit_margin + extra * word[:1].isupper() + extra * (word.lower() in rare)
        gain = sum(new_bytes[b_at[c] : b_at[d]]) - sum(own_bytes[a_at[a] : a_at[b]])
        single = b - a == d - c == 1 and noisy[a].isalpha() and prediction[c].isalpha()
        fine = math.isfinite(gain) and gain >= need and not (single and whitelist is not None and (noisy[a].lower(), prediction[c].lower()) not in whitelist)
        out.append(prediction[c:d] if fine else noisy[a:b])
        kept, back = kept + fine, back + (not fine)
    final = "".join(out)
    return final, "reverted_to_input" if final == noisy else "kept_pred_partial" if back else "kept_pred", kept, back


GATED = T.StructType([T.StructField("final", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("kept", T.IntegerType()), T.StructField("reverted", T.IntegerType())])


def edit_gate(make_scorer: Callable[[], object], **settings):
    """A pandas UDF of (noisy, prediction) with the outcome of `gate_edits`; the scorer is made once per task."""

    @F.pandas_udf(GATED)
    def run(noisy: pd.Series, prediction: pd.Series) -> pd.DataFrame:
        scorer = make_scorer()
        return pd.DataFrame([gate_edits(a or "", b or "", scorer, **settings) for a, b in zip(noisy, prediction, strict=True)], columns=["final", "decision", "kept", "reverted"])

    return run


def margin_grid(scored: DataFrame, margins: list[float], edit_margins: list[float]) -> DataFrame:
    """Mean error per (margin, edit_margin) from cached rows: sentence_delta, and windows array<struct<delta, cer_gain>> with input_cer.

    One pass: the gains of all windows are added up by how many margins their sentence and they themselves reach, and a cell's gain is the sum of all that
    reach both of its margins. Windows and sentences without a finite delta reach none. The best cell comes first; of equal errors the one with the
    larger edit margin, then with the larger margin.
    """
    spark, margins, edit_margins = scored.sparkSession, sorted(map(float, margins)), sorted(map(float, edit_margins))
    reached = lambda value, steps: F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0).otherwise(sum(((value >= s).cast("int") for s in steps), F.lit(0)))
    total = scored.agg(F.count("input_cer").alias("rows"), F.avg("input_cer").alias("input"))
    windows = scored.filter("input_cer is not null").select(reached(F.col("sentence_delta"), margins).alias("a"), F.explode("windows").alias("w")).filter("a > 0")
    gains = windows.select("a", reached(F.col("w.delta"), edit_margins).alias("b"), F.col("w.cer_gain").alias("gain")).filter("b > 0").groupBy("a", "b").agg(F.sum("gain").alias("gain"))
    cells = spark.createDataFrame([(i + 1, j + 1, a, b) for i, a in enumerate(margins) for j, b in enumerate(edit_margins)], "i int, j int, margin double, edit_margin double")
    summed = cells.join(F.broadcast(gains), (F.col("a") >= F.col("i")) & (F.col("b") >= F.col("j")), "left").groupBy("margin", "edit_margin").agg(F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain"))  # a row per cell on both sides
    out = summed.crossJoin(F.broadcast(total))  # one row
    return out.select("margin", "edit_margin", (F.col("input") - F.col("gain") / F.col("rows")).alias("mean_cer")).orderBy("mean_cer", F.desc("edit_margin"), F.desc("margin"))


#: Margins tried for sentences and for single edits.
MARGINS = (0.0, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5)


def best_margins(scored: DataFrame, margins: list[float] = MARGINS, edit_margins: list[float] = MARGINS, tie: float = 1e-9) -> dict:
    """The cell of the least error; within `tie` of it the largest edit margin, then the largest margin."""
    rows = [r.asDict() for r in margin_grid(scored, margins, edit_margins).collect()]  # a row per cell
    least = min((r["mean_cer"] for r in rows if r["mean_cer"] is not None), default=None)
    near = [r for r in rows if least is not None and r["mean_cer"] <= least + tie]
    return max(near, key=lambda r: (r["edit_margin"], r["margin"]), default={})


def whitelist(confusions: DataFrame, k: int = 200) -> DataFrame:
    """The k most frequent single-letter confusions, as (noisy, clean)."""
    one = confusions.filter((F.length("clean") == 1) & (F.length("noisy") == 1) & (F.col("clean") != F.col("noisy")) & F.col("clean").rlike(r"\p{L}") & F.col("noisy").rlike(r"\p{L}"))
    return one.orderBy(F.desc("n"), "clean", "noisy").limit(k).select("noisy", "clean")


def both_directions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(a, b).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()
