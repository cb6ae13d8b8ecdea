"""Cross-validation as stages that know what they depend on.

Each (fold, system) is a stage. Its key is the content of the splits that the system reads, its settings and the fold; a stage whose key is complete and
whose table is there is not made again. A changed document changes the splits it is in, and only the systems that read those.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.operators import manifest, metrics
from glyphlake.plans.pipelines import stage

SPLITS = ("train", "val", "test")
MEASURES = ("mean_cer", "mean_wer", "mean_chrf", "exact_match", "reduction", "overcorrection")


@dataclass(frozen=True)
class System:
    """`make` takes a table per split of `needs` by name and returns records of the test rows with the columns that `metrics.aggregate` reads."""

    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = SPLITS
    settings: dict = field(default_factory=dict)


def contents(rows: DataFrame, splits: DataFrame, key: str) -> dict[tuple[int, str], str]:
    """A digest of the rows of each fold and split: at most three per fold. It does not depend on order; repeated rows count."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("x"))
    found = per.join(splits, key).groupBy("fold", "split").agg(F.sum("n").alias("n"), F.sum("x").cast("string").alias("x")).collect()
    return {(r["fold"], r["split"]): f"{r['n']}:{r['x']}" for r in found}


def run(spark: SparkSession, folder: str, rows: DataFrame, systems: dict[str, System], k: int = 5, key: str = "doc_id") -> DataFrame:
    """Records of every system on the test rows of every fold, with `fold` and `model`; columns that only some systems give are null for others. Documents in two splits of a fold raise."""
    splits = manifest.folds(rows.select(key).filter(F.col(key).isNotNull()).distinct(), key, k)
    manifest.assert_empty(manifest.overlap(splits, key), "documents in two splits")
    known = contents(rows, splits, key)
    out = None
    for fold in range(k):
        for name, system in sorted(systems.items()):
            content = {"fold": fold, "folds": k, "settings": system.settings, **{s: known.get((fold, s), "") for s in system.needs}}

            def make(fold=fold, system=system) -> DataFrame:
                of = lambda s: rows.join(splits.filter((F.col("fold") == fold) & (F.col("split") == s)).select(key), key, "left_semi")
                return system.make(**{s: of(s) for s in system.needs})

            made = stage(spark, folder, f"fold{fold}/{name}", content, make).withColumn("fold", F.lit(fold)).withColumn("model", F.lit(name))
            out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    return out


def summary(records: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean and deviation over the folds of each fold's own means; folds without test rows do not count."""
    per = metrics.aggregate(records, [*keys, "fold"])
    return metrics.spread(per, list(keys), list(MEASURES))
