"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm import bpe, centroids, crosstokens, html, jaccard, languages, neighbours, packing, personal, quality, repeats, secrets, warc
from glyphlake.llm.oracles import ORACLES
from glyphlake.llm.words import importable

QUERIES = [secrets.op1_forest_secret_scan, jaccard.op2_ngram_jaccard_join, html.op3_tag_path_ratios, bpe.op4_bpe_round_trip, languages.op5_language_mixture, neighbours.op6_nn_descent, quality.op7_distribution_divergence, personal.op8_disclosure_sanitisation, repeats.op9_difference_cover, packing.op10_best_fit_packing, centroids.op11_partial_distance_clusters, warc.op12_revisit_resolution, crosstokens.op13_cross_tokenizer_alignment]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: ready(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
