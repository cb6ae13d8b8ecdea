"""Report tables, runs, and the corrector by joins."""

from conftest import DATA
from pyspark.sql import functions as F

from glyphlake.operators import metrics, models, reports, tuning
from glyphlake.plans import error_queries, report_queries
from glyphlake.sources import stores


def test_corrector_by_joins_equals_whole_model(spark):
    """Against beams over the whole model held as dicts."""
    _, pairs, options, counts, channel = error_queries._corrector(spark, f"{DATA}/sf0.001")
    more = spark.createDataFrame([(901, ""), (902, None), (903, "One, two , Three!"), (903, "zz zz")], "item_id long, noisy string")
    rows = pairs.filter("item_id < 8").select(F.col("item_id").cast("long").alias("item_id"), "noisy").unionByName(more)  # the beams are slow
    lm = models.BackOff([(r["ctx"], r["w"], r["n"]) for t in counts.values() for r in t.collect()])
    known, listed = lm.n.get((), {}), {}
    for r in sorted(options.collect(), key=lambda r: (r["word"], r["rank"])):
        listed.setdefault(r["word"], []).append((r["cand"], r["logp"] if r["logp"] is not None else models.TOO_SHORT))
    table = {(r["hyp"], r["noisy"]): r["logp"] for r in channel.collect()}
    for margin in (1.5, -1e9):
        want = [(r["item_id"], r["noisy"], *models._decided(models.PARTS.findall(r["noisy"] or ""), r["noisy"], listed, lm, table, lambda w: known.get(w, 0), margin, 1.0, models.WEIGHTS)) for r in rows.collect()]
        got = models.corrected(rows, "item_id", "noisy", options, counts, channel, margin=margin).collect()
        assert len(want) == len(got) == rows.count()
        for x, y in zip(sorted(want, key=str), sorted(map(tuple, got), key=str), strict=True):
            assert x[:3] == y[:3] and x[4:] == y[4:] and abs(x[3] - y[3]) < 1e-6


def test_runs_are_made_once_and_reported(spark, tmp_path):
    rec = report_queries.records(spark, f"{DATA}/sf0.001").cache()
    made = []

    def system(name):
        def predict(rows, seed):
            made.append((name, seed))
            return rows.filter((F.col("model") == name) & (F.col("seed") == seed))

        return predict

    regimes = {r: rec.filter(F.col("regime") == r) for r in ("even", "odd")}
    systems = {m: system(m) for m in ("identity", "classical")}
    stored = reports.run_all(spark, str(tmp_path / "out"), systems, regimes, [1, 2])
    assert len(made) == 8 and stored.count() == rec.filter("model <> 'other'").count()
    reports.run_all(spark, str(tmp_path / "out"), systems, regimes, [1, 2])
    assert len(made) == 8
    stored = reports.run_all(spark, str(tmp_path / "out"), systems, regimes, [1, 2], version="2")
    assert len(made) == 16
    found = reports.all_tables(stored, "confidence", "correct", 1, reports.efficiency(stored.filter("seed = 1"), reports.KEYS))
    assert set(found) == {"main_table", "cross_domain", "calibration", "oracle", "significance", "seed_variance", "headroom_curve"}
    reports.write_all(found, str(tmp_path / "tables"))
    main = spark.read.option("header", True).csv(str(tmp_path / "tables" / "main_table"))
    assert main.count() == 4 and {"median_ms_per_sentence", "cer_reduction_rate"} <= set(main.columns)
    assert spark.read.option("header", True).csv(str(tmp_path / "tables" / "significance")).count() == 2


def test_efficiency_by_rank(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (5, 1, 1, 9)] + [("b", 2.0)], "model string, ms double")
    got = {r["model"]: (r["median_ms_per_sentence"], r["p95_ms_per_sentence"]) for r in reports.efficiency(rows, ["model"]).collect()}
    assert got == {"a": (5.0, 9.0), "b": (2.0, 2.0)}


def test_tuning_agrees_with_single_runs(spark):
    _, pairs, options, counts, channel = error_queries._corrector(spark, f"{DATA}/sf0.001")
    val = pairs.filter("item_id < 5").cache()
    cells = tuning.classical_grid(val, "item_id", options, counts, channel, margins=(-5.0, 1.0), lm=(1.0,), ch=(0.6,))
    got = {r["margin"]: r["change_rate"] for r in cells.collect()}
    for m, rate in got.items():
        done = models.corrected(val, "item_id", "noisy", options, counts, channel, margin=m).collect()
        assert abs(sum(r["prediction"] != r["input"] for r in done) / len(done) - rate) < 1e-9
    assert metrics.best_cell(cells)["mean_cer"] == min(r["mean_cer"] for r in cells.collect())


def test_models_come_back(spark, tmp_path):
    words = spark.createDataFrame([("a", 1)], "word string, n long")
    stores.save_model(spark, str(tmp_path / "m"), {"lexicon": words}, {"margin": 1.0, "old": 3})
    found, settings = stores.load_model(spark, str(tmp_path / "m"), {"margin": 2.0, "weight": 0.5})
    assert settings == {"margin": 1.0, "weight": 0.5} and found["lexicon"].collect() == words.collect()
    assert stores.first_document(spark, [str(tmp_path / "none"), str(tmp_path / "m" / "settings")])["margin"] == 1.0
    assert stores.first_document(spark, [str(tmp_path / "none")], {}) == {}
