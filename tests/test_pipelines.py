"""The phases end to end on two small books, sources and sinks, and the stream."""

import shutil

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import reports
from glyphlake.plans import pipelines
from glyphlake.sources import tables

CLEAN = ["Првата реченица е тука. Втората доаѓа по неа. Третата е најдолга од сите.", "Еден човек оди дома. Друг човек останува. Никој не зборува многу."]
NOISY = ["Првата реченица е тука. Вторaта доаѓа по неа. Третата е нај долга од сите.", "Еден човек оди дома. Друг човек останува. Никој не зборува многу."]


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    raw, fixed = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("fixed")
    for k, (n, c) in enumerate(zip(NOISY, CLEAN, strict=True)):
        (raw / f"book{k}_ocr_raw.txt").write_text(n, encoding="utf-8")
        (fixed / f"book{k}_corrected.txt").write_text(c, encoding="utf-8")
    (raw / "lost_ocr_raw.txt").write_text("x", encoding="utf-8")
    return str(raw), str(fixed)


def test_sources(spark, books):
    assert tables.book_pairs(spark, *books).count() == 2
    assert [r["book"] for r in tables.unmatched(spark, *books).collect()] == ["lost"]
    assert tables.document(spark, books[0] + "/none.json", {}) == {}
    assert tables.jsonl(spark, books[0] + "/none", "a int").count() == 0


def test_corpus(spark, books, tmp_path, monkeypatch):
    splits = spark.createDataFrame([("book0", "train")], "book string, split string")
    out = pipelines.corpus(spark, *books, splits, str(tmp_path))
    assert out["pairs"].count() == 6
    assert {r["book"]: r["split"] for r in out["pairs"].select("book", "split").distinct().collect()} == {"book0": "train", "book1": "unassigned"}
    assert out["boundary"].filter("type = 'split'").count() == 1
    sub = out["error_confusion"].filter("clean = 'а' and noisy = 'a'").first()
    assert sub["n"] == 1
    fam = out["families"].filter("clean = 'а' and noisy = 'a'").first()
    assert fam["is_homoglyph"] and not fam["is_diacritic"]
    aligned = pipelines.alignment
    asked = []
    monkeypatch.setattr(pipelines, "alignment", lambda *a: asked.append(a) or aligned(*a))
    again = pipelines.corpus(spark, *books, splits, str(tmp_path))
    assert not asked and again["pairs"].count() == 6  # nothing is aligned before a table turns out to be missing
    shutil.rmtree(tmp_path / "books" / "stats")
    assert pipelines.corpus(spark, *books, splits, str(tmp_path))["stats"].count() == 2 and len(asked) == 1
    other = spark.createDataFrame([("book0", "test")], "book string, split string")
    renewed = pipelines.corpus(spark, *books, other, str(tmp_path))["pairs"]
    assert len(asked) == 2 and {r["split"] for r in renewed.select("split").distinct().collect()} == {"test", "unassigned"}


def test_only_changed_books(spark, tmp_path, monkeypatch):
    """One changed book is aligned alone, one taken away goes, and a commit that did not end is not seen."""
    raw, fixed = tmp_path / "raw", tmp_path / "fixed"
    raw.mkdir(), fixed.mkdir()
    for k, (n, c) in enumerate(zip(NOISY, CLEAN, strict=True)):
        (raw / f"book{k}_ocr_raw.txt").write_text(n, encoding="utf-8")
        (fixed / f"book{k}_corrected.txt").write_text(c, encoding="utf-8")
    splits = spark.createDataFrame([("book0", "train")], "book string, split string")
    aligned, asked = pipelines.alignment, []
    monkeypatch.setattr(pipelines, "alignment", lambda books, *a: asked.append(sorted(r["book"] for r in books.select("book").collect())) or aligned(books, *a))
    go = lambda: pipelines.corpus(spark, str(raw), str(fixed), splits, str(tmp_path / "out"))
    assert go()["pairs"].count() == 6 and go()["pairs"].count() == 6 and asked == [["book0", "book1"]]
    (raw / "book1_ocr_raw.txt").write_text(NOISY[1] + " Уште една реченица стои тука.", encoding="utf-8")
    (fixed / "book1_corrected.txt").write_text(CLEAN[1] + " Уште една реченица стои тука.", encoding="utf-8")
    out = go()
    assert asked[1:] == [["book1"]] and out["pairs"].count() == 7 and out["stats"].count() == 2
    assert out["documents"].count() == 2
    lost = next((tmp_path / "out" / "books" / "provenance").glob("run=r00000001*"))
    (lost / "_SUCCESS").unlink()
    assert pipelines.published.read(spark, str(tmp_path / "out" / "books"), "pairs", list(pipelines.ALIGNED)).count() == 6
    (lost / "_SUCCESS").touch()
    (raw / "book0_ocr_raw.txt").unlink()
    assert go()["pairs"].count() == 4 and go()["stats"].count() == 1


def test_synthetic(spark):
    texts = spark.createDataFrame([("b", "Една реченица тука. Друга реченица.\n\nНов пасус е ова.")], "book string, clean string")
    counts = spark.createDataFrame([("а", "a", 3), ("е", "c", 2)], "clean string, noisy string, n long")
    rates = dict(p_del=0.02, p_sub=0.1, p_ins=0.02, p_diacritic=0.1, p_homoglyph=0.1, p_punctuation=0.1, p_merge=0.1, p_split=0.1)
    made = pipelines.synthetic_corpus(texts, counts, rates, "абв")
    assert {r["generator"]: r["count"] for r in made.groupBy("generator").count().collect()} == {"random_edit": 3, "confusion_matrix": 3, "structure_aware": 3}


def test_predictions(spark):
    rows = spark.createDataFrame([("d", "train", "prose", f"s{i}", i, "sentence", n, c, "real") for i, (n, c) in enumerate([("the cat sot", "the cat sat"), ("the cat sat", "the cat sat"), ("a cat", "a cat")])], tables.MANIFEST)
    confusions = spark.createDataFrame([("a", "o", 5), ("a", "a", 50)], "clean string, noisy string, n long")
    got = pipelines.predictions(rows, rows, confusions)
    base = pipelines.identity(rows)
    assert got.count() == base.count() == 3
    tagged = got.withColumn("model", F.lit("classical")).withColumn("regime", F.lit("real_only"))
    both = tagged.unionByName(base.withColumns({"model": F.lit("identity"), "regime": F.lit("real_only")}), allowMissingColumns=True)
    row = reports.significance_table(both, resamples=50).first()
    assert (row["system"], row["vs_baseline"], row["n"]) == ("classical", "identity", 3)
    # another sample in place of one of the baseline's: as many rows, but not the same ones
    other = both.withColumn("sample_id", F.when((F.col("model") == "identity") & (F.col("sample_id") == "s1"), "else").otherwise(F.col("sample_id")))
    assert reports.significance_table(other, resamples=50) is None


def test_verified_write(spark, tmp_path):
    assert tables.write_verified(spark.range(5), str(tmp_path / "x"), "parquet") == 5


def test_stream(spark, tmp_path):
    from glyphlake.streaming import flow

    rows = [("p1", "d", "2024-01-01 00:01:00", "abc", "abd"), ("p1", "d", "2024-01-01 00:01:00", "abc", "abd"), ("p2", "d", "2024-01-01 00:02:00", "xy", "xy"), ("p3", "d", "2024-01-02 00:00:00", "q", "q")]
    spark.createDataFrame(rows, "page_id string, doc_id string, ts string, noisy string, clean string").write.json(str(tmp_path / "in"))
    stream = flow.windowed_errors(flow.cleaned(flow.pages(spark, str(tmp_path / "in"))))
    flow.run(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("start < '2024-01-01 12:00'").first()
    assert (got["errors"], got["ref_total"], got["pages"]) == (1, 5, 2)
