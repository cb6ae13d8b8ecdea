"""Readers with counts, alignment rows from one table function, documents of three sets, cross-validation by stages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import edits
from glyphlake.operators import boundary, confusion, scripts
from glyphlake.plans import kfold, pipelines
from glyphlake.sources import published, readers

PAIRS = [(1, "вокуќа е тука", "во куќа е тука"), (2, "abc", "abc"), (3, "", "x"), (4, None, "y"), (5, "", ""), (6, "кни гата", "книгата"), (7, "a b", "a c")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id int, noisy string, clean string").withColumn("_noisy2", F.lit("clash"))


def same(a, b):
    key = lambda r: tuple(map(str, r))
    return sorted(map(key, a.select(sorted(a.columns)).collect())) == sorted(map(key, b.select(sorted(b.columns)).collect()))


def test_alignment_rows(spark, pairs):
    rows = scripts.alignment_rows(pairs, ["id"])
    for level in ("char", "word"):
        assert same(scripts.edit_rows(rows, ["id"], level), confusion.edits(pairs, ["id"], level))
    assert same(scripts.boundary_rows(rows, ["id"]), boundary.boundary_table(pairs, ["id"]))
    assert scripts.boundary_rows(rows, ["id"]).count() == 2
    assert scripts.alignment_rows(pairs.limit(0), ["id"]).count() == 0


def test_document_cells(spark, pairs):
    cells = scripts.document_cells(pairs, ["id"])
    totals = {r["id"]: tuple(r)[1:] for r in scripts.document_totals(cells, ["id"]).collect()}
    want = {i: edits.edit_counts(c, n) for i, n, c in PAIRS if n is not None and (n or c)}
    assert totals == want
    got = {(r["clean"], r["noisy"]): r["n"] for r in scripts.document_confusions(cells).collect()}
    assert got == {(" ", "<DEL>"): 1, ("<INS>", " "): 1, ("c", "b"): 1, ("x", "<DEL>"): 1}


def test_three_sets(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, text string")
    both, report = scripts.three_sets(make([("a", "1"), ("b", "2"), (None, "x"), ("c", None)]), make([("a", "3"), ("a", "4")]), make([("a", "5"), ("b", "6"), ("c", "7")]), "k")
    assert [tuple(r) for r in both.collect()] == [("a", "1", "4", "5")]
    assert {tuple(r) for r in report.collect()} == {(True, True, True, 1), (True, False, True, 1), (False, False, True, 1)}
    empty = make([])
    assert [x.count() for x in scripts.three_sets(empty, empty, empty, "k")] == [0, 0]


def test_readers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.real_pairs(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        readers.synthetic_pairs(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        readers.document_index(spark, str(tmp_path))
    rows = {"d1": [(" same ", "same"), ("", ""), (None, "x"), ("qqqqqqqq", "abcdefgh"), ("abcdef", "abc"), ("wrod here", "word here")], "d2": [("a b", "a b"), ("helo", "hello")]}
    for doc, listed in rows.items():
        home = tmp_path / "split=train" / f"doc_id={doc}"
        home.mkdir(parents=True)
        (home / "matched_pairs.json").write_text(json.dumps([{"noisy": n, "clean": c} for n, c in listed]))
        if doc == "d1":
            (home / "char_ops.json").write_text(json.dumps([{"op": "match"}] * 3))
        (tmp_path / f"{doc}_pairs.jsonl").write_text("\n".join(json.dumps({"noisy": n, "clean": c}) for n, c in listed) + "\n\n")
    judged = readers.judged(readers.real_pairs(spark, str(tmp_path)))
    want = {"d1": (6, 1, 2, 1, 1, 1), "d2": (2, 1, 1, 0, 0, 0)}
    assert {r["doc_id"]: tuple(r)[1:] for r in readers.fates(judged, ["doc_id"]).collect()} == want
    assert readers.store(spark, judged, str(tmp_path / "out"), "real") == {"kept": 2, "equal": 3, "empty": 1, "lengths": 1, "unlike": 1}
    assert spark.read.parquet(str(tmp_path / "out" / "real")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "drops")).first()["unlike"] == 1
    assert {r["doc_id"]: tuple(r)[1:] for r in readers.fates(readers.judged(readers.synthetic_pairs(spark, str(tmp_path))), ["doc_id"]).collect()} == want
    report = {r["doc_id"]: r for r in readers.pair_report(judged.filter("fate = 'kept'")).collect()}
    assert report["d2"]["median"] == report["d2"]["mean"] == pytest.approx(edits.ratio("helo", "hello"))
    index = readers.document_index(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["char_ops"], r["word_ops"], r["matched_pairs"]) for r in index] == [("d1", 3, 0, 6)]


def test_pair_fates_of_odd_texts(spark, tmp_path):
    """Halves in a quarter of a length, and white space that the SQL does not take as such."""
    import duckdb

    from glyphlake import queries as Q

    texts = [None, "", " ", "A.", "é", "abcdef", "  ab  ", "\u00a0", "\u00a0a\u2028", "\x0b \x0b", "a" * 10 + "\u2003" * 30, "line\r\n", "\x1c\x85", "x \u2029"]
    rows = [(6 * k + kind, "en" if kind % 2 else "de", t) for k, t in enumerate(texts) for kind in range(6)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(Q.oracle_sql()["pair_fates"]).fetchall()
    assert sorted(map(tuple, Q.queries()["pair_fates"](spark, str(tmp_path)).collect())) == sorted(want)


def test_upper_median(spark):
    rows = spark.createDataFrame([("d", "abcd"[:k] + "x" * (4 - k), "abcd") for k in range(4)], "doc_id string, noisy string, clean string")
    assert readers.pair_report(rows).first()["median"] == 0.5


def test_stage_goes_back(spark, tmp_path):
    """A stage whose content goes to something else and back has the table of its content each time."""
    made = []
    at = lambda n: pipelines.stage(spark, str(tmp_path), "t", {"n": n}, lambda: made.append(n) or spark.range(n)).count()
    assert [at(2), at(3), at(2)] == [2, 3, 2] and made == [2, 3]


def test_published(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "book string, digest string")
    folder = str(tmp_path / "p")
    assert published.latest(spark, folder, ["t"]) is None
    with pytest.raises(FileNotFoundError):
        published.read(spark, folder, "t", ["t"])
    first = make([("a", "1"), ("b", "1"), (None, "1")])
    published.commit(spark, folder, {"t": make([("a", "x"), ("b", "y")])}, published.pending(first, None))
    second = published.pending(make([("a", "2")]), published.latest(spark, folder, ["t"]))
    assert {tuple(r) for r in second.collect()} == {("a", "2"), ("b", None)}
    published.commit(spark, folder, {"t": make([("a", "z")])}, second)
    assert [tuple(r) for r in published.read(spark, folder, "t", ["t"]).collect()] == [("a", "z")]
    assert published.pending(make([("a", "2")]), published.latest(spark, folder, ["t"])).count() == 0


def test_kfold(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"d{d}", f"d{d}-{s}", "".join(rng.choice("abcd ") for _ in range(12)), "abcd abcd abc") for d in range(12) for s in range(3)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id string, sample_id string, noisy string, clean string")
    made = []

    def constant(train, test, **_):
        made.append("constant")
        best = train.groupBy("clean").count().orderBy(F.desc("count"), "clean").first()["clean"]
        return pipelines.measured(test.withColumnRenamed("noisy", "input_noisy").withColumn("prediction", F.lit(best)))

    def identity(test):
        made.append("identity")
        return pipelines.identity(test)

    systems = {"constant": kfold.System(constant, ("train", "test")), "identity": kfold.System(identity, ("test",))}
    go = lambda rows, systems=systems: kfold.run(spark, str(tmp_path), table(rows), systems, k=3)
    out = go(rows)
    assert out.filter("model = 'identity'").count() == len(rows) and len(made) == 6
    report = {r["model"]: r for r in kfold.summary(out).collect()}
    assert report["constant"]["mean_cer_mean"] == 0.0 and report["identity"]["mean_cer_mean"] > 0 and report["identity"]["n_folds"] <= 3
    go(list(reversed(rows)))
    assert len(made) == 6  # nothing depends on order
    changed = [(*rows[0][:2], "abcd abcd", rows[0][3]), *rows[1:]]
    go(changed)
    assert made[6:].count("identity") == 1  # the one fold that tests the document
    assert made[6:].count("constant") == 2  # and the one that trains on it; in the third it is for validation, which this system does not read
    before = len(made)
    go(changed, {**systems, "constant": kfold.System(constant, ("train", "test"), {"version": 2})})
    assert made[before:] == ["constant"] * 3
