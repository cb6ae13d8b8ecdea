from pyspark.sql import functions as F

from glyphlake.functions.profiles import MACEDONIAN
from glyphlake.operators import gates, models


def test_features(spark):
    rows = spark.createDataFrame([(1, "кућa"), (2, "куќа вода"), (3, "")], "id int, text string")
    lex = spark.createDataFrame([("вода", 3, 4)], "word string, n long, len int")
    counts = models.char_counts(lex)
    got = {r["id"]: r for r in gates.features(rows, "id", "text", counts, lex, profile=MACEDONIAN).collect()}
    assert got[1]["susp"] == 25.0 and got[1]["oov"] == 1.0
    assert got[2]["susp"] == 0.0 and got[2]["oov"] == 0.5 and got[3]["ppl"] == 0.0
    est = gates.estimated(gates.features(rows, "id", "text", counts, lex), 0.0, 1.0, [0.0, 0.0, 0.5, 0.0])
    assert {r["id"]: r["estimate"] for r in est.collect()} == {1: 0.5, 2: 0.25, 3: 0.0}


def scorer():
    return gates.CharScorer({g: 20 for w in ("^^^t", "^^th", "^the", "the ", "he c", "e ca", " cat") for g in [w]}, {("a", "o"): -0.1})


def test_edit_gate(spark):
    assert gates.gate_edits("the cat", "the cat", scorer())[1] == "identity"
    assert gates.gate_edits("the cot", "the cat", scorer()) == ("the cat", "kept_pred", 1, 0)
    assert gates.gate_edits("the cot", "the cat", scorer(), whitelist=frozenset())[1] == "reverted_to_input"
    assert gates.gate_edits("the cat", "the cot", scorer())[:2] == ("the cat", "reverted_to_input")
    df = spark.createDataFrame([("the cot", "the cat"), (None, None)], "n string, p string")
    held = scorer()
    assert [r["x"]["final"] for r in df.select(gates.edit_gate(lambda: held)("n", "p").alias("x")).collect()] == ["the cat", ""]


def test_grid_and_lists(spark):
    rows = spark.createDataFrame([(1.0, [(0.5, 0.1), (-0.5, -0.1)], 0.2)], "sentence_delta double, windows array<struct<delta: double, cer_gain: double>>, input_cer double")
    best = gates.margin_grid(rows, [0.0, 2.0], [-1.0, 0.0]).first()
    assert (best["margin"], best["edit_margin"], round(best["mean_cer"], 6)) == (0.0, 0.0, 0.1)
    c = spark.createDataFrame([("a", "o", 5), ("a", "a", 9), ("<INS>", "x", 4)], "clean string, noisy string, n long")
    assert [tuple(r) for r in gates.whitelist(c).collect()] == [("o", "a")]
    assert gates.both_directions(c.filter(F.col("n") == 5), "clean", "noisy").count() == 2


def test_margins_and_temperature(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1.0, [(0.5, 0.1), (nan, 0.9), (None, 0.9)], 0.2), (nan, [(9.0, 0.5)], 0.4), (0.0, [], 0.0)], "sentence_delta double, windows array<struct<delta: double, cer_gain: double>>, input_cer double")
    cells = {(r["margin"], r["edit_margin"]): round(r["mean_cer"], 9) for r in gates.margin_grid(rows, [0.0, 2.0], [0.0, 1.0]).collect()}
    assert cells == {(0.0, 0.0): round(0.5 / 3, 9), (0.0, 1.0): 0.2, (2.0, 0.0): 0.2, (2.0, 1.0): 0.2}
    assert gates.best_margins(rows, [0.0, 1.0], [0.0, 0.5])["edit_margin"] == 0.5 and gates.best_margins(rows, [0.0, 1.0], [0.0, 0.5])["margin"] == 1.0
    assert gates.best_margins(rows.limit(0)) == {}
    from glyphlake.operators.metrics import calibrated_temperature

    sure = spark.createDataFrame([([4.0, 0.0], 0)] * 6 + [([4.0, 0.0], 1)] * 4, "logits array<double>, target int")
    got = calibrated_temperature(sure)
    assert got["temperature"] == 2.5 and got["post_nll"] < got["pre_nll"] and got["post_ece"] < got["pre_ece"] and got["n_tokens"] == 10
    assert calibrated_temperature(sure.limit(0)) == {"temperature": 1.0, "n_tokens": 0}


def test_paragraph_chunks_by_a_loop(spark):
    import random

    from glyphlake.functions.text import paragraph_chunks

    r = random.Random(3)
    sentences, paragraphs, want = [], [], {}
    for g in range(12):
        s = [r.randint(0, 30) for _ in range(r.randint(1, 50))]
        p = [r.randint(0, 60) for _ in range(r.choice([3, 7, 8, 15, 40]))]
        sentences += [(g, i, "x" * n) for i, n in enumerate(s)]
        paragraphs += [(g, i, "y" * n) for i, n in enumerate(p)]
        ends = [sum(p[: i + 1]) - 1 for i in range(len(p))]
        chunk = at = total = 0
        for i, n in enumerate(s):
            want[g, i] = chunk if len(p) >= 8 else i // 20
            total += n
            closed = False
            while at < len(ends) and total >= ends[at]:
                closed, at = True, at + 1
            chunk += closed
    df = lambda rows: spark.createDataFrame(rows, "g int, i int, t string")
    got = {(x["g"], x["i"]): x["chunk"] for x in paragraph_chunks(df(sentences), df(paragraphs), "g", "i", "t").collect()}
    assert got == want


def test_names(spark):
    from glyphlake.sources.tables import resolved_names

    files = [("Book_corrected.txt",), ("old BOOK поправено.txt",), ("x_book_corrected.txt",), ("book.txt",), ("ab_corrected.txt",), (None,), ("",)]
    names = [("Book",), ("book",), ("ab",), ("b",), ("none",), (None,), ("",), ("Book",)]
    got = {r["name"]: (r["file"], r["rank"], r["matches"]) for r in resolved_names(spark.createDataFrame(names, "name string"), spark.createDataFrame(files, "file string")).collect()}
    assert got == {"Book": ("Book_corrected.txt", 0, 1), "book": ("Book_corrected.txt", 5, 3), "ab": ("ab_corrected.txt", 0, 1), "b": ("Book_corrected.txt", 5, 4)}
