"""Operators against hand-made cases and their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from glyphlake.functions.edits import token_similarity
from glyphlake.operators import align, boundary, confusion, manifest, metrics, models, noise, realism


def test_merge_and_split():
    (m,) = boundary.boundary_errors("вокуќа", "во куќа")
    assert (m["type"], m["similarity"]) == ("merge", 1.0)
    (s,) = boundary.boundary_errors("кни гата е тука", "книгата е тука")
    assert (s["type"], s["noisy"]) == ("split", ["кни", "гата"])
    assert boundary.boundary_errors("", "a b") == [] and boundary.boundary_errors("a b", "a b") == []


def _cheapest(a, b):
    """Cost of the cheapest of all paths, by a recursion that knows no band and no bounds."""
    from functools import lru_cache

    @lru_cache(None)
    def go(i, j):
        best = 0.0 if (i, j) == (len(a), len(b)) else float("inf")
        for x, y, kind in boundary.MOVES:
            if i + x <= len(a) and j + y <= len(b):
                c = boundary._cost(kind, list(a[i : i + x]), list(b[j : j + y]), boundary.Similarities())
                if c is not None:
                    best = min(best, c + go(i + x, j + y))
        return best

    return go(0, 0)


def test_path_is_cheapest():
    rng = random.Random(5)
    words = ["ab", "cd", "efg", "a", "книга", "кни", "гата", "hello", "world", "wor", "ld", "x1", "!"]
    for _ in range(150):
        clean = [rng.choice(words) for _ in range(rng.randrange(1, 14))]
        noisy = " ".join(clean)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(noisy) + 1)
            noisy = noisy[:k] + rng.choice([" ", "", "q"]) + noisy[k + rng.randrange(2) :]
        a = noisy.split()
        if a:
            cost, moves = boundary.cheapest_path(a, clean)
            assert cost == pytest.approx(_cheapest(tuple(a), tuple(clean)), abs=1e-6)
            assert moves[-1][:2] == (len(a), len(clean))
            assert [e["type"] for e in boundary.boundary_errors(noisy, " ".join(clean))] == [k for *_, k in moves if k in ("merge", "split")]


def test_path_far_off_the_diagonal():
    """Twenty words that only one side has: the band has to grow."""
    clean = [f"word{k}" for k in range(30)]
    noisy = [f"other{k}x" for k in range(20)] + clean
    assert boundary.cheapest_path(noisy, clean)[0] == pytest.approx(_cheapest(tuple(noisy), tuple(clean)), abs=1e-6)


def test_alignment_is_best():
    """The score of the pairs and gaps found is that of the best of all paths in the band."""
    from functools import lru_cache

    rng = random.Random(6)
    stock = ["The first sentence is here.", "A second one follows it.", "And then there is a third.", "Nothing like the others", "short", "", "The first sentence is there."]

    def alike(a, b):
        (got,) = align._similarities([a], [b], [(0, 0)])
        return got.get(0, 0.0)

    for _ in range(60):
        noisy, clean = ([rng.choice(stock) for _ in range(rng.randrange(1, 8))] for _ in "ab")
        m, n = len(noisy), len(clean)
        wide = min(0.4, 0.10 + 0.5 * abs(1 - m / n))

        @lru_cache(None)
        def go(i, j, noisy=tuple(noisy), clean=tuple(clean), wide=wide):
            if i == 0 or j == 0:
                return align.GAP * (i + j), ()
            if abs(i / len(noisy) - j / len(clean)) > wide + 1e-9:
                return float("-inf"), ()
            s, (d, path) = alike(noisy[i - 1], clean[j - 1]), go(i - 1, j - 1)
            ways = [(d + s if s >= align.MIN_DIAGONAL else float("-inf"), (*path, (i - 1, j - 1))), (go(i - 1, j)[0] + align.GAP, go(i - 1, j)[1]), (go(i, j - 1)[0] + align.GAP, go(i, j - 1)[1])]
            return max(ways, key=lambda w: w[0])

        score, path = go(m, n)
        want = [(noisy[i], clean[j]) for i, j in path] if score > float("-inf") else list(zip(noisy, clean, strict=False))
        got = align.aligned(noisy, clean, min_pair=0.0)
        assert [(a, b) for a, b, _ in got] == want


def test_greedy():
    assert boundary.greedy_counts("hello wor ld", "hello world") == (1, 0)
    assert boundary.greedy_counts("helloworld now", "hello world now") == (0, 1)
    assert token_similarity("", "") == 1.0 and token_similarity("a", "!") == 0.0


def test_alignment():
    clean = ["The first sentence is here.", "A second one follows it.", "And then there is a third."]
    noisy = ["The frst sentence is here.", "And then there is a thlrd."]
    assert [c for _, c, _ in align.aligned(noisy, clean)] == [clean[0], clean[2]]
    assert align.aligned([], clean) == []


def test_rows_sum_to_one(spark):
    ops = spark.createDataFrame([("match", "a", "a"), ("substitution", "b", "a"), ("deletion", "", "a"), ("insertion", "x", "")], "op string, noisy string, clean string")
    p = confusion.probabilities(confusion.confusion(ops)).groupBy("clean").agg(F.sum("p").alias("s"))
    assert all(r["s"] == pytest.approx(1.0) for r in p.collect())
    d = confusion.error_distribution(ops).first()
    assert (d["total_ops"], d["match_pct"]) == (4, 25.0)
    assert confusion.matrix(confusion.confusion(ops)).count() == 2


def js(spark, p, q):
    a, b = (spark.createDataFrame(list(x.items()), "k string, n double") for x in (p, q))
    return realism.js_divergence(a, b, "k").first()["js"]


def test_divergence(spark):
    assert js(spark, {"s": 0.5, "d": 0.5}, {"s": 0.25, "d": 0.75}) == pytest.approx(0.048795, abs=1e-6)
    assert js(spark, {"a": 1.0}, {"b": 1.0}) == pytest.approx(1.0)
    assert js(spark, {"a": 1.0}, {"a": 3.0}) == pytest.approx(0.0, abs=1e-9)


def test_noise(spark):
    df = spark.createDataFrame([(1, "some text here"), (2, ""), (3, None)], "id int, text string")
    same = noise.noised(df, "id", "text", noise.uniform("xyz"), 0, 0, 0)
    assert {r["id"]: r["noisy"] for r in same.collect()} == {1: "some text here", 2: "", 3: ""}
    a, b = (sorted(map(tuple, noise.noised(d, "id", "text", noise.uniform("xyz"), 0.1, 0.3, 0.1).collect()), key=str) for d in (df, df.repartition(3)))
    assert a == b


def test_folds(spark):
    docs = spark.createDataFrame([(i,) for i in range(60)], "doc long")
    f = manifest.folds(docs, "doc", 5)
    assert f.filter("split = 'test'").select("doc").distinct().count() == 60 and f.filter("split = 'test'").count() == 60
    assert manifest.overlap(f, "doc").count() == 0
    with pytest.raises(ValueError):
        manifest.folds(docs, "doc", 1)


def test_manifest(spark):
    assert manifest.repetitions(1000, 100, 4) == 2
    pairs = spark.createDataFrame([("d1", 0, "a b", "a c"), ("d1", 1, "x", "x")], "doc_id string, pos int, noisy string, clean string")
    splits = spark.createDataFrame([("d1", "train")], "doc_id string, split string")
    domains = spark.createDataFrame([("d1", "prose")], "doc_id string, subset_domain string")
    m = manifest.manifest(pairs, splits, domains, "real")
    assert m.count() == 1 and tuple(m.columns) == manifest.COLUMNS
    assert {r["sample_id"] for r in manifest.oversampled(m, 3).collect()} == {"real-d1-0", "real-d1-0__dup1", "real-d1-0__dup2"}
    with pytest.raises(Exception, match="no split"):
        manifest.manifest(pairs, splits.filter("false"), domains, "real").collect()


def test_calibration_edges(spark):
    r = spark.createDataFrame([(1.0, 1.0), (0.1, 0.0), (-3.0, 0.0)], "c double, ok double")
    b = {x["bin"]: x["n"] for x in metrics.calibration_bins(r, "c", "ok").collect()}
    assert len(b) == 10 and (b[9], b[1], b[0]) == (1, 1, 1)


def test_latency(spark):
    r = metrics.latency(spark.range(1, 21).select(F.col("id").cast("double").alias("ms"))).first()
    assert (r["median_ms"], r["p95_ms"]) == (11.0, 20.0)


def test_bootstrap_empty(spark):
    assert metrics.bootstrap(spark.createDataFrame([], "sample_id long, delta double")).first()["p"] == 1.0


def test_best_cell_and_threshold(spark):
    cells = spark.createDataFrame([(0, 0.2, 0.5), (1, 0.1, 0.5), (2, 0.1, 0.2), (3, 0.3, 0.0)], "cell int, mean_cer double, change_rate double")
    assert metrics.best_cell(cells)["cell"] == 2
    sweep = spark.createDataFrame([(0.1, 0.05, 0.1, 0.5, 0.5), (0.2, 0.06, 0.1, 0.5, 0.0)], "threshold double, mean_cer double, mean_input_cer double, kept_share double, overcorrection double")
    assert metrics.chosen_threshold(sweep, 0.1, 0.1) == 0.2


def test_kneser_ney_sums_to_one(spark):
    texts = spark.createDataFrame([("a b a c",), ("b a b",)], "text string")
    counts = models.word_counts(texts, order=2)
    words = counts[1].select("w").distinct()
    q = counts[2].select("ctx").distinct().crossJoin(words)
    s = models.kneser_ney(counts, q).groupBy("ctx").agg(F.sum("p").alias("s"))
    assert all(r["s"] <= 1 + 1e-9 for r in s.collect())


def test_beam_keeps_clean_text():
    lm = models.BackOff([([], "the", 5), ([], "cat", 5), (["<bos>"], "the", 5), (["the"], "cat", 5), (["cat"], "<eos>", 5)])
    best = models.beam(["the", "cot"], {"cot": [("cot", -5.0), ("cat", -1.0)]}, lm, {})
    assert best[0][1] == ["the", "cat"] and best[-1][1] == ["the", "cot"]
    assert models.channel_logp("cot", "cat", {("a", "o"): -0.5}) == -0.5


def test_all_swaps_give_candidates(spark, monkeypatch):
    """Every observed confusion is swapped, also the frequent ones whose probability is low because their letter is frequent."""
    from glyphlake.plans import error_queries as queries

    taken = []
    monkeypatch.setattr(queries.models, "candidates", lambda types, lex, swaps, *a: taken.append(swaps))
    *_, channel = queries._corrector(spark, "/root/testdata/sf0.001")
    swaps, seen = taken[0], channel.select("noisy", "hyp").distinct()
    assert seen.count() > 20 and seen.join(swaps, ["noisy", "hyp"], "left_anti").count() == 0
    monkeypatch.undo()
    types = spark.createDataFrame([("abca",)], "word string")
    lex = spark.createDataFrame([], "word string, n long, len int")
    made = models.candidates(types, lex, spark.createDataFrame([(x, y) for x in "abcd" for y in "xyz"], "noisy string, hyp string"), top=100)
    assert {r["cand"] for r in made.collect()} == {"abca"} | {"abca".replace(x, y) for x in "abc" for y in "xyz"}


def test_ratio_is_difflibs(monkeypatch):
    """Blocks are difflib's, popular characters of long texts included, and its own matcher is not asked where few characters are equal."""
    from difflib import SequenceMatcher

    from glyphlake.functions import edits

    rng = random.Random(9)
    for k in range(600):
        letters = ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz ", "ab" * 9 + "cdefghijk")[k % 4]
        b = "".join(rng.choices(letters, k=(0, 1, 3, 10, 40, 150, 199, 200, 260)[k % 9]))
        b = b[: len(b) // 3] * 3 if rng.random() < 0.2 else b
        a = "".join(c if rng.random() > 0.1 else rng.choice(letters + "!") * rng.randrange(3) for c in b)
        a = a[len(a) // 3 :] + a[: len(a) // 3] if rng.random() < 0.2 else a
        for junk in (True, False):
            assert edits.ratio(a, b, junk) == SequenceMatcher(None, a, b, junk).ratio()
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1500))
    noisy = "".join(c if rng.random() > 0.05 else "x" for c in long)
    want = SequenceMatcher(None, noisy, long).ratio()
    monkeypatch.setattr(edits, "LISTED", -1)
    assert edits.ratio(noisy, long) == want
    monkeypatch.undo()
    monkeypatch.setattr(edits, "SequenceMatcher", None)
    assert edits.ratio(noisy, long) == want


def test_similarities_by_pairs_and_by_index(monkeypatch):
    rng = random.Random(12)
    stock = ["The first sentence is here.", "A second one follows, it follows it.", "And then there is a third.", "short", "", "aaaaaaaaaa aaaaaaa", "The first sentence is there."]
    for _ in range(30):
        noisy, clean = ([rng.choice(stock) for _ in range(rng.randrange(1, 12))] for _ in "ab")
        rows = [(low := rng.randrange(len(clean)), rng.randrange(low - 1, len(clean))) for _ in noisy]
        got = []
        for narrow in (0, 16):
            monkeypatch.setattr(align, "NARROW", narrow)
            got.append(list(align._similarities(noisy, clean, rows)))
        assert got[0] == got[1]


def test_noise_shuffles_no_characters(spark):
    """Noise is made within the row, is that of the draws, and sentences without text are left out of alignment."""
    df = spark.createDataFrame([(1, "some text of a row"), (2, None), (None, "no key"), (3, ""), (4, "a\nb  c" * 9)], "id long, text string")
    made = noise.noised(df, "id", "text", noise.uniform("xyz"), 0.2, 0.2, 0.2)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    chars = noise.characters(df, "id", "text")
    draw = lambda salt: noise.draw(F.col("id"), F.col("pos"), F.lit(salt))
    first = F.when(draw("noise") < 0.2, "").when(draw("noise") < 0.4, noise.uniform("xyz")(F.col("c"), draw("noises"))).otherwise(F.col("c"))
    after = F.when(draw("noise+") < 0.2, noise.uniform("xyz")(F.col("c"), draw("noisei"))).otherwise("")
    want = {}
    for r in chars.filter("id is not null").select("id", "pos", F.concat(first, after).alias("o")).orderBy("id", "pos").collect():
        want[r["id"]] = want.get(r["id"], "") + r["o"]
    assert {r["id"]: r["noisy"] for r in made.collect()} == {2: "", None: "", 3: ""} | want
    rows = [(1, "noisy", 1, "A second one follows."), (1, "noisy", 0, "The frst one."), (1, "clean", 0, "The first one."), (1, "clean", 1, "A second one follows."), (1, "clean", 2, None), (2, "clean", 0, "alone"), (3, "noisy", 0, None)]
    got = align.sentence_pairs(spark.createDataFrame(rows, "doc_id long, side string, pos int, text string")).orderBy("doc_id", "pos").collect()
    assert [tuple(r)[:4] for r in got] == [(1, 0, "The frst one.", "The first one."), (1, 1, "A second one follows.", "A second one follows.")]
