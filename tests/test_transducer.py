"""The trained channel and its lattice against brute force over all paths and all texts."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.operators import transducer as X

PAIRS = [("abba", "aba"), ("ab", "ab"), ("", "b"), ("b", ""), ("cab", "kab"), ("abc", "abbc"), ("aab", "aab"), ("ca", "ac")]


def random_channel(seed=0, symbols="abc"):
    r = np.random.default_rng(seed)
    n = len(symbols) + 1
    sigma, iota = r.random((n, n + 1)), r.random(n)
    return X.Channel(list(symbols), sigma / sigma.sum(1, keepdims=True), 0.3 * iota / iota.sum())


def all_paths(ch, clean, noisy):
    """Every edit path: its probability, and what it did."""
    c, o = ch.numbers(clean), ch.numbers(noisy)
    on, none = 1.0 - ch.iota.sum(), ch.other + 1

    def walk(i, j):
        if i == len(c) and j == len(o):
            yield on, ()
        if j < len(o):
            yield from ((p * ch.iota[o[j]], ((none, o[j]), *x)) for p, x in walk(i, j + 1))
        if i < len(c):
            yield from ((p * on * ch.sigma[c[i], none], ((c[i], none), *x)) for p, x in walk(i + 1, j))
            if j < len(o):
                yield from ((p * on * ch.sigma[c[i], o[j]], ((c[i], o[j]), *x)) for p, x in walk(i + 1, j + 1))

    return list(walk(0, 0))


def test_path_sums_are_sums_over_all_paths():
    ch = random_channel()
    pairs = [*PAIRS, ("", ""), ("xyz", "yq")]
    weights = np.linspace(0.5, 2, len(pairs))
    like, counts = X.path_sums([ch.numbers(a) for a, _ in pairs], [ch.numbers(b) for _, b in pairs], ch.logs(), weights)
    top, _ = X.path_sums([ch.numbers(a) for a, _ in pairs], [ch.numbers(b) for _, b in pairs], ch.logs(), best=True)
    want = np.zeros_like(counts)
    for k, (a, b) in enumerate(pairs):
        paths = all_paths(ch, a, b)
        total = sum(p for p, _ in paths)
        assert math.isclose(like[k], math.log(total)) and math.isclose(top[k], math.log(max(p for p, _ in paths)))
        for p, did in paths:
            for c, o in did:
                want[c, o] += weights[k] * p / total
    assert np.allclose(counts, want)


def test_probabilities_of_noisy_texts_add_up():
    ch = random_channel(3, "ab")
    total = sum(math.exp(X.path_sums([ch.numbers("ab")], [np.array(o, np.int64)], ch.logs())[0][0]) for n in range(9) for o in itertools.product(range(3), repeat=n))
    assert 0.98 < total <= 1 + 1e-9


def test_bands_bound_from_below():
    ch = random_channel(1)
    r = np.random.default_rng(2)
    c, o = r.integers(0, 4, 60), r.integers(0, 4, 50)
    full = X.path_sums([c], [o], ch.logs())[0][0]
    banded = [X.path_sums([c], [o], ch.logs(), band=b)[0][0] for b in (12, 20, 40, 61)]
    assert all(a <= b + 1e-9 for a, b in itertools.pairwise([*banded, full])) and math.isclose(banded[-1], full)
    assert full - banded[1] < 1.0


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "clean string, noisy string")


def test_training_round_equals_brute_force(spark):
    start = random_channel(5)
    rows = frame(spark, [*PAIRS, (None, "a"), ("a", None)]).repartition(3)
    got, seen = X.trained(rows, start, rounds=1)
    counts, like = np.zeros((5, 5)), 0.0
    for a, b in PAIRS:
        paths = all_paths(start, a, b)
        total = sum(p for p, _ in paths)
        like += math.log(total)
        for p, did in paths:
            for c, o in did:
                counts[c, o] += p / total
    assert math.isclose(seen[0], like)
    rows_of = counts[:4].sum(1, keepdims=True)
    assert np.allclose(got.sigma, np.where(rows_of > 0, counts[:4] / np.maximum(rows_of, 1e-300), np.eye(4, 5)))
    assert np.allclose(got.iota, counts[4, :4] / (counts[4, :4].sum() + counts[:4].sum() + len(PAIRS)))


def noised(spark, n, swaps, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        clean = "".join(r.choice(list("abcde "), 20))
        noisy = "".join(swaps.get(c, c) if r.random() < 0.3 else "" if r.random() < 0.03 else c for c in clean)
        rows.append((clean, noisy))
    return frame(spark, rows)


def test_training_never_falls_and_finds_the_rates(spark):
    pairs = noised(spark, 300, {"a": "x", "b": "d"})
    ch, seen = X.trained(pairs, rounds=6)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(seen)) and seen[-1] > seen[0]
    at = ch.index
    assert 0.2 < ch.sigma[at["a"], at["x"]] < 0.4 and 0.2 < ch.sigma[at["b"], at["d"]] < 0.4 and ch.sigma[at["c"], at["c"]] > 0.9
    again = X.Channel.of(ch.table(spark))
    assert again.symbols == ch.symbols and np.allclose(again.sigma, ch.sigma) and np.allclose(again.iota, ch.iota)
    same, none = X.trained(pairs.limit(0), ch)
    assert np.allclose(same.sigma, ch.sigma) and none == [0.0]


def test_fine_tuning_moves_from_one_to_the_other(spark):
    synthetic, real = noised(spark, 200, {"a": "x"}, 1), noised(spark, 60, {"a": "y"}, 2)
    ch, before, after = X.fine_tuned(synthetic, real, rounds=5, weight=20.0)
    at = ch.index
    assert ch.sigma[at["a"], at["y"]] > 0.1 and ch.sigma[at["a"], at["y"]] > ch.sigma[at["a"], at["x"]]
    assert after[-1] > after[0]
    steps = X.trained(real, X.untrained(synthetic.union(real)), rounds=5, rate=X.RATE)[1]
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(steps))
    with pytest.raises(ValueError):
        X.of_regime("none", synthetic, real)


def test_lattice_equals_exhaustive_search():
    ch = random_channel(7)
    ch.sigma[0, 2] = 0.0
    model = X.CharModel({"\x02\x02a": 3, "\x02ab": 2, "aba": 1, "ab\x03": 2, "\x02\x02b": 1, "bab": 2, "ba\x03": 1, "\x02ba": 1, "cab": 1}, 3, 0.5, 4)
    lattice = X.Lattice(ch, model)
    texts = ["".join(t) for n in range(7) for t in itertools.product("abc", repeat=n)]
    for noisy in ("", "a", "ab", "cab", "bbb", "cacb"):
        scored = sorted(((lattice.path(noisy, t) + sum(lattice.written_chars(t)), t) for t in texts), key=lambda x: (-round(x[0], 9), x[1]))
        got = lattice.best(noisy, 5)
        assert np.allclose([s for _, s in got], [s for s, _ in scored[:5]])
        assert [t for t, _ in got] == [t for _, t in scored[:5]]
    assert [t for t, _ in X.Lattice(ch, X.CharModel({}, 1, 1.0, 4)).best("q", 1)] != []
    ch.sigma[:, 1], ch.iota[1] = 0.0, 0.0
    assert X.Lattice(ch, model).best("abc", 3) == [] and X.Lattice(ch, model).best("ac", 1) != []


def test_pruned_channel():
    ch = random_channel(3)
    small = ch.pruned(0.2)
    assert np.allclose(small.sigma.sum(1), 1) and ((small.sigma > 0) == (ch.sigma >= 0.2)).all() and small.symbols == ch.symbols


def test_corrected_with_logs(spark):
    pairs = noised(spark, 200, {"a": "x"})
    ch, _ = X.trained(pairs, rounds=4)
    words = spark.createDataFrame([("abba", 50), ("cab", 40), ("dead", 30), ("bed", 30)], "word string, n int")
    lattice = X.Lattice(ch, X.char_model(words))
    rows = [(1, "xbbx, cxb!  bed", False), (2, "bed", False), (3, None, False), (4, "xbbx", True), (5, "", False), (1, "cab", None)]
    df = spark.createDataFrame(rows, "id int, text string, skip boolean")
    got = sorted((r["id"], r["input"], r["prediction"], r["gate_decision"], r["confidence"]) for r in X.corrected_with_logs(df, "id", "text", lattice, skip="skip").collect())
    assert [g[:4] for g in got] == [(1, "cab", "cab", "identity"), (1, "xbbx, cxb!  bed", "abba, cab!  bed", "kept_pred"), (2, "bed", "bed", "identity"), (3, "", "", "identity"), (4, "xbbx", "xbbx", "headroom_skip"), (5, "", "", "identity")]
    assert all(0 < g[4] <= 1 for g in got)
    held = X.corrected_with_logs(df, "id", "text", lattice, margin=1e9).filter(F.col("input") != F.col("prediction")).count()
    assert held == 0 and X.corrected_with_logs(df.limit(0), "id", "text", lattice).count() == 0


def test_scorer_in_the_edit_gate(spark):
    from glyphlake.operators.gates import gate_edits

    ch, _ = X.trained(noised(spark, 200, {"a": "x"}), rounds=4)
    words = spark.createDataFrame([("abba", 50), ("cab", 40)], "word string, n int")
    scorer = X.LatticeScorer(X.Lattice(ch, X.char_model(words)))
    assert gate_edits("xbba", "abba", scorer)[:2] == ("abba", "kept_pred") and gate_edits("abba", "xbba", scorer)[0] == "abba"
    total, per_byte = scorer.score("cab", "cab")
    assert len(per_byte) == 3 and total < 0


def test_batches_by_length(spark):
    r = np.random.default_rng(1)
    rows = [(i, "x" * int(n)) for i, n in enumerate([*r.integers(0, 300, 400), 5000, *[7] * 200])] + [(700, None)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(4)
    got = X.in_batches(df, "t", 2000).select("id", "batch", "padded", F.coalesce(F.octet_length("t"), F.lit(0)).alias("size")).collect()
    assert sorted(g["id"] for g in got) == sorted(x[0] for x in rows)
    batches = {}
    for g in got:
        batches.setdefault(g["batch"], []).append(g)
    for b in batches.values():
        top = max(g["size"] for g in b)
        assert all(g["padded"] == top for g in b) and (len(b) == 1 or top * len(b) <= 2000) and all(2 * g["size"] > top or top <= 1 for g in b)
    assert len(batches) < 80
