"""Hand-made cases of the functions on text and edits."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.functions import edits, text
from glyphlake.functions.profiles import LATIN, MACEDONIAN


def one(spark, expr, *values):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols))
    return df.select(expr(*map(F.col, cols)).alias("x")).first()["x"]


def test_char_ops():
    assert [o for o, _, _ in edits.edit_ops("наиде", "најде")].count("match") == 4
    assert edits.error_rate("најде", "наиде") == pytest.approx(0.2)
    ops = edits.edit_ops("abcd", "abxyd")
    assert ("substitution", "c", "x") in ops and ("deletion", "", "y") in ops
    assert edits.error_rate("abxyd", "abcd") == pytest.approx(0.4)


def test_word_ops():
    a, b = "the cat sat".split(), "the bat sat on".split()
    assert [o for o, _, _ in edits.edit_ops(a, b)] == ["match", "substitution", "match", "deletion"]
    assert edits.error_rate(b, a) == pytest.approx(0.5)


def test_autojunk():
    r = random.Random(1)
    clean = "".join(r.choice("abcdefghijk") for _ in range(300))
    noisy = list(clean)
    for i in range(0, 300, 25):
        noisy[i] = "z"
    noisy = "".join(noisy)
    assert edits.error_rate(clean, noisy) > edits.error_rate(clean, noisy, autojunk=False) == pytest.approx(0.04)


def test_chrf():
    assert edits.chrf("abcd", "abxd") == pytest.approx(0.180556, abs=1e-6)
    assert edits.chrf("", "") == edits.chrf("abc", "abc") == 1.0
    assert edits.chrf("abc", "") == 0.0


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=40), st.text("abcd ", max_size=40))
def test_counts_add_up(a, b):
    match, sub, deleted, inserted = edits.edit_counts(a, b)
    assert match + sub + deleted == len(a) and match + sub + inserted == len(b)
    assert edits.error_rate(a, a) == 0


def test_reduction(spark):
    rows = spark.createDataFrame([(0.1, 0.25), (0.0, 0.0), (0.0, 0.1), (0.2, 0.1)], "a double, b double").select(edits.reduction(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in rows.collect()] == pytest.approx([-1.0, 0.0, -1.0, 0.5])


def test_capped_distance(spark):
    assert one(spark, lambda a, b: edits.capped_distance(a, b, 2), "abcdef", "uvwxyz") == 3
    assert one(spark, lambda a, b: edits.capped_distance(a, b, 2), "abc", "abd") == 1


@pytest.mark.parametrize("raw,want", [("Щука ёлка", "Шука олка"), ("Яна", "Јана"), ("a\tb", "ab")])
def test_sanitized(spark, raw, want):
    assert one(spark, text.sanitized, raw) == want


def test_segments(spark):
    assert one(spark, lambda t: text.segments(t, MACEDONIAN), "Еден. Два; Три? четири; пет") == ["Еден.", "Два;", "Три?", "четири; пет"]
    assert one(spark, text.sentences, "One.  Two…\nThree; Four") == ["One.", "Two…", "Three; Four"]


def test_garbage(spark):
    for line, bad in (("", True), (" x ", True), ("---", True), ("123", True), ("ab", False)):
        assert one(spark, text.is_garbage_line, line) is bad


def test_detokenized(spark):
    assert one(spark, lambda t: text.detokenized(text.tokens(t)), "Well, (yes) - no!") == "Well, (yes) - no!"


def test_case(spark):
    for s, t, want in (("ABC", "xyz", "XYZ"), ("Abc", "xyz", "Xyz"), ("abc", "XYZ", "xyz"), ("aBc", "xYz", "xYz")):
        assert one(spark, text.with_case_of, s, t) == want


def test_offsets_and_tokens(spark):
    assert one(spark, text.utf8_offsets, "aя🙂") == [0, 1, 3, 7]
    assert one(spark, lambda t: text.token_at(t, F.lit(5)), "some word") == "word"
    assert one(spark, lambda t: text.token_at(t, F.lit(4)), "some word") is None


def test_nulls(spark):
    for f in (text.sentences, text.tokens, text.without_dash_noise, text.sanitized):
        assert one(spark, f, None) is None


def test_cleaning_is_as_by_the_plain_patterns(spark):
    """Markers and letters are removed as by each pattern alone, also where texts end in runs of dashes and white space."""
    draw = random.Random(5)
    parts = ["-", "--", "---", "----", " ", "  ", "\n", "\n\n", "a", "ab c", "x" * 79, "y" * 85, "-- Page 3 --", "[Page 1]", "=== PAGE 2 ===", "Page 4", "\t", "\r\n", "ж😀"]
    letters = [*map(chr, range(0x20, 0x250)), *map(chr, range(0x370, 0x530)), "\n", "\u200b", "\ue000", "漢", "😀", "ꙮ", "𐐀", "\U000e0001"]
    rows = [("".join(draw.choices(parts, k=draw.randrange(8))), "".join(draw.choices(letters, k=40))) for _ in range(2000)] + [("".join(parts), "".join(letters)), (None, None), ("", "")]
    plain = F.col("a")
    for p in text.PAGE_MARKERS:
        plain = F.regexp_replace(plain, p, "")
    df = spark.createDataFrame(rows, "a string, b string")
    marked = F.lit(False)
    for p in text.PAGE_MARKERS:
        marked = marked | F.col("a").rlike(p)
    assert df.filter(~text.without_page_markers(F.col("a")).eqNullSafe(plain) | ~text.has_page_marker(F.col("a")).eqNullSafe(marked)).collect() == []
    for profile in (MACEDONIAN, LATIN):
        one_by_one = F.col("b")
        for a, b in profile.replacements:
            one_by_one = F.replace(one_by_one, F.lit(a), F.lit(b))
        one_by_one = F.regexp_replace(one_by_one, rf"\p{{C}}|[\p{{L}}&&[^{profile.letters}{profile.letters.upper()}A-Za-z]]", "")
        assert df.filter(~text.sanitized(F.col("b"), profile).eqNullSafe(one_by_one)).collect() == []


def test_cleaning_takes_time_in_proportion(spark):
    """Before, the last page marker was tried with 80 lengths at each place, and each letter asked for each of the profile's and replaced 38 times."""
    rows = spark.range(0, 16, 1, 4).select(F.concat(F.expr("repeat('some words of a long line ', 40000)"), F.lit(" -- Page 3 -- ---- end"), "id").alias("t"))

    def seconds(c):
        start = time.perf_counter()
        rows.select(F.sum(F.length(c))).collect()
        return time.perf_counter() - start

    whole = seconds(F.regexp_replace("t", "q", ""))
    assert seconds(text.without_page_markers(F.col("t"))) < 5 + 15 * whole
    assert seconds(text.sanitized(F.col("t"))) < 5 + 15 * whole
