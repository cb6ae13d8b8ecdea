"""Edit scripts of two sequences and the measures taken from them.

The scripts are those of difflib's opcodes, which are not minimal edits; `autojunk` is difflib's own rule for long sequences. A replaced
block pairs its elements one by one; what the noisy side has over is an insertion, what the clean side has over a deletion.
Functions named `*_udf` are Arrow-batched; the rest of the library calls them on sentences, never on whole documents.
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("op", "noisy", "clean")]))
COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("match", "sub", "del", "ins")])
ROWS = T.StructType([T.StructField("level", T.StringType()), T.StructField("op_pos", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("op", "noisy", "clean")]])


def edit_ops(noisy, clean, autojunk: bool = True) -> list[tuple[str, str, str]]:
    """(op, noisy element, clean element) with '' on a missing side."""
    out: list[tuple[str, str, str]] = []
    for tag, a, b, c, d in SequenceMatcher(None, noisy, clean, autojunk).get_opcodes():
        paired = min(b - a, d - c)
        out += [("match" if tag == "equal" else "substitution", noisy[a + k], clean[c + k]) for k in range(paired)]
        out += [("insertion", x, "") for x in noisy[a + paired : b]]
        out += [("deletion", "", x) for x in clean[c + paired : d]]
    return out


def edit_counts(reference, hypothesis, autojunk: bool = True) -> tuple[int, int, int, int]:
    """match, substitution, deletion, insertion against a reference that stands first."""
    match = sub = deleted = inserted = 0
    for tag, a, b, c, d in SequenceMatcher(None, reference, hypothesis, autojunk).get_opcodes():
        paired = min(b - a, d - c)
        if tag == "equal":
            match += paired
        else:
            sub += paired
            deleted += b - a - paired
            inserted += d - c - paired
    return match, sub, deleted, inserted


def error_rate(reference, hypothesis, autojunk: bool = True) -> float:
    match, sub, deleted, inserted = edit_counts(reference, hypothesis, autojunk)
    return (sub + deleted + inserted) / max(match + sub + deleted, 1)


#: Pairs of equal characters that `ratio` lists at most; beyond, difflib goes through them without a list.
LISTED = 100_000


def ratio(a: str, b: str, autojunk: bool = True) -> float:
    """difflib's ratio. Runs of two equal characters or more are listed once, longest first, and the parts between blocks choose from what lies in them.

    A part without such a run takes its first pair of equal characters, which is found where it begins.
    """
    if a == b:
        return 1.0
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    if autojunk and len(b) >= 200:
        places = {c: at for c, at in places.items() if len(at) <= len(b) // 100 + 1}
    if sum(len(at) * a.count(c) for c, at in places.items()) > LISTED:
        return SequenceMatcher(None, a, b, autojunk).ratio()
    runs, last = [], {}  # (-length, start in a, start in b), at full length; length by last place in b
    for i, c in enumerate(a):
        at = places.get(c)
        if at or last:
            grown = {j: last.pop(j - 1, 0) + 1 for j in at or ()}
            runs += [(-n, i - n, j - n + 1) for j, n in last.items() if n > 1]
            last = grown
    runs += [(-n, len(a) - n, j - n + 1) for j, n in last.items() if n > 1]
    runs.sort()
    found, left = 0, [(0, len(a), 0, len(b), runs)]
    while left:
        a_low, a_high, b_low, b_high, inside = left.pop()
        size, i, j = 1, a_low, b_low
        for n, x, y in inside:
            if -n < size:
                break
            skip = max(a_low - x, b_low - y, 0)
            here = min(-n, a_high - x, b_high - y) - skip
            if here > size or (here == size > 1 and (x + skip, y + skip) < (i, j)):
                size, i, j = here, x + skip, y + skip
        if size == 1:
            size = 0
            for x in range(a_low, a_high):
                at = places.get(a[x], ())
                k = bisect_left(at, b_low)
                if k < len(at) and at[k] < b_high:
                    size, i, j = 1, x, at[k]
                    break
        x, y = i + size, j + size
        while i > a_low and j > b_low and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while x < a_high and y < b_high and a[x] == b[y]:
            x, y = x + 1, y + 1
        if x > i:
            found += x - i
            if i > a_low and j > b_low:
                left.append((a_low, i, b_low, j, [r for r in inside if r[1] < i and r[2] < j]))
            if x < a_high and y < b_high:
                left.append((x, a_high, y, b_high, [r for r in inside if r[1] - r[0] > x and r[2] - r[0] > y]))
    return 2.0 * found / (len(a) + len(b))


def normalized(token: str, underscore: bool = True) -> str:
    return "".join(c for c in token.strip().lower() if c.isalnum() or (underscore and c == "_"))


def token_similarity(a: str, b: str, underscore: bool = True) -> float:
    """Ratio of the normalized tokens; two empty ones are equal, one empty one shares nothing."""
    x, y = normalized(a, underscore), normalized(b, underscore)
    if not x or not y:
        return float(x == y)
    return 1.0 if x == y else ratio(x, y)


def chrf(reference: str, hypothesis: str, orders: int = 6, beta: float = 2.0) -> float:
    """Mean over the orders of the F score of character n-grams; a text shorter than the order is one n-gram."""
    from collections import Counter

    if not reference or not hypothesis:
        return float(reference == hypothesis)
    total = 0.0
    for n in range(1, orders + 1):
        r, h = (Counter([t[i : i + n] for i in range(len(t) - n + 1)] or [t]) for t in (reference, hypothesis))
        both = sum((r & h).values())
        if both:
            p, q = both / sum(h.values()), both / sum(r.values())
            total += (1 + beta**2) * p * q / (beta**2 * p + q)
    return total / orders


@F.pandas_udf(OPS)
def char_ops_udf(noisy: pd.Series, clean: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edit_ops(a, b) for a, b in zip(noisy, clean, strict=True)])


@F.pandas_udf(OPS)
def word_ops_udf(noisy: pd.Series, clean: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edit_ops(a.split(), b.split()) for a, b in zip(noisy, clean, strict=True)])


@F.pandas_udf(COUNTS)
def char_counts_udf(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_counts(a or "", b or "") for a, b in zip(reference, hypothesis, strict=True)], columns=["match", "sub", "del", "ins"])


@F.pandas_udf(COUNTS)
def word_counts_udf(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_counts((a or "").split(), (b or "").split()) for a, b in zip(reference, hypothesis, strict=True)], columns=["match", "sub", "del", "ins"])


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def token_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_similarity(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def chrf_udf(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else chrf(x, y) for x, y in zip(reference, hypothesis, strict=True)])


def rate(counts: Column) -> Column:
    """Error rate from a struct of counts."""
    return (counts["sub"] + counts["del"] + counts["ins"]) / F.greatest(counts["match"] + counts["sub"] + counts["del"], F.lit(1))


def cer(reference: Column, hypothesis: Column) -> Column:
    return rate(char_counts_udf(reference, hypothesis))


def wer(reference: Column, hypothesis: Column) -> Column:
    return rate(word_counts_udf(reference, hypothesis))


def cer_levenshtein(reference: Column, hypothesis: Column) -> Column:
    """From the least number of edits; stays in the JVM."""
    return F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))


def capped_distance(a: Column, b: Column, cap: int) -> Column:
    """Edit distance, or cap + 1 where it is over the cap."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, F.lit(cap + 1)).otherwise(d)


def reduction(before: Column, after: Column) -> Column:
    """Share of errors taken away, from -1 to 1."""
    none = F.abs(before) < 1e-12
    return F.when(none & (F.abs(after) < 1e-12), F.lit(0.0)).when(none, F.lit(-1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(before - after, before))))


def good_pair(noisy: Column, clean: Column, min_ratio: float = 0.5, max_delta: float = 0.5) -> Column:
    delta = F.abs(F.length(noisy) - F.length(clean)) / F.greatest(F.length(clean), F.lit(1))
    return (delta <= max_delta) & (ratio_udf(noisy, clean) >= min_ratio)


class EditOps:
    """Table function edit_ops(noisy, clean): one row per edit, level char or word; for LATERAL joins in SQL."""

    def eval(self, noisy: str, clean: str):
        if noisy is not None and clean is not None:
            for level, a, b in (("char", noisy, clean), ("word", noisy.split(), clean.split())):
                for at, (op, x, y) in enumerate(edit_ops(a, b)):
                    yield level, at, op, x, y


edit_ops_udtf = F.udtf(EditOps, returnType=ROWS)
