"""Merged and split words: a shortest path over both token lists, and a greedy count."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.edits import normalized, token_similarity

# Costs of the path.
LONE, PAIR, TRIPLE = 0.92, 0.36, 0.46
JUNK_HEAD, SHORT_TAIL, TAIL_FLOOR, MIN_SIMILARITY = 0.62, 0.28, 0.93, 0.82
GREEDY = 0.78
#: The least cost of a token that one side has over: a merge or split of three tokens into one has two over.
SHIFT = min(LONE, PAIR, TRIPLE / 2)

ERRORS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("noisy", T.ArrayType(T.StringType())), T.StructField("clean", T.ArrayType(T.StringType())), T.StructField("similarity", T.DoubleType())]))
COUNTS = T.StructType([T.StructField("splits", T.IntegerType()), T.StructField("merges", T.IntegerType())])

#: Moves in the order in which they win ties: noisy tokens, clean tokens, kind.
MOVES = ((1, 3, "merge"), (3, 1, "split"), (1, 2, "merge"), (2, 1, "split"), (1, 0, "noisy only"), (0, 1, "clean only"), (1, 1, "pair"))


class Similarities:
    """Similarities of texts, and bounds on them that cost little; each text is normalized and counted once, each pair compared once."""

    def __init__(self):
        self.seen: dict[str, tuple[str, Counter]] = {}
        self.found: dict[tuple[str, str], float] = {}

    def of(self, text: str) -> tuple[str, Counter]:
        if text not in self.seen:
            plain = normalized(text)
            self.seen[text] = (plain, Counter(plain))
        return self.seen[text]

    def at_most(self, a: str, b: str, least: float = 0.0) -> float:
        """An upper bound: by the lengths, and where that does not fall below `least`, by the letters that both have."""
        if (a, b) in self.found:
            return self.found[a, b]
        (x, nx), (y, ny) = self.of(a), self.of(b)
        if not x or not y or x == y:
            return float(x == y)
        bound = 2.0 * min(len(x), len(y)) / (len(x) + len(y))
        return bound if bound < least else 2.0 * sum(min(n, ny[c]) for c, n in nx.items() if c in ny) / (len(x) + len(y))

    def __getitem__(self, pair: tuple[str, str]) -> float:
        if pair not in self.found:
            self.found[pair] = token_similarity(*pair)
        return self.found[pair]


def _cost(kind: str, noisy: list[str], clean: list[str], alike: Similarities, below: float = math.inf) -> float | None:
    """Of a move over these tokens; None if it is not allowed or can't be under `below`."""
    if kind in ("noisy only", "clean only"):
        return LONE
    pair = "".join(noisy), "".join(clean)
    if kind == "pair":
        return 1.0 - alike[pair] if 1.0 - alike.at_most(*pair, 1.0 - below) < below else None
    if alike.at_most(*pair, MIN_SIMILARITY) < MIN_SIMILARITY:
        return None
    s = alike[pair]
    if s < MIN_SIMILARITY:
        return None
    cost = 1.0 - s + (PAIR if len(noisy) + len(clean) == 3 else TRIPLE)
    if kind == "merge" and len(normalized(clean[-1])) <= 1 and s < TAIL_FLOOR:
        cost += SHORT_TAIL
    if kind == "split" and len(normalized(noisy[0])) <= 1:
        cost += JUNK_HEAD
    return cost


def _path(a: list[str], b: list[str], alike: Similarities, wide: int) -> tuple[float, list[tuple[int, int, str]]]:
    """Cost and moves of the cheapest path whose cells (i, j) have j - i from -wide to len(b) - len(a) + wide, or the other way round."""
    low, high = min(0, len(b) - len(a)) - wide, max(0, len(b) - len(a)) + wide
    best: list[dict[int, tuple[float, tuple[int, int, str] | None]]] = []
    for i in range(len(a) + 1):
        row: dict[int, tuple[float, tuple[int, int, str] | None]] = {}
        best.append(row)
        for j in range(max(0, i + low), min(len(b), i + high) + 1):
            top: tuple[float, tuple[int, int, str] | None] = (math.inf, None) if i or j else (0.0, None)
            for x, y, kind in MOVES:
                if i < x or j < y or ((i == 0 or j == 0) and kind not in ("noisy only", "clean only")):
                    continue
                before = (row if not x else best[i - x]).get(j - y)
                if before is not None:
                    c = _cost(kind, a[i - x : i], b[j - y : j], alike, top[0] - before[0])
                    if c is not None and before[0] + c + 1e-9 < top[0]:
                        top = (before[0] + c, (x, y, kind))
            row[j] = top
    moves, i, j = [], len(a), len(b)
    while best[i][j][1]:
        x, y, kind = best[i][j][1]
        moves.append((i, j, kind))
        i, j = i - x, j - y
    return best[-1][len(b)][0], moves[::-1]


def cheapest_path(noisy: list[str], clean: list[str]) -> tuple[float, list[tuple[int, int, str]]]:
    """Cost and (noisy end, clean end, kind) of the moves of the cheapest path; exact.

    A move that takes more tokens of one side costs at least SHIFT for each, so a path that leaves a band of half-width w costs at least
    2 (w + 1) SHIFT. The band doubles until the path found in it costs less, or it covers everything.
    """
    alike, wide = Similarities(), 4
    while True:
        cost, moves = _path(noisy, clean, alike, wide)
        if cost + 1e-6 < 2 * (wide + 1) * SHIFT or wide >= max(len(noisy), len(clean)):
            return cost, moves
        wide *= 2


def boundary_errors(noisy: str, clean: str) -> list[dict]:
    """Merges and splits on the cheapest path, in order: type, noisy and clean tokens, similarity. Ties go to the first of MOVES. Texts without tokens have none."""
    a, b = noisy.split(), clean.split()
    if not a or not b:
        return []
    found, i, j = [], 0, 0
    for at, to, kind in cheapest_path(a, b)[1]:
        if kind in ("merge", "split"):
            left, right = a[i:at], b[j:to]
            found.append({"type": kind, "noisy": left, "clean": right, "similarity": round(token_similarity("".join(left), "".join(right)), 4)})
        i, j = at, to
    return found


def greedy_counts(noisy: str, clean: str, least: float = GREEDY) -> tuple[int, int]:
    """Splits and merges met from left to right; at each place the most similar join of two or three tokens counts, merges before splits."""
    a, b = noisy.split(), clean.split()
    i = j = splits = merges = 0
    same = lambda x, y: token_similarity(x, y, underscore=False)
    while i < len(a) and j < len(b):
        step = (1, 1)
        if normalized(a[i], False) != normalized(b[j], False):
            joins = [(1, k) for k in (2, 3) if j + k <= len(b)] + [(k, 1) for k in (2, 3) if i + k <= len(a)]
            rated = [(same("".join(a[i : i + x]), "".join(b[j : j + y])), -n, (x, y)) for n, (x, y) in enumerate(joins)]
            top = max(rated, default=(0.0, 0, step))
            if top[0] >= least and rated:
                step = top[2]
                merges, splits = merges + (step[1] > 1), splits + (step[0] > 1)
        i, j = i + step[0], j + step[1]
    return splits, merges


@F.pandas_udf(ERRORS)
def boundary_errors_udf(noisy: pd.Series, clean: pd.Series) -> pd.Series:
    return pd.Series([boundary_errors(a or "", b or "") for a, b in zip(noisy, clean, strict=True)])


@F.pandas_udf(COUNTS)
def greedy_counts_udf(noisy: pd.Series, clean: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([greedy_counts(a or "", b or "") for a, b in zip(noisy, clean, strict=True)], columns=["splits", "merges"])


def boundary_table(pairs: DataFrame, keys: list[str], noisy: str = "noisy", clean: str = "clean") -> DataFrame:
    """One row per merge or split of each pair."""
    found = pairs.select(*keys, F.posexplode(boundary_errors_udf(noisy, clean)).alias("error_pos", "e"))
    return found.select(*keys, "error_pos", F.col("e.type").alias("type"), F.col("e.noisy").alias("noisy_words"), F.col("e.clean").alias("clean_words"), F.col("e.similarity").alias("similarity"))


def boundary_statistics(errors: DataFrame, keys: list[str], examples: int = 10) -> DataFrame:
    """Counts and the first examples of each kind; examples are a report's top rows, counts cover all."""
    first = lambda kind: F.slice(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("pair_pos", "error_pos", "noisy_words", "clean_words")))), 1, examples).alias(f"{kind}_examples")
    return errors.groupBy(*keys).agg(F.count_if(F.col("type") == "split").alias("splits"), F.count_if(F.col("type") == "merge").alias("merges"), first("split"), first("merge"))
