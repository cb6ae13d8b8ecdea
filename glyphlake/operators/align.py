"""Sentence alignment of two versions of a document, and what it rests on."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.edits import ratio
from glyphlake.functions.text import shingles, stripped

# Fixed values of the alignment.
MIN_DIAGONAL, GAP, MIN_PAIR = 0.30, -0.5, 0.55
#: Cells of a row of the band up to which its sentences are compared one by one.
NARROW = 16
SHINGLE_PART, WORD_PART, EPSILON = 0.75, 0.25, 1e-6


def band(m: Column, n: Column) -> Column:
    """Half-width of the band that the path must stay in, as a share of both lengths."""
    return F.when((m == 0) | (n == 0), F.lit(0.4)).otherwise(F.least(F.lit(0.4), 0.10 + 0.5 * F.abs(1 - m / n)))


def band_join(left: DataFrame, right: DataFrame, key: str, half: float, at: str = "at") -> DataFrame:
    """Pairs of a key whose places `at`, shares of their lengths, are at most `half` apart. Places meet in cells of that width and their neighbours."""
    cell = F.floor(F.col(at) / (half * (1 + 1e-9))).cast("long")
    own = left.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    other = right.withColumn("_cell", cell).withColumnRenamed(at, "_at")
    return own.join(other, [key, "_cell"]).filter(F.abs(F.col(at) - F.col("_at")) <= half).drop("_cell", "_at")


def unique_anchors(left: DataFrame, right: DataFrame, key: str, text: str = "text", size: int = 5) -> DataFrame:
    """Shingles (lower case) that occur just once on either side of a key: key, shingle and both positions."""

    def once(df: DataFrame, at: str) -> DataFrame:
        rows = df.select(key, F.posexplode(shingles(F.lower(text), size)).alias("at", "shingle"))
        return rows.groupBy(key, "shingle").agg(F.count(F.lit(1)).alias("n"), F.first("at").alias(at)).filter("n = 1").drop("n")

    return once(left, "left_pos").join(once(right, "right_pos"), [key, "shingle"])


def fast_similarity(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """`similarity` of two texts: cosine of their 5-character shingles and overlap of their words, by joins and sums."""

    def counted(text: str, side: str) -> DataFrame:
        return pairs.select(*keys, F.explode(shingles(F.col(text))).alias("s")).groupBy(*keys, "s").agg(F.count(F.lit(1)).alias(side))

    one, two = counted(a, "na"), counted(b, "nb")
    both = one.join(two, [*keys, "s"], "full").groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("dot"), F.sum(F.col("na") * F.col("na")).alias("aa"), F.sum(F.col("nb") * F.col("nb")).alias("bb"))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    joined = pairs.join(both, keys, "left")
    wa, wb = words(F.col(a)), words(F.col(b))
    by_words = F.size(F.array_intersect(wa, wb)) / (F.sqrt(F.size(wa) * F.size(wb)) + EPSILON)
    by_shingles = F.coalesce("dot", F.lit(0)) / (F.sqrt(F.coalesce("aa", F.lit(0))) * F.sqrt(F.coalesce("bb", F.lit(0))) + EPSILON)
    return joined.withColumn("similarity", SHINGLE_PART * by_shingles + WORD_PART * by_words).drop("dot", "aa", "bb")


def _similarities(noisy: list[str], clean: list[str], rows: list[tuple[int, int]]) -> Iterator[dict[int, float]]:
    """Per noisy sentence the clean ones in its range that it shares a shingle or a word with, and their similarity; of the others it is 0.

    Where ranges are narrow, each pair's shingles are intersected. Else sentences meet by an index of the clean side, so the cost is that of what they share, not of all cells.
    """
    shingled = lambda t: Counter([t[i : i + 5] for i in range(len(t) - 4)])
    norm = lambda counts: math.sqrt(sum([n * n for n in counts.values()]))
    if max((high - low for low, high in rows), default=0) < NARROW:
        held: dict[int, tuple] = {}
        for t, (low, high) in zip(noisy, rows, strict=True):
            held = {j: held[j] if j in held else (c := shingled(clean[j]), norm(c), set(clean[j].lower().split())) for j in range(low, high + 1)}
            counts, words = shingled(t), set(t.lower().split())
            own, out = norm(counts), {}
            for j, (other, size, said) in held.items():
                dot, both = sum([counts[s] * other[s] for s in counts.keys() & other.keys()]), len(words & said)
                if dot or both:
                    out[j] = SHINGLE_PART * dot / (own * size + EPSILON) + WORD_PART * both / (math.sqrt(len(words) * len(said)) + EPSILON)
            yield out
        return
    by_shingle, by_word = defaultdict(list), defaultdict(list)
    norms, sizes = [], []
    for j, t in enumerate(clean):
        counts, words = shingled(t), set(t.lower().split())
        norms.append(norm(counts))
        sizes.append(len(words))
        for s, n in counts.items():
            by_shingle[s].append((j, n))
        for w in words:
            by_word[w].append(j)
    for t, (low, high) in zip(noisy, rows, strict=True):
        counts, words = shingled(t), set(t.lower().split())
        dot, both = defaultdict(int), defaultdict(int)
        for s, n in counts.items():
            places = by_shingle.get(s, ())
            for j, k in places[bisect_left(places, (low,)) : bisect_left(places, (high + 1,))]:
                dot[j] += n * k
        for w in words:
            places = by_word.get(w, ())
            for j in places[bisect_left(places, low) : bisect_left(places, high + 1)]:
                both[j] += 1
        own = norm(counts)
        yield {j: SHINGLE_PART * dot.get(j, 0) / (own * norms[j] + EPSILON) + WORD_PART * both.get(j, 0) / (math.sqrt(len(words) * sizes[j]) + EPSILON) for j in dot.keys() | both.keys()}


def aligned(noisy: list[str], clean: list[str], min_diagonal: float = MIN_DIAGONAL, gap: float = GAP, min_pair: float = MIN_PAIR) -> list[tuple[str, str, float]]:
    """Pairs of sentences on the best path within the band, with their ratio; ties go to the pair, then to skipping a noisy sentence.

    Two rows of scores and a byte per cell of the band are held. Where the band has no path, sentences pair by their places.
    """
    m, n = len(noisy), len(clean)
    if not m or not n:
        return []
    wide = min(0.4, 0.10 + 0.5 * abs(1 - m / n))
    ranges = [(max(1, math.ceil((i / m - wide) * n - 1e-9)), min(n, math.floor((i / m + wide) * n + 1e-9))) for i in range(1, m + 1)]
    none = -math.inf
    last, moves = [gap * j for j in range(n + 1)], []
    for i, ((low, high), alike) in enumerate(zip(ranges, _similarities(noisy, clean, [(a - 1, b - 1) for a, b in ranges]), strict=True), 1):
        row, moved = [none] * (n + 1), bytearray(max(high - low + 1, 0))
        row[0] = gap * i
        for j in range(low, high + 1):
            s = alike.get(j - 1, 0.0)
            top, move = (last[j - 1] + s if s >= min_diagonal else none), 1
            if last[j] + gap > top:
                top, move = last[j] + gap, 2
            if row[j - 1] + gap > top:
                top, move = row[j - 1] + gap, 3
            row[j], moved[j - low] = top, move
        last = row
        moves.append(moved)
    if math.isfinite(last[n]):
        pairs, i, j = [], m, n
        while i and j:
            move = moves[i - 1][j - ranges[i - 1][0]]
            if move == 1:
                pairs.append((noisy[i - 1], clean[j - 1]))
            i, j = i - (move != 3), j - (move != 2)
        pairs.reverse()
    else:
        pairs = list(zip(noisy, clean, strict=False))
    rated = [(a, b, ratio(a, b)) for a, b in pairs]
    return [x for x in rated if x[2] >= min_pair]


def sentence_pairs(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, noisy, clean, ratio) from rows (key, side 'noisy' or 'clean', pos, text). One document is one group of sentences; null texts are left out."""
    kind = sentences.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [aligned(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            keys = b.column(0).take(pa.array([i for i, pairs in enumerate(found) for _ in pairs], pa.int64()))
            noisy, clean, alike = zip(*(x for pairs in found for x in pairs), strict=True) if len(keys) else ((), (), ())
            pos = pa.array([k for pairs in found for k in range(len(pairs))], pa.int32())
            yield pa.RecordBatch.from_arrays([keys, pos, pa.array(noisy, pa.string()), pa.array(clean, pa.string()), pa.array(alike, pa.float64())], names=[key, "pos", "noisy", "clean", "ratio"])

    texts = lambda side: F.transform(F.sort_array(F.collect_list(F.when((F.col("side") == side) & F.col("text").isNotNull(), F.struct("pos", "text")))), lambda x: x["text"])
    grouped = dealt(sentences.select(key, "side", "pos", "text"), key).groupBy(key).agg(texts("noisy").alias("noisy"), texts("clean").alias("clean"))
    return grouped.mapInArrow(run, f"`{key}` {kind}, pos int, noisy string, clean string, ratio double")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows of a key in one of as many tasks as the session shuffles to: for work that is not told by bytes, so partitions are not to be merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def as_sentences(docs: DataFrame, key: str, text: str, side: str, split) -> DataFrame:
    return docs.select(key, F.lit(side).alias("side"), F.posexplode(split(F.col(text))).alias("pos", "text")).filter(stripped(F.col("text")) != "")


def alignment_quality(pairs: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Per key: number of pairs, their ratios' mean, upper median, extremes and low shares, and the sentences of both sides that found no partner."""
    r = F.col("ratio")
    per = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(r).alias("mean_ratio"), F.element_at(F.sort_array(F.collect_list(r)), (F.floor(F.count(r) / 2) + 1).cast("int")).alias("median_ratio"), F.min(r).alias("min_ratio"), F.max(r).alias("max_ratio"),
        *[F.avg((r < t).cast("int")).alias(f"below_{int(t * 100)}") for t in (0.3, 0.5, 0.7)],
    )
    joined = counts.join(per, key, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return joined.withColumn("dropped", F.greatest(F.least("n_noisy", "n_clean") - F.col("n_pairs"), F.lit(0))).withColumn("matched_share", F.bround(F.col("n_pairs") / F.greatest(F.least("n_noisy", "n_clean"), F.lit(1)), 4)).withColumn("band", F.bround(band(F.col("n_noisy"), F.col("n_clean")), 4))
