"""Quality rules by distribution divergence.

Per document: counts of lines, repeated words and symbols (base rules), a histogram of character classes and one of common words.
The references are learned from all documents: for each language the mean share of every character class, and the shares of its
most common words with one bin for all other words. A document is compared with every language by the Jensen-Shannon distance (base 2)
and judged by the nearest one; a distance over its threshold rejects, unless the text is too short for the histogram to say much.

Nulls and edge cases: null and empty texts have no words and fail the base rules; documents without a language do not enter the
references; where no language has documents, only the base rules judge; repeated rows are judged each; any other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.llm.words import as_long, saved, slices, text_bytes, window_hashes, word_hashes

#: Character classes, told by UTF-8 bytes: continuation bytes do not count, lead bytes stand for other letters and signs.
CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "punctuation", "other", "continued")
SYMBOLS = b"#*$%&|<>"
REPEAT = 8
#: Words of a language that count as common.
COMMON = 40
#: Columns of the result; those of the input with such names give way to them.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")
#: Thresholds of the two distances, and the least characters and words for each to count.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.25, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.30, 40
#: Bins in effect: a short text is as far from its own language as chance makes it, by about bins / (8 ln 2 n) in the squared distance.
CLASS_BINS, WORD_BINS = 8, 25


def limit(distance: float, bins: int, n: int) -> float:
    return math.sqrt(distance * distance + bins / (8 * math.log(2) * max(n, 1)))


def _table() -> np.ndarray:
    table = np.full(256, CLASSES.index("punctuation"), np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            table[b] = CLASSES.index("other")
        elif b >= 0x80:
            table[b] = CLASSES.index("continued")
        elif c.isdigit():
            table[b] = CLASSES.index("digit")
        elif c.isalpha():
            table[b] = CLASSES.index("upper" if c.isupper() else "lower")
        elif c in " \t\n\r\v\f":
            table[b] = CLASSES.index("space")
        elif c in ".,;:'\"-?":
            table[b] = CLASSES.index("sentence")
        elif b in SYMBOLS:
            table[b] = CLASSES.index("symbol")
    return table


TABLE = _table()


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(TABLE[np.frombuffer(text, np.uint8)], minlength=len(CLASSES))


def n_repeated(h: np.ndarray, width: int = REPEAT) -> int:
    """Words that are in a window of `width` words found twice or more."""
    w = window_hashes(h, width)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return int((np.cumsum(marks) > 0).sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the histogram p to each row of q, in base 2."""
    p = p / max(p.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        two = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum((one + two) / 2, 0))


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> list[dict]:
    """Per language: the mean shares of character classes and the common words' hashes and shares. Its size depends on the languages alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares: dict[str, np.ndarray] = {}
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.float64())
        made = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "word", "class", "n"])
        for b in slices(batches, 1024):
            langs, own = b.column(0).to_pylist(), {}
            for name, t in zip(langs, b.column(1).to_pylist(), strict=True):
                if t and (ws := t.split()):
                    c = class_counts(t)[:-1]
                    s = shares.setdefault(name, np.zeros(len(CLASSES) + 1))
                    s[:-2] += c / c.sum()
                    s[-2] += 1
                    s[-1] += len(ws)
                    own.setdefault(name, []).append(word_hashes().of(ws))
            for name, parts in own.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield made([name] * len(h), as_long(h), [None] * len(h), n.astype(np.float64))
        for name, s in shares.items():
            yield made([name] * len(s), [None] * len(s), range(len(s)), s)

    counts = text_bytes(docs.filter(F.col(lang).isNotNull()), F.col(lang).cast("string").alias("lang"), text=text).mapInArrow(run, "lang string, word long, class int, n double").groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    counts = saved(counts)
    # The rank is limited before the shuffle, so that a language's words do not gather in one task.
    ranked = counts.filter("word is not null").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= common).drop("rank").unionByName(counts.filter("word is null"))
    found: dict[str, dict] = {}
    for r in ranked.toLocalIterator():
        x = found.setdefault(r["lang"], {"classes": np.zeros(len(CLASSES) + 1), "words": {}})
        if r["word"] is None:
            x["classes"][r["class"]] = r["n"]
        else:
            x["words"][r["word"]] = r["n"]
    out = []
    for name in sorted(found):
        c = found[name]["classes"]
        out.append({"lang": name, "classes": (c[:-2] / max(c[-2], 1)).tolist(), "words": {w: n / max(c[-1], 1) for w, n in found[name]["words"].items()}})
    return out


def rated(docs: DataFrame, refs: list[dict], keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with the base counts, both distances, base_failed and kept."""
    keep = [k for k in keep if k not in RESULTS]
    n_keep = len(keep)
    hashes = np.array(sorted({w for r in refs for w in r["words"]}), np.int64)
    classes = np.array([r["classes"] for r in refs]).reshape(len(refs), len(CLASSES) - 1)
    shares = np.array([[r["words"].get(w, 0.0) for w in hashes.tolist()] for r in refs]).reshape(len(refs), len(hashes))
    shares = np.concatenate([shares, 1 - shares.sum(1, keepdims=True)], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.isin(np.arange(len(CLASSES)), [CLASSES.index("space"), CLASSES.index("continued")], invert=True)
        for b in slices(batches):
            rows = []
            for t in b.column(n_keep).to_pylist():
                t = t or b""
                words, c = t.split(), class_counts(t)
                h = word_hashes().of(words)
                lines = [x for x in t.split(b"\n") if x and not x.isspace()]
                near = other = 0.0
                if len(refs):
                    near = float(js_distance(c[:-1], classes).min())
                    if len(hashes):
                        s = as_long(h)
                        k = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                        got = np.bincount(np.where(hashes[k] == s, k, len(hashes)), minlength=len(hashes) + 1)
                        other = float(js_distance(got, shares).min()) if len(words) else 0.0
                n, repeated = len(words), n_repeated(h)
                failed = n < 20 or 100 * repeated > 30 * n
                chars = int(c[mask].sum())
                bad = (chars >= MIN_CHARS and near > limit(MAX_CLASS_DISTANCE, CLASS_BINS, chars)) or (n >= MIN_WORDS and other > limit(MAX_WORD_DISTANCE, WORD_BINS, n))
                rows.append((n, chars, int(c[CLASSES.index("symbol")]), len(lines) - len(set(lines)), repeated, near, other, failed, not (failed or bad)))
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            cells = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], *[pa.array(list(x), k) for x, k in zip(cells, kinds, strict=True)]], names=[*keep, *RESULTS])

    fields = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    schema = f"{fields}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"
    return docs.select(*keep, F.col(text).cast("binary").alias("_bytes")).mapInArrow(run, schema)


def quality(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Rated against references learned from the same documents."""
    return rated(docs, references(docs, text, lang), keep, text)


def op7_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), ["doc_id"])
