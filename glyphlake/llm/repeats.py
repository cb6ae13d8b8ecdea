"""Removal of passages of `window` words or more that an earlier document has, by difference-cover anchors.

`COVER` holds residues modulo `PERIOD` such that every difference modulo `PERIOD` is the difference of two of them. Only runs of
`window - PERIOD + 1` words that start at a cover position are hashed. Two equal windows of `window` words, wherever they start in
their documents, have an anchor in common that is at the same place in both. So:

1. whole copies: of documents with the same words, only the one with the smallest id goes on; in the others every word that is in a
   window goes;
2. anchors are dealt by hash; the places of those that two documents have go back to their documents, one row of places each;
3. around these places anchors are extended to whole windows: only such windows are hashed (128 bits), and per hash the smallest
   document id is found;
4. a window goes if that id is smaller than its own document's.

What is decided among the texts of one slice of a task does not enter the groups of 2 and 3, so that an anchor or a window that many
documents share does not gather them all: an anchor sends one row a slice with the smallest and the largest id, windows that a smaller id
in the slice has go out as runs, one row a document. The cost grows with the words and with the words around shared anchors; no
structure has a size that data can fill.

Nulls and edge cases: null text has no words; documents with fewer than `window` words lose nothing; rows with the same id count as
one document, so that a repeated row loses nothing to its twin, and rows that share an id are judged each by their own text; rows with a
null id lose nothing and take nothing from others; an empty table gives an empty table. Any other columns stay as they are, but those
named like a result give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.llm.words import MULTIPLIERS, as_long, bitmap, in_bitmap, mix, saved, slices, text_bytes, window_hashes, word_hashes

WINDOW = 50
#: A perfect difference set of order 5 (fixed values).
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Texts of a slice that is decided within its task.
TEXTS = 1024


def anchor_hashes(h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of a document, and the hash of the anchor at each."""
    w = window_hashes(h, window - PERIOD + 1)
    at = np.arange(len(w))
    at = at[np.isin(at % PERIOD, COVER)]
    return at, w[at]


def _words(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """Row and words of each text that has a window."""
    for i, t in enumerate(batch.column("text").to_pylist()):
        words = t.split() if t else []
        if len(words) >= window:
            yield i, words


def _digests(docs: DataFrame, window: int) -> DataFrame:
    """(_id, _tag, _digest) of the texts that have a window: a 128-bit digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, d = [], []
            for i, words in _words(b, window):
                rows.append(i)
                d.append(xxhash.xxh3_128_digest(b" ".join(words)))
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("_id").take(at), b.column("_tag").take(at), pa.array(d, pa.binary())], names=["_id", "_tag", "_digest"])

    return docs.mapInArrow(run, "_id long, _tag long, _digest binary")


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """n lists: the values of each row; rows ascend."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Rows by anchor: the smallest and the largest id that a slice has for it, and, where that is one id, its text (_id, _tag) and the
    places `at` and `more`. Where the slice has two ids, the places are known to be shared: they go out per text, with null lo and hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "lo", "hi", "_id", "_tag", "at", "more"]
        for b in slices(batches, TEXTS):
            ids, tags = b.column("_id").to_numpy(), b.column("_tag").to_numpy()
            found, places, owners = [], [], []
            for i, words in _words(b, window):
                at, h = anchor_hashes(word_hashes().of(words), window)
                found.append(h)
                places.append(at)
                owners.append(np.full(len(at), i, np.int32))
            if not found:
                continue
            h, at, row = np.concatenate(found), np.concatenate(places), np.concatenate(owners)
            order = np.lexsort((at, row, ids[row], h))
            h, at, row = h[order], at[order], row[order]
            head = np.concatenate([[True], h[1:] != h[:-1]])
            first = np.flatnonzero(head)
            lo, hi = ids[row[first]], ids[row[np.concatenate([first[1:], [len(h)]]) - 1]]
            two = lo < hi
            known = two[np.cumsum(head) - 1]
            lead = ~known & (head | np.concatenate([[True], row[1:] != row[:-1]]))
            one = row[lead]
            rest = ~known & ~lead
            yield pa.RecordBatch.from_arrays([pa.array(as_long(h[lead])), pa.array(ids[one]), pa.array(ids[one]), pa.array(ids[one]), pa.array(tags[one]), pa.array(at[lead].astype(np.int32)), _lists((np.cumsum(lead) - 1)[rest], at[rest], len(one))], names=names)
            if two.any():
                n = int(two.sum())
                no, none = pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h[first[two]])), pa.array(lo[two]), pa.array(hi[two]), no, no, none, pa.nulls(n, pa.list_(pa.int32()))], names=names)
                order = np.lexsort((at[known], row[known]))
                texts, back = np.unique(row[known][order], return_inverse=True)
                n = len(texts)
                key = mix(ids[texts].astype(np.uint64) ^ mix(tags[texts].astype(np.uint64)))
                no = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(as_long(key)), no, no, pa.array(ids[texts]), pa.array(tags[texts]), pa.nulls(n, pa.int32()), _lists(back, at[known][order], n)], names=names)

    return docs.mapInArrow(run, "anchor long, lo long, hi long, _id long, _tag long, at int, more array<int>")


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    """Per text: the places `at` and `more` of its rows as one array."""
    return rows.groupBy("_id", "_tag").agg(F.concat(F.collect_list("at"), F.flatten(F.collect_list("more"))).alias(name))


def _shared_places(docs: DataFrame, window: int) -> DataFrame:
    """(_id, _tag, places): where a text's anchors are that another document has, too. Running frames; groups spill."""
    lowest = F.min("lo").over(Window.partitionBy("anchor").orderBy("lo"))
    largest = F.max("hi").over(Window.partitionBy("anchor").orderBy(F.desc("hi")))
    rows = _anchors(docs, window).withColumn("lowest", lowest).withColumn("largest", largest)
    return _gathered(rows.filter("_id is not null and (lo is null or lowest < _id or largest > _id)"), "places")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(h1, h2, _id, _tag, at) of the windows around the `places`; those that a smaller id in the slice has, as starts in `more`, one row a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "_id", "_tag", "at", "more"]
        for b in slices(batches, TEXTS):
            ids, tags, places = b.column("_id").to_numpy(), b.column("_tag").to_numpy(), b.column("places")
            ones, twos, owners, starts = [], [], [], []
            for i, words in _words(b, window):
                n = len(words) - window + 1
                p = places[i].values.to_numpy().astype(np.int64)
                marks = np.zeros(n + 1, np.int64)  # a window that starts at i holds anchors that start from i to i + PERIOD - 1
                np.add.at(marks, np.clip(p - PERIOD + 1, 0, n), 1)
                np.add.at(marks, np.minimum(p + 1, n), -1)
                k = np.flatnonzero(np.cumsum(marks)[:n] > 0)
                ones.append(window_hashes(word_hashes().of(words), window)[k])
                twos.append(window_hashes(word_hashes(1).of(words), window, MULTIPLIERS[1])[k])
                owners.append(np.full(len(k), i, np.int32))
                starts.append(k)
            if not ones:
                continue
            one, two, row, at = np.concatenate(ones), np.concatenate(twos), np.concatenate(owners), np.concatenate(starts)
            order = np.lexsort((ids[row], two, one))
            h, g, o = one[order], two[order], ids[row[order]]
            head = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            gone = np.empty(len(o), bool)
            gone[order] = o > o[np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))]
            # Of equal windows of one id in the slice, each stays a row: all of them go, or none.
            left = row[~gone]
            yield pa.RecordBatch.from_arrays([pa.array(as_long(one[~gone])), pa.array(as_long(two[~gone])), pa.array(ids[left]), pa.array(tags[left]), pa.array(at[~gone].astype(np.int32)), pa.nulls(len(left), pa.list_(pa.int32()))], names=names)
            if gone.any():
                texts, back = np.unique(row[gone], return_inverse=True)
                key = mix(ids[texts].astype(np.uint64) ^ mix(tags[texts].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(key)), pa.array(np.zeros(len(texts), np.int64)), pa.array(ids[texts]), pa.array(tags[texts]), pa.nulls(len(texts), pa.int32()), _lists(back, at[gone], len(texts))], names=names)

    return docs.mapInArrow(run, "h1 long, h2 long, _id long, _tag long, at int, more array<int>")


def tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows with `_id` and `_tag`, which is 0, or a hash of the text where several rows share an id."""
    base = docs.withColumn("_id", F.col(key).cast("long"))
    twice = saved(base.groupBy("_id").count().filter("count > 1 and _id is not null").select("_id"))
    if twice.isEmpty():
        return base.withColumn("_tag", F.lit(0).cast("long"))
    slots = saved(bitmap(twice, "_id"))
    sure = in_bitmap(base, "_id", slots, keep=False).withColumn("_tag", F.lit(0).cast("long"))
    rest = in_bitmap(base, "_id", slots).join(twice.withColumn("_twice", F.lit(True)), "_id", "left")
    return sure.unionByName(rest.withColumn("_tag", F.when(F.col("_twice"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).otherwise(F.lit(0))).drop("_twice").select(*sure.columns))


def repeated_windows(docs: DataFrame, text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """For `tagged` rows: (_id, _tag, starts of the windows that go), in no set order; and (_id, _tag) of whole copies: all their windows go."""
    source = text_bytes(docs.filter("_id is not null"), "_id", "_tag", text=text)
    digests = saved(_digests(source, window))
    first = digests.groupBy("_digest").agg(F.min("_id").alias("_first"))
    whole = saved(digests.join(first, "_digest").filter("_id > _first").select("_id", "_tag").distinct())
    copied = saved(bitmap(whole, "_id"))
    own = in_bitmap(source, "_id", copied, keep=False).unionByName(in_bitmap(source, "_id", copied).join(whole, ["_id", "_tag"], "left_anti").select(*source.columns))
    places = saved(_shared_places(own, window))
    near = in_bitmap(own, "_id", saved(bitmap(places, "_id"))).join(places, ["_id", "_tag"])
    lowest = F.min("_id").over(Window.partitionBy("h1", "h2").orderBy("_id"))  # a running frame; groups spill
    return saved(_gathered(_windows(near, window).withColumn("lowest", lowest).filter("at is null or lowest < _id"), "starts")), whole


def covered(n: int, starts: list[int] | None, window: int) -> np.ndarray:
    """Which of n words stay."""
    keep = np.ones(n, bool)
    if starts is not None and len(starts):
        marks = np.zeros(n + 1, np.int64)
        s = np.asarray(starts)
        np.add.at(marks, s, 1)
        np.add.at(marks, np.minimum(s + window, n), -1)
        keep = np.cumsum(marks)[:n] == 0
    return keep


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with the kept words, joined by one space, as `kept_text`, and n_words and n_removed."""
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    plain = [f"c{i}" for i in range(len(names))]  # so that no column can clash with those of the steps
    at = names.index(text)
    base = tagged(docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, plain, strict=True)]), plain[names.index(key)], plain[at])
    gone, whole = repeated_windows(base, plain[at], window)
    touched = saved(bitmap(gone.select("_id").unionByName(whole.select("_id")), "_id"))
    clean = in_bitmap(base, "_id", touched, keep=False).withColumn("_starts", F.lit(None).cast("array<int>")).withColumn("_copy", F.lit(False))
    hit = in_bitmap(base, "_id", touched).join(gone.withColumnRenamed("starts", "_starts"), ["_id", "_tag"], "left").join(whole.withColumn("_copy", F.lit(True)), ["_id", "_tag"], "left").withColumn("_copy", F.coalesce("_copy", F.lit(False)))
    both = clean.select(*plain, "_starts", "_copy").unionByName(hit.select(*plain, "_starts", "_copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, removed, kept = [], [], []
            for t, starts, copy in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                words = t.split() if t else []
                n.append(len(words))
                if copy and len(words) >= window:
                    words = []
                elif starts:
                    keep = covered(len(words), starts, window)
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return both.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept_text string")


def op9_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """The same from the definition, for tests: words, removed words and digest of each row."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    lowest: dict[tuple, int] = {}
    for i, w in split:
        for k in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[k : k + window])
            lowest[g] = min(i, lowest.get(g, i))
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if lowest[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
