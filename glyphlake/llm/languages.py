"""Language identification by a mixture of languages per document.

Learning: counts of byte trigrams per language over all documents to learn from, hashed to a fixed number of buckets, so that the model's
size depends on the number of languages alone. Prediction: every word of a text has a likelihood under each language from its
trigrams; expectation-maximisation over the words, until no share of the document moves by more than SETTLED, gives the proportions
of the languages. It runs for the best 1, 2, ... up to all languages, and the set with the best log-likelihood less a penalty per
language (as in BIC) is taken. The prediction is the largest proportion, which is also the score.

Nulls and edge cases: null texts and texts without letters are `und` with score 0; documents with a null language are not learned from;
where nothing can be learned every prediction is `und`; repeated rows are predicted each; any other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.words import slices, text_bytes

#: Buckets of hashed trigrams.
BUCKETS = 1 << 16
#: Change of a share under which it is settled, and the penalty per further language in units of log(words).
SETTLED, PENALTY = 1e-4, 1.0
UNKNOWN = "und"

#: Bytes as they enter trigrams: A-Z in lower case, white space, digits and ASCII punctuation as a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts that touch a letter, where each word's trigrams start, and the text of each word."""
    lengths = np.array([len(t) + 2 for t in texts])
    a = FOLD[np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)]
    text = np.repeat(np.arange(len(texts)), lengths)
    letter = a != 32
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    ends = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]]))
    # A word of n letters, with a space on either side, has n trigrams, one around each letter.
    middle = np.flatnonzero(letter)
    wide = a.astype(np.uint32)
    code = (wide[middle - 1] << 16) | (wide[middle] << 8) | wide[middle + 1]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(ends - starts + 1)[:-1]]) if len(starts) else np.empty(0, np.int64)
    return bucket, first, text[starts]


def trained(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of every bucket under each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in slices(batches):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in set(langs):
                own = [t for t, k in zip(texts, langs, strict=True) if k == name and t]
                if own:
                    c = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                    c += np.bincount(trigrams(own)[0], minlength=BUCKETS)
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    source = text_bytes(docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()), F.col(lang).cast("string").alias("lang"), text=text)
    rows = source.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS per language at most
    names = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    if names:
        place = {n: i for i, n in enumerate(names)}
        counts[rows.column("bucket").to_numpy(), [place[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    return names, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)).astype(np.float32)


def mixtures(likelihood: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages and log-likelihood per document. likelihood: of each word under each language, scaled to 1 at most."""
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    words = np.bincount(doc, minlength=n_docs)
    like, at, moving = likelihood, doc, words > 0
    while moving.any():
        part = like * share[at]
        part /= part.sum(1, keepdims=True)
        new = np.stack([np.bincount(at, part[:, k], n_docs) for k in range(part.shape[1])], 1) / np.maximum(words, 1)[:, None]
        still = moving & (np.abs(new - share).max(1) > SETTLED)
        share[moving] = new[moving]
        if still.sum() < moving.sum():
            keep = still[at]
            like, at = like[keep], at[keep]
        moving = still
    total = np.bincount(doc, np.log(np.maximum((likelihood * share[doc]).sum(1), 1e-300)), n_docs)
    return share, total


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The columns `keep` with lang_pred, score, and proportions (language to share, of the selected set)."""
    names, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    keep = [k for k in keep if k not in ("lang_pred", "score", "proportions")]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        for b in slices(batches, 128):
            raw = b.column(n_keep).to_pylist()
            texts = [t or b"" for t in raw]
            pred, score, sets = [UNKNOWN] * len(texts), np.zeros(len(texts)), [{}] * len(texts)
            if names and texts:
                bucket, first, doc = trigrams(texts)
                if len(first):
                    ll = np.add.reduceat(logp[bucket], first, axis=0).astype(np.float64)
                    top = ll.max(1)
                    like = np.exp(np.maximum(ll - top[:, None], -60))
                    n = len(texts)
                    base = np.bincount(doc, top, n)
                    words = np.bincount(doc, minlength=n)
                    full, whole = mixtures(like, doc, n, np.ones((n, len(names))))
                    order = np.argsort(-full, axis=1, kind="stable")
                    best, chosen = np.full(n, -np.inf), full
                    for k in range(1, len(names) + 1):
                        allowed = np.zeros((n, len(names)))
                        np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
                        share, total = mixtures(like, doc, n, allowed) if k < len(names) else (full, whole)
                        value = base + total - penalty * (k - 1) * np.log(np.maximum(words, 2))
                        better = value > best + 1e-9
                        chosen = np.where(better[:, None], share, chosen)
                        best = np.where(better, value, best)
                    lead = chosen.argmax(1)
                    for i in range(n):
                        if words[i] and has_letter(texts[i]):
                            pred[i], score[i] = names[lead[i]], min(1.0, chosen[i, lead[i]])
                            sets[i] = {names[k]: float(chosen[i, k]) for k in np.flatnonzero(chosen[i] > 0)}
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], pa.array(pred), pa.array(score), pa.array([list(s.items()) for s in sets], pa.map_(pa.string(), pa.float64()))], names=[*keep, "lang_pred", "score", "proportions"])

    fields = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return text_bytes(docs, *keep, text=text).mapInArrow(run, f"{fields}lang_pred string, score double, proportions map<string,double>")


LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def has_letter(text: bytes) -> bool:
    return any(b in LETTERS for b in text[:200]) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def fold(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"))
    model = trained(docs.filter(~F.col("held_out")))
    return identified(docs, model, ["doc_id", "held_out"]).drop("proportions")
