"""Links between the tokens of two tokenizers over the same texts, and how often each pair of ids is linked in the corpus.

A batch of texts is one run of bytes, a space before each text. Both tokenizers' token ends are counted over it in one bincount; a byte at which both
end is a cut. The running number of cuts before a token's end is its group, and differences of running sums at the documents' byte
offsets give each document's figures. No token crosses a document, as both tokenizers end where a document ends.

Within a group all pairs are linked. What a document holds is its distinct id pairs and how often it links each; groups of many tokens
are first reduced to distinct ids. Pairs are packed and written once. Their document counts are summed in the tasks and
then by Spark. The HEAD most frequent pairs at most, and the highest count of each id of the first vocabulary, have a fixed bound and go to every
task; the pairs beyond are joined by pair and summed per row.

Nulls and edge cases: texts that are null or empty, and those whose joined token bytes differ from space and text (a U+2581 in the text, for
example), have no tokens: zeros and no groups. Special tokens written out in a text are ordinary text. Repeated rows count as a document each. An
empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.bpe import Vocabulary
from glyphlake.llm.words import saved

#: Pairs that may go to every task, 16 bytes each.
HEAD = 1 << 18
#: Texts and bytes of text that are one run; a longer text is a run of its own.
RUN_ROWS, RUN_BYTES = 256, 1 << 20
#: Links of one group from which its ids are made distinct first, and links that are listed at once.
WIDE, LISTED = 4096, 1 << 22
#: Words and characters of words kept with their ids from run to run; pairs counted in a task before they are sent on.
CACHE, CACHED, HELD = 300_000, 1 << 22, 1 << 21


class Both:
    """Both tokenizers, their tokens' bytes, and the ids of lately seen words."""

    #: Neither tokenizer has a token over a space between two other characters; U+2581 counts as a space.
    CUT = re.compile(r"(?<=[^\s▁])(?= \S)")
    AWKWARD = re.compile(r" (?:\s|$)|▁")

    def __init__(self, first: str, second: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        known = Vocabulary(first)
        special = set(known.special.values())
        first_bytes = [b"" if i in special else x for i, x in enumerate(known.bytes_of)]
        n = self.b.get_piece_size()
        second_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        self.sizes = (len(first_bytes), n)
        self.bytes_of = tuple(map(_table, (first_bytes, second_bytes)))
        #: Text of an id and what follows it: inside a group's first or second half, or at its end.
        self.labels = _table([f"{i}{c}".encode() for size, ends in ((len(first_bytes), ",|"), (n, ",;")) for c in ends for i in range(size)])
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.held = 0

    def _split(self, text: str) -> list[str]:
        """Words, each to be taken with a space before it."""
        return [w[1:] for w in self.CUT.split(" " + text)] if self.AWKWARD.search(text) or text[0].isspace() else text.split(" ")

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Both tokenizers' ids of space and text, as 32-bit numbers; words that are new are encoded at once."""
        one, two = self.words
        split = [self._split(x) for x in texts]
        new = list(set(chain.from_iterable(split)).difference(one))
        for w, a, b in zip(new, self.a.encode_batch_fast([" " + w for w in new], add_special_tokens=False), self.b.encode(new, num_threads=1), strict=True):
            one[w], two[w] = array("i", a.ids).tobytes(), array("i", b).tobytes()
        out = [(b"".join(map(one.__getitem__, words)), b"".join(map(two.__getitem__, words))) for words in split]
        self.held += sum(map(len, new))
        if len(one) > CACHE or self.held > CACHED:
            one.clear()
            two.clear()
            self.held = 0
        return out


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blob, start and length of each value."""
    length = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(length) - length, length


def _gather(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The values of the ids, joined, and where each ends."""
    blob, start, length = table
    n = length[ids]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[ids] - (ends - n), n)
    return blob[at].tobytes(), ends


TOKENIZERS: dict[tuple[str, str], Both] = {}


def both(first: str, second: str) -> Both:
    return TOKENIZERS.get((first, second)) or TOKENIZERS.setdefault((first, second), Both(first, second))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(size, (size[i - 1] if i else 0) + RUN_BYTES, "right"))
            j = min(max(j, i + 1), i + RUN_ROWS)
            yield b.slice(i, j - i)
            i = j


def _links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, na: np.ndarray, nb: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, pair, times) of all links, some millions at a time. Tokens of a and b are in the order of their groups, ga is a's group."""
    start = np.cumsum(nb) - nb
    wide = na * nb > WIDE
    rows = np.flatnonzero(~wide[ga])
    n = nb[ga[rows]]
    ends = np.cumsum(n)
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LISTED, "right")))
        m, g = n[i:j], ga[rows[i:j]]
        e = np.cumsum(m)
        other = np.arange(e[-1]) + np.repeat(start[g] - (e - m), m)
        yield np.repeat(g, m), np.repeat(a[rows[i:j]].astype(np.int64), m) * width + b[other], np.ones(int(e[-1]), np.int64)
        i = j
    first = np.cumsum(na) - na
    for g in np.flatnonzero(wide):
        x, nx = np.unique(a[first[g] : first[g] + na[g]].astype(np.int64), return_counts=True)
        y, ny = np.unique(b[start[g] : start[g] + nb[g]].astype(np.int64), return_counts=True)
        step = max(1, LISTED // len(y))
        for i in range(0, len(x), step):
            pairs = (x[i : i + step, None] * width + y[None, :]).ravel()
            yield np.full(len(pairs), g), pairs, (nx[i : i + step, None] * ny[None, :]).ravel()


def _summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.lexsort((pair, doc))
    doc, pair, times = doc[at], pair[at], times[at]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(pair) != 0)])) if len(doc) else np.empty(0, np.int64)
    return doc[new], pair[new], np.add.reduceat(times, new) if len(new) else times


def _packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs as differences, and their times, compressed; `_unpacked` reverses it."""
    steps = np.diff(pairs, prepend=0)
    wide = len(times) > 0 and (int(steps.max()) >> 32 or int(times.max()) >> 32)
    kind = np.int64 if wide else np.uint32
    return bytes([bool(wide)]) + pa.compress(steps.astype(kind).tobytes() + times.astype(kind).tobytes(), codec="zstd", asbytes=True) if len(times) else b""


def _unpacked(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = np.dtype(np.int64 if packed[0] else np.uint32)
    flat = np.frombuffer(pa.decompress(packed[1:], 2 * n * kind.itemsize, codec="zstd", asbytes=True), kind).astype(np.int64)
    return np.cumsum(flat[:n]), flat[n:]


def aligned(texts: list[str | None], t: Both) -> list[tuple[int, int, int, int, bytes, np.ndarray, np.ndarray]]:
    """Per text: n_a, n_b, n_groups, n_links, the groups written out, distinct pairs, and how often each is linked."""
    held = [i for i, x in enumerate(texts) if x]
    rows = [(i, *pair, b" " + texts[i].encode()) for i, pair in zip(held, t.encode([texts[i] for i in held]), strict=True)]
    ids = lambda rows, k: np.frombuffer(b"".join([r[k] for r in rows]), np.int32)
    whole = [_gather(t.bytes_of[k], ids(rows, k + 1)) for k in (0, 1)]
    if any(w[0] != b"".join([r[3] for r in rows]) for w in whole):
        rows = [r for r in rows if all(_gather(t.bytes_of[k], np.frombuffer(r[k + 1], np.int32))[0] == r[3] for k in (0, 1))]
        whole = [_gather(t.bytes_of[k], ids(rows, k + 1)) for k in (0, 1)]
    none = np.empty(0, np.int64)
    out = [(0, 0, 0, 0, b"", none, none)] * len(texts)
    if not rows:
        return out
    a, b, end_a, end_b = ids(rows, 1), ids(rows, 2), whole[0][1], whole[1][1]
    border = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])  # byte offsets of the documents
    cut = np.bincount(np.concatenate([end_a, end_b]), minlength=border[-1] + 1) == 2
    before = np.cumsum(cut)  # cuts up to a byte
    ga, gb = before[end_a - 1], before[end_b - 1]
    groups = int(before[-1])
    na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    group_at = before[border]
    at = lambda n: np.concatenate([[0], np.cumsum(n)])[group_at]  # noqa: E731  running sums at the documents' borders
    tokens_a, tokens_b, links = at(na), at(nb), at(na * nb)
    # The groups written out: a group's tokens of the first, then of the second tokenizer.
    last_a, last_b = np.cumsum(na)[ga] - 1 == np.arange(len(a)), np.cumsum(nb)[gb] - 1 == np.arange(len(b))
    size_a, size_b = t.sizes
    label = np.empty(len(a) + len(b), np.int64)
    label[np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]] = a + np.where(last_a, size_a, 0)
    label[np.arange(len(b)) + np.cumsum(na)[gb]] = 2 * size_a + b + np.where(last_b, size_b, 0)
    written, written_end = _gather(t.labels, label)
    written_end = np.concatenate([[0], written_end])[tokens_a + tokens_b]
    doc_of = np.searchsorted(group_at, np.arange(groups), "right") - 1
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g, pair, times in _links(a, b, ga, na, nb, size_b):
        parts.append(_summed(doc_of[g], pair, times))
        if len(parts) > 1 and sum(len(p[0]) for p in parts[1:]) > LISTED:
            parts = [_summed(*map(np.concatenate, zip(*parts, strict=True)))]
    doc, pair, times = _summed(*map(np.concatenate, zip(*parts, strict=True)))
    pair_at = np.searchsorted(doc, np.arange(len(rows) + 1))
    for d, r in enumerate(rows):
        n = [int(x[d + 1] - x[d]) for x in (tokens_a, tokens_b, group_at, links)]
        out[r[0]] = (*n, written[written_end[d] : written_end[d + 1] - 1], pair[pair_at[d] : pair_at[d + 1]], times[pair_at[d] : pair_at[d + 1]])
    return out


def token_links(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_a, n_b, n_groups, n_links, groups_sha256, n_pairs and the packed pairs with their times."""
    names = [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = both(first, second)
        for b in _runs(batches):
            found = aligned(b.column(1).to_pylist(), t)
            digest = [hashlib.sha256(f[4]).hexdigest() if f[0] else "" for f in found]
            counts = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest), pa.array([len(f[5]) for f in found], pa.int64()), pa.array([_packed(f[5], f[6]) for f in found], pa.binary())], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pair = n = np.empty(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new = np.concatenate([pair, *held])
            _, p, c = _summed(np.zeros(len(new), np.int8), new, np.concatenate([n, np.ones(len(new) - len(n), np.int64)]))
            return p, c

        size = 0
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(_unpacked(packed, k)[0])
                size += k
                if size > HELD:
                    pair, n = merged()
                    held, size = [], len(pair)
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                        pair = n = np.empty(0, np.int64)
                        size = 0
        yield pa.RecordBatch.from_arrays([*map(pa.array, merged())], names=["pair", "n"])

    return linked.select("n_pairs", "pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The smallest count that at most `most` pairs reach, and those pairs, sorted, with their counts."""
    bands = counts.groupBy(F.floor(F.log2("n")).alias("band")).agg(F.count(F.lit(1)).alias("pairs")).collect()  # 63 rows at most
    least, total = 1 << 62, 0
    for r in sorted(bands, key=lambda r: -r["band"]):
        total += r["pairs"]
        if total > most:
            break
        least = 1 << r["band"]
    found = counts.filter(F.col("n") >= least).toArrow()  # `most` rows at most
    pair, n = found.column("pair").to_numpy(), found.column("n").to_numpy()
    at = np.argsort(pair)
    return least, pair[at], n[at]


def link_statistics(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """Per row: the key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()
    linked = saved(token_links(docs, first, second, key, text).withColumn("_row", F.monotonically_increasing_id()))
    counts = saved(pair_counts(linked))
    least, pair, n = _head(counts, head)
    top = counts.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("n").alias("n")).toArrow()  # a row per id of the first vocabulary
    best = np.zeros(1 + max(top.column("a").to_pylist(), default=0), np.int64)
    best[top.column("a").to_numpy()] = top.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((pair, n, best))
    plain = [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for b in batches:
            sums, rest = [], [np.empty((0, 3), np.int64)]
            for size, packed in zip(b.column("n_pairs").to_pylist(), b.column("pairs").to_pylist(), strict=True):
                p, times = _unpacked(packed, size)
                at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
                known = pair[at] == p if len(pair) else np.zeros(len(p), bool)
                count, top = n[at[known]], best[p // width]
                sums.append((int(times[known][count == top[known]].sum()), int((times[known] * count).sum())))
                rest.append(np.stack([p[~known], times[~known], top[~known]], axis=1))
            ends = pa.array(np.cumsum([len(r) for r in rest]), pa.int32())
            flat = pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(rest).T], names=["pair", "times", "top"])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in plain), *(pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)), pa.ListArray.from_arrays(ends, flat)], names=[*plain, "n_best", "count_sum", "rest"])

    kind = docs.schema[key].dataType.simpleString()
    part = saved(linked.mapInArrow(run, f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _row long, n_best long, count_sum long, rest array<struct<pair: long, times: long, top: long>>"))
    rare = part.select("_row", F.explode("rest").alias("x")).select("_row", "x.*").join(counts.filter(F.col("n") < least), "pair")
    more = rare.groupBy("_row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("times")).alias("sum"))
    full = part.drop("rest").join(more, "_row", "left")
    return full.select(key, "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def brute_force(rows: list[tuple[int, str | None]], first: str, second: str) -> dict[int, tuple]:
    """The same by the libraries and byte by byte, for a few rows."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
    one.encode_special_tokens = True
    t = both(first, second)
    raw = [[t.bytes_of[k][0][s : s + n].tobytes() for s, n in zip(*t.bytes_of[k][1:], strict=True)] for k in (0, 1)]
    found, in_docs = {}, defaultdict(set)
    for key, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        if not text or any(b"".join(raw[k][i] for i in ids) != b" " + text.encode() for k, ids in ((0, a), (1, b))):
            found[key] = (0, 0, [], [])
            continue
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        while i < len(a):
            x, y = [a[i]], [b[j]]
            at_a, at_b, i, j = at_a + len(raw[0][a[i]]), at_b + len(raw[1][b[j]]), i + 1, j + 1
            while at_a != at_b:
                if at_a < at_b:
                    x.append(a[i])
                    at_a, i = at_a + len(raw[0][a[i]]), i + 1
                else:
                    y.append(b[j])
                    at_b, j = at_b + len(raw[1][b[j]]), j + 1
            groups.append((x, y))
        links = [(p, q) for x, y in groups for p in x for q in y]
        found[key] = (len(a), len(b), groups, links)
        for pair in links:
            in_docs[pair].add(key)
    top = defaultdict(int)
    for (p, _), keys in in_docs.items():
        top[p] = max(top[p], len(keys))
    out = {}
    for key, (na, nb, groups, links) in found.items():
        count = [len(in_docs[x]) for x in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[key] = (na, nb, len(groups), len(links), sum(c == top[x[0]] for c, x in zip(count, links, strict=True)), sum(count), hashlib.sha256(text.encode()).hexdigest() if na else "")
    return out


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return link_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
