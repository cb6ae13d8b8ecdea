"""Hierarchical best-fit packing of tokenized documents into sequences of fixed capacity.

`tokenized` cuts documents into pieces of at most `capacity` ids. `pack` deals pieces into bins: each task packs its own pieces
best-fit, bins that are full or nearly so are done, and the underfull ones become items of the next round, in which `fan_in` times
fewer tasks pack them again. Only sizes and keys travel, never ids. No task gets more than about `per_task` items: where underfull
bins are more than that and no longer merge, the rounds end with several groups.

Nulls and edge cases: null text is the empty text, which gives one piece with the end id alone; null or repeated keys are kept as
they are, each input row gives its own pieces; an empty table gives an empty table; other columns of the input are dropped.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.words import OTHERS, forget, saved, slices

CAPACITY = 4096
#: Entries after which the cache of chunks and words starts anew.
CACHE = 400_000
#: Bytes of texts of a task whose distinct chunks are looked up together.
GATHERED = 16 << 20
#: A bin with fewer free places than this is done in its round.
NEARLY = 4


class ChunkIds:
    """Ids of white-space-separated chunks by the tokenizers library, remembered.

    Valid for byte-level tokenizers in lower case whose tokens never span white space, keep letters apart from other characters and normalize each chunk alone. A chunk is taken apart
    into what ends with a letter and the punctuation after it, where it has both; only what is new of these goes to the library.
    """

    #: A byte as the character that stands for it in the vocabulary, where that is another one.
    BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}

    def learn(self, chunks: list[str]) -> None:
        if len(self.known) > self.cache:
            self.known = {"": b""}
        known, model = self.known, self.model
        other = []
        for c in chunks:
            if c not in known:
                # Such words are left as they are by normalizer and pattern, so that only the merges are asked for.
                if c.isalpha() and (c.isascii() or max(c) < "ɐ") and c == c.lower():
                    word = c if c.isascii() else c.encode().decode("latin-1").translate(self.BYTES)
                    known[c] = array("I", [t.id for t in model.tokenize(word)]).tobytes()
                else:
                    other.append(c)
        for c, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[c] = array("I", e.ids).tobytes()

    @staticmethod
    def lower(text: str) -> str:
        """Lower case where the normalizer's is sure to be the same: it takes each character alone, and special tokens before."""
        if "<|" in text or "Σ" in text or "İ" in text:
            return text
        return text.lower()

    def found(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(chunks), self.cache // 2):
            some = chunks[k : k + self.cache // 2]
            self.learn(some)
            out += map(self.known.__getitem__, some)
        return out

    @staticmethod
    def parted(chunks: pa.LargeStringArray) -> tuple[pa.Array, pa.Array]:
        """The chunks without the ASCII punctuation at their ends, and that punctuation; whole and empty where they do not go apart.

        Letters and the punctuation after them are tokens apart, unless the last letter gets a mark in lower case or a special token may be there.
        """
        core = pc.utf8_rtrim(chunks, punctuation)
        last = pc.utf8_slice_codeunits(core, -1, 1 << 30).dictionary_encode()
        letter = pa.array([x.isalpha() and len(x.lower()) == 1 for x in last.dictionary.to_pylist()], pa.bool_()).take(last.indices)
        core = pc.if_else(pc.and_not(letter, pc.match_substring(chunks, "<|")), core, chunks)
        ends = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset :][1 : len(chunks) + 1]
        size = pc.binary_length(chunks).to_numpy() - pc.binary_length(core).to_numpy()
        starts = np.concatenate([[0], np.cumsum(size)])
        tail = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[np.arange(starts[-1]) + np.repeat(ends - starts[1:], size)]
        return core, pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(starts), pa.py_buffer(tail))

    def looked_up(self, chunks: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct chunks."""
        core, tail = self.parted(chunks)
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        ids = pa.array(self.found(both.dictionary.to_pylist()), pa.large_binary()).take(both.indices)
        return pc.binary_join_element_wise(ids[: len(chunks)], ids[len(chunks) :], pa.scalar(b"", pa.large_binary()))

    def encoded(self, lists: list[list[str | None]]) -> Iterator[list[bytes]]:
        """Per list of texts their ids as little-endian unsigned 32-bit numbers. Each distinct chunk of all lists is looked up once; ids are gathered for all its places."""
        split = pc.split_pattern(pa.array([self.lower(t or "").replace("\n", " ") for texts in lists for t in texts], pa.large_string()), " ")
        codes, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        found, at = self.looked_up(codes.dictionary), 0
        for texts in lists:
            own = ends[at : at + len(texts) + 1]
            at += len(texts)
            ids = found.take(codes.indices[own[0] : own[-1]])
            places = np.frombuffer(ids.buffers()[1], np.int64)[own - own[0]].tolist()
            raw = memoryview(ids.buffers()[2] or b"")
            yield [bytes(raw[i:j]) for i, j in zip(places[:-1], places[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return next(self.encoded([texts])) if texts else []


ENCODERS: dict[str, ChunkIds] = {}
OTHERS.append(ENCODERS)


def gathered(batches: Iterator[pa.RecordBatch], size: int = GATHERED) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches of at least `size` bytes, but for the last."""
    some, held = [], 0
    for b in batches:
        if b.num_rows:
            some.append(b)
            held += b.nbytes
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def tokenized(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", cache: int = CACHE) -> DataFrame:
    """Per piece: the key, piece (from 0), start (ids before it), length, ids (binary, little-endian unsigned 32-bit)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        encoder = ENCODERS.get(path) or ENCODERS.setdefault(path, ChunkIds(path, cache))
        end, step = array("I", [end_id]).tobytes(), 4 * capacity
        for b, encoded in ((b, e) for some in gathered(slices(batches)) for b, e in zip(some, encoder.encoded([b.column(1).to_pylist() for b in some]), strict=True)):
            rows, piece, ids = [], [], []
            for i, one in enumerate(encoded):
                one += end
                for k in range(0, len(one), step):
                    rows.append(i)
                    piece.append(k // step)
                    ids.append(one[k : k + step])
            piece = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int32())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(np.array([len(x) // 4 for x in ids], np.int64)), pa.array(ids, pa.binary())],
                names=[key, "piece", "start", "length", "ids"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids binary")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items go in by falling size, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}  # places left -> bins
    mask = 0  # bit r: some bin has r places left
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            k = free[left].pop()
            if not free[left]:
                mask ^= 1 << left
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        left -= size
        if left:
            free.setdefault(left, []).append(k)
            mask |= 1 << left
    return bins


def _merge(table: pa.Table, capacity: int) -> pa.Table:
    """Bins of a round from the bins of the round before; items keep their order in the bin they came in."""
    items, fills = table.column("items").combine_chunks(), table.column("fill").to_pylist()
    if isinstance(items, pa.ChunkedArray):
        items = pa.concat_arrays(items.chunks) if items.num_chunks else pa.array([], table.schema.field("items").type)
    bins = best_fit(fills, capacity)
    order = [i for b in bins for i in b]
    taken = items.take(pa.array(order, pa.int64()))
    counts = np.diff(taken.offsets.to_numpy()) if len(taken) else np.empty(0, int)
    per_bin = np.add.reduceat(counts, np.cumsum([0] + [len(b) for b in bins[:-1]])) if bins else np.empty(0, int)
    merged = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)), taken.flatten())
    return pa.table({"fill": pa.array([sum(fills[i] for i in b) for b in bins], pa.int64()), "items": merged})


def pack(pieces: DataFrame, size: str = "length", capacity: int = CAPACITY, fan_in: int = 8, per_task: int = 20_000) -> DataFrame:
    """The pieces (sizes from 1 to `capacity`) with sequence_id and offset: as few sequences as the rounds find."""
    names = pieces.columns
    item = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in pieces.schema)
    schema = f"fill long, items array<struct<{item}>>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            got.append(b)
            rows += b.num_rows
            if rows >= 10 * per_task:  # memory stays bounded in any partition
                yield from _packed(got)
                got, rows = [], 0
        if rows:
            yield from _packed(got)

    def _packed(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(got).combine_chunks()
        structs = pa.StructArray.from_arrays([t.column(n).combine_chunks() if t.column(n).num_chunks != 1 else t.column(n).chunk(0) for n in names], names=names)
        single = pa.ListArray.from_arrays(pa.array(np.arange(t.num_rows + 1, dtype=np.int32)), structs)
        yield from _merge(pa.table({"fill": t.column(size).cast(pa.int64()), "items": single}), capacity).to_batches()

    bins = saved(pieces.mapInArrow(local, schema))
    groups, done = max(1, bins.rdd.getNumPartitions()), []
    while groups > 1:
        full = F.col("fill") > capacity - NEARLY
        done.append(bins.filter(full))
        rest = bins.filter(~full)
        n = rest.count()
        fewer = max(-(-groups // fan_in), -(-n // per_task))
        if not n or fewer >= groups:
            bins = rest
            break
        groups = fewer
        grouped = rest.withColumn("_group", F.pmod(F.xxhash64(*[F.col("items")[0][c] for c in names]), F.lit(groups))).groupBy("_group")
        bins = saved(grouped.applyInArrow(lambda t: _merge(t, capacity), schema))
    for d in done:
        bins = bins.unionByName(d)
    at = names.index(size)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(1).flatten()
            n = np.diff(b.column(1).offsets.to_numpy())
            length = items.field(at).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(length)])
            first = before[np.cumsum(n) - n]
            yield pa.RecordBatch.from_arrays([*(items.field(k) for k in range(len(names))), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(before[:-1] - np.repeat(first, n))], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return bins.select(F.monotonically_increasing_id().alias("sequence_id"), "items").mapInArrow(spread, f"{fields}, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def packed_documents(docs: DataFrame, path: str, cache: int = CACHE) -> DataFrame:
    pieces = tokenized(docs, path, cache=cache).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(saved(pieces))  # two Python stages in a row would keep twice the workers, each with a cache
