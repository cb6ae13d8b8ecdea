"""Byte-level BPE by backtracking, and decoding by an offset table.

A text is cut by the tokenizer's pattern; each new pre-token is encoded left to right: an Aho-Corasick pass finds the longest
vocabulary token at every position, a token is taken if the pair with the one before it is compatible (the two, side by side, would
not have been merged otherwise), else the next shorter prefix is tried, else the last token is taken back. Each position is given up
once at most, so the work is linear in the pre-token. The results are the merges themselves, as the tokenizers library gives them.

Nulls and edge cases: null and empty texts have no ids and decode to the empty text; special tokens written out in a text get
their id, as the library does; any other columns are dropped; repeated rows are encoded each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.words import slices

#: Entries after which a cache starts anew.
CACHE = 400_000

#: The pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Token bytes by id, with one blob and an offset table for decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, model = byte_symbols(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes_of[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.ids, self.merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """All bytes of the ids by one gather."""
        start = self.offsets[ids]
        length = self.offsets[ids + 1] - start
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
        return self.blob[at].tobytes()


class Encoder(Vocabulary):
    def __init__(self, path: str):
        import ahocorasick

        super().__init__(path)
        self.joined = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(self.merges)}
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, c) in self.joined.items():
            self.made.setdefault(c, (rank, a, b))
        self.automaton = ahocorasick.Automaton()
        special = set(self.special.values())
        by_bytes = {b: i for i, b in enumerate(self.bytes_of) if b and i not in special}
        for b, i in by_bytes.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), -1) if i not in special else -1 for i, b in enumerate(self.bytes_of)]
        self.length = [len(b) for b in self.bytes_of]
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, bytes] = {}
        self.pattern = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' texts, side by side, are merged into just these two.

        Both are taken apart from the latest merge back to the first. No merge across the border may come before the merges
        that are still standing on its two sides.
        """
        pair = (left, right)
        known = self.fits.get(pair)
        if known is not None:
            return known
        a, b, limit, fits = left, right, len(self.merges), True
        while True:
            over = self.joined.get((a, b))
            if over is not None and over[0] < limit:
                fits = False
                break
            made_a, made_b = self.made.get(a), self.made.get(b)
            rank_a, rank_b = made_a[0] if made_a else -1, made_b[0] if made_b else -1
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:  # the left one was made later
                a, limit = made_a[2], rank_a
            else:  # made in the same sweep, the left border comes first: a merge over it of the same rank wins
                b, limit = made_b[1], rank_b + 1
        if len(self.fits) >= CACHE:
            self.fits.clear()
        self.fits[pair] = fits
        return fits

    def piece(self, text: str) -> tuple[int, ...]:
        known = self.pieces.get(text)
        if known is not None:
            return known
        raw = text.encode()
        n, s = len(raw), raw.decode("latin-1")
        longest = [-1] * n
        for end, token in self.automaton.iter(s):
            longest[end + 1 - self.length[token]] = token  # later ends are longer
        out: list[int] = []
        at, token, alive = 0, longest[0], bytearray(b"\1") * (n + 1)
        while at < n:
            end = at + self.length[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= self.length[token]
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        found = self.pieces[text] = tuple(out)
        return found

    def chunk(self, text: str) -> bytes:
        """Ids of any text without special tokens, as 32-bit numbers."""
        return np.array([i for p in self.pattern.findall(text) for i in self.piece(p)], np.int32).tobytes()

    #: A space before white space or at the end belongs to what stands around it, so such texts are not cut at spaces.
    AWKWARD = re.compile(r" (?:\s|$)")

    def plain(self, text: str) -> bytes:
        if self.AWKWARD.search(text):
            return self.chunk(text)
        first, *rest = text.split(" ")
        chunks = self.chunks
        if len(chunks) > CACHE:
            chunks.clear()
        for c in set(rest).difference(chunks):
            chunks[c] = self.chunk(" " + c)
        return self.chunk(first) + b"".join(map(chunks.__getitem__, rest))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self.cut and any(t in text for t in self.special):
            parts = [np.array([self.special[p]], np.int32).tobytes() if p in self.special else self.plain(p) for p in self.cut.split(text) if p]
        else:
            parts = [self.plain(text)]
        return np.frombuffer(b"".join(parts), np.int32)


ENCODERS: dict[str, Encoder] = {}
VOCABULARIES: dict[str, Vocabulary] = {}


def encoder(path: str) -> Encoder:
    return ENCODERS.get(path) or ENCODERS.setdefault(path, Encoder(path))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ids (array of int) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in slices(batches, 128):
            ids = [e.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The table with a column `decoded`: the text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    names = [n for n in encoded.columns if n != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = VOCABULARIES.get(path) or VOCABULARIES.setdefault(path, Vocabulary(path))
        for b in slices(batches, 128):
            lists = b.column(names.index(ids))
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = [v.decode(flat[i:j]).decode("utf-8", "replace") for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    fields = ", ".join(f"`{n}` {encoded.schema[n].dataType.simpleString()}" for n in names)
    return encoded.select(*names).mapInArrow(run, f"{fields}, decoded string")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return decode(ids, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
