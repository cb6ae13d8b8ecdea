"""Secret scans: pattern candidates, and a random forest that removes false positives.

Candidates are values assigned to a telling name and long runs of key characters. Each has features of its length, of the transitions
between its character classes, of how much of it common words of the corpus cover, of its path and of the words around it. A random
forest is trained from labelled findings (`labelled` makes a set by fixed formats; any table of its columns can be given instead) and
rates all candidates; those under `THRESHOLD` are false positives.

The labelled set is bounded (`PER_FORMAT` findings per format), and so is the dictionary (`DICTIONARY` hashes, counted over all texts);
all documents are scanned whole.

Nulls and edge cases: null and empty texts have no findings; a null path counts as the empty path; repeated rows give their findings
each; an empty table gives none; any other columns are dropped.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.words import as_long, slices, text_bytes, word_hashes

PER_FORMAT, DICTIONARY, THRESHOLD, SEED = 200, 20_000, 0.5, 7
#: Lists of common words that are merged in one task.
FAN = 16
TREES, DEPTH = 40, 8

# Names that secrets are assigned to, prefixes of known key formats, and words that tell for or against.
NAMES = r"password|passwd|pwd|passphrase|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth[_-]?key|credential|client[_-]?secret|bearer"
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "AIza", "sk-", "sk_live_", "rk_live_", "glpat-", "npm_", "eyJ", "SG.", "-----BEGIN")
TELLING = re.compile(rf"(?i)(?<![a-z])(?:{NAMES}|key|auth|login|user)(?![a-z])")
DOUBTFUL = re.compile(r"(?i)(?<![a-z.@/-])(?:example|sample|dummy|fake|placeholder|test|todo|sha\d*|md5|hash|digest|checksum|commit|uuid|guid|version|card|isbn|phone|order|invoice|image|base64)(?![a-z]|\.[a-z])")
DOUBTFUL_VALUE = re.compile(r"(?i)example|sample|dummy|fake|placeholder|changeme|your|test|todo|xxx")
TEST_PATH = re.compile(r"(?i)test|spec|example|sample|mock|fixture|doc|vendor|node_modules|lock")
NAMED = re.compile(rf"(?i){NAMES}")
# Possessive loops from a left border only, so that long runs take linear time; a name is looked for in the run before the sign.
BEFORE_SIGN = re.compile(r"(?i)(?<![a-z0-9_-])[a-z0-9_-]++(?=[\"']?\s{0,3}[=:])")
ASSIGNED = re.compile(r"[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?([^\s\"'`,;<>()]{6,})")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)
ROUND = 40
DIGITS = tuple("0123456789")
ASSIGN_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, rule), without overlaps: key blocks and assigned values, and long runs with a digit or a known prefix apart from them."""
    digits = any(d in text for d in DIGITS)
    known = any(p in text for p in PREFIXES)
    found: list[tuple[int, int, str]] = []
    if "-----BEGIN" in text:
        found += [(m.start(), m.end(), "key_block") for m in BLOCK.finditer(text)]
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        for run in BEFORE_SIGN.finditer(text):
            m = ASSIGNED.match(text, run.end()) if NAMED.search(run[0]) else None
            value = m[1].rstrip(".") if m else ""
            if len(value) >= 6:
                found.append((m.start(1), m.start(1) + len(value), "assigned"))
    out: list[tuple[int, int, str]] = []
    for span in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    runs = []
    if digits or known:
        starts = [x[0] for x in out]
        for m in RUN.finditer(text):
            if m[0].startswith(PREFIXES) or any(c in m[0] for c in DIGITS):
                k = bisect_left(starts, m.end())
                if not k or out[k - 1][1] <= m.start():
                    runs.append((m.start(), m.end(), "run"))
    return sorted(out + runs)


def _classes(value: str) -> str:
    return "".join("l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in value)


PAIRS = [a + b for a in "luds" for b in "luds"]
FEATURES = ["length", "entropy", "distinct", *[f"to_{p}" for p in PAIRS], "hex", "prefix", "covered", "path_depth", "path_test", "assigned", "quoted", "telling", "doubtful", "doubtful_value"]


def features(value: str, before: str, after: str, path: str, rule: str, dictionary: frozenset[int] | set[int]) -> list[float]:
    """Numbers that the forest judges by; dictionary: hashes of common words."""
    n = len(value)
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values()) if n else 0.0
    kinds = _classes(value)
    moves = Counter(map("".join, zip(kinds, kinds[1:], strict=False)))
    words = re.findall(r"[a-z]{3,}", value.lower())
    h = word_hashes()
    covered = sum(len(w) for w in words if h[w.encode()] in dictionary) / max(n, 1)
    return [float(min(n, 200)), entropy, len(counts) / max(n, 1), *[moves[p] / max(n - 1, 1) for p in PAIRS], float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))), float(value.startswith(PREFIXES)), covered, float(path.count("/")), float(bool(TEST_PATH.search(path))), float(rule == "assigned"), float(before[-1:] in "\"'`" and before != ""), float(bool(TELLING.search(before))), float(bool(DOUBTFUL.search(before) or DOUBTFUL.search(after))), float(bool(DOUBTFUL_VALUE.search(value)))]


def labelled(per_format: int = PER_FORMAT, seed: int = SEED) -> list[tuple[str, str, str, str, str, int]]:
    """Labelled findings by format: value, text before and after, path, rule, label (1: a secret)."""
    r = random.Random(seed)
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    word = lambda: "".join(r.choice(["the", "an", "er", "in", "tion", "re", "on", "ing", "st", "ment", "que", "de", "ung", "sch", "do", "ar"]) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(3, 6)))[-ROUND:]
    path = lambda: r.choice(["", f"src{r.randint(0, 99)}", "app/config.py", "deploy/values.yaml", ".env", "lib/main.go"])
    name = lambda: r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "DB_PASSWORD", "auth_key"])
    secret = [
        lambda: ("AKIA" + some(upper + "234567", 16), prose() + " ", " " + prose(), "run"),
        lambda: (some(hexa, r.choice([18, 20, 24, 32, 40, 64])), f'{prose()} {name()}{r.choice(["=", " = ", ": "])}', " " + prose(), "assigned"),
        lambda: (some(hexa, r.choice([32, 40, 64])), f'{prose()} {name()} = "', '" ' + prose(), "assigned"),
        lambda: (some(lower + upper + digit, r.randint(10, 40)), f'{name()}{r.choice(["=", ": ", " = "])}', "\n" + prose(), "assigned"),
        lambda: (some(lower + upper + digit + "!@#%^&*", r.randint(8, 20)), f'{name()}{r.choice(["=", ": ", " = "])}', " " + prose(), "assigned"),
        lambda: (r.choice(["ghp_", "gho_", "npm_"]) + some(lower + upper + digit, 36), prose() + " ", " " + prose(), "run"),
        lambda: ("AIza" + some(lower + upper + digit + "_-", 35), prose() + " ", " " + prose(), "run"),
        lambda: (r.choice(["sk-", "sk_live_", "xoxb-", "glpat-"]) + some(lower + upper + digit, r.randint(20, 48)), prose() + " ", " " + prose(), "run"),
        lambda: (some(lower + upper + digit + "+/", 40), f"{name()} {prose()} ", " " + prose(), "run"),
    ]
    false = [
        lambda: (r.choice("3456") + some(digit, r.randint(11, 18)), prose() + " ", " " + prose(), "run"),
        lambda: ("-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), r.choice(["id ", "uuid: ", prose() + " "]), " " + prose(), "run"),
        lambda: (some(hexa, r.choice([32, 40, 64])), r.choice(["sha256: ", "commit ", "checksum ", "md5 digest "]), " " + prose(), "run"),
        lambda: (word() + word() + word() + some(digit, r.randint(1, 4)), prose() + " ", " " + prose(), "run"),
        lambda: (word() + "-" + word() + "-" + word() + "-" + some(digit, r.randint(1, 4)), prose() + " ", " " + prose(), "run"),
        lambda: (r.choice(["changeme", "your_token_here", "xxxxxxxxxxxx", "<password>", "example123", "placeholder", "test1234", "dummy-key-123"]), f"{name()}=", " " + prose(), "assigned"),
        lambda: (word() + word(), f"{name()}: ", " " + prose(), "assigned"),
        lambda: (f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}_{word()}_{r.randint(1, 99)}", prose() + " ", " " + prose(), "run"),
        lambda: ("/".join(word() for _ in range(4)) + "/" + str(r.randint(1, 999)), r.choice(["see ", prose() + " "]), " " + prose(), "run"),
        lambda: (r.choice("0123456789=-_") * r.randint(16, 40), prose() + " ", "\n" + prose(), "run"),
        lambda: (some(hexa, r.choice([32, 40])), f'{name()} = "', '" example ' + prose(), "assigned"),
    ]
    rows = []
    for label, formats in ((1, secret), (0, false)):
        for make in formats:
            for _ in range(per_format):
                value, before, after, rule = make()
                where = r.choice(["tests/fixtures/data.py", "docs/example.md"]) if label == 0 and r.random() < 0.3 else path()
                rows.append((value, before[-ROUND:], after[:ROUND], where, rule, label))
    return rows


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[int]:
    """Hashes of the most common words, by their counts over all texts and then by hash, however the texts are dealt.

    Tasks keep `size` words each, which are merged FAN tasks at a time: no task and not the driver gets more than FAN times `size` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            parts = [word_hashes().of(t.lower().split()) for t in b.column(0).to_pylist() if t]
            if parts:
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(n)], names=["word", "n"])

    counts = text_bytes(docs, text=text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            word, n = np.concatenate([word, b.column(0).to_numpy()]), np.concatenate([n, b.column(1).to_numpy()])
            if len(word) > 4 * size:
                at = np.lexsort((word, -n))[:size]
                word, n = word[at], n[at]
        at = np.lexsort((word, -n))[:size]
        yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(n[at])], names=["word", "n"])

    kept, parts = counts.mapInArrow(best, "word long, n long"), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // FAN)
        kept = kept.repartition(parts).mapInArrow(best, "word long, n long")
    return [r["word"] for r in sorted(kept.collect(), key=lambda r: (-r["n"], r["word"]))][:size]


def scanned(docs: DataFrame, common: list[int], key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per candidate: the key, rule, start, end (code points) and features (array)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(common, np.int64).view(np.uint64).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = frozenset(shared.value)
        for b in slices(batches):
            rows, rule, start, end, feats = [], [], [], [], []
            for i, (p, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for a, z, kind in candidates(t or ""):
                    rows.append(i)
                    rule.append(kind)
                    start.append(a)
                    end.append(z)
                    feats.append(features(t[a:z], t[max(0, a - ROUND) : a], t[z : z + ROUND], p or "", kind, words))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(rule, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(feats, pa.list_(pa.float64()))], names=[key, "rule", "start", "end", "features"])

    place = F.col(path).cast("string") if path else F.lit("")
    return docs.select(key, place.alias("_path"), text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, rule string, start int, end int, features array<double>")


def forest(spark: SparkSession, common: list[int], findings: list[tuple] | None = None, seed: int = SEED):
    """The trained model, from labelled findings as `labelled` gives them."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    words = frozenset(np.array(common, np.int64).view(np.uint64).tolist())
    rows = [(features(v, before, after, path, rule, words), float(label)) for v, before, after, path, rule, label in findings or labelled()]
    table = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(table)


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per candidate: the key, rule, start, end, score and is_secret."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    common = dictionary(docs, text)
    model = forest(docs.sparkSession, common)
    rated = model.transform(scanned(docs, common, key, text, path).withColumn("features", array_to_vector("features")))
    score = vector_to_array("probability")[1]
    return rated.select(key, "rule", "start", "end", score.alias("score"), (score >= threshold).alias("is_secret"))


def op1_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), path="source")
