"""A trained channel: a weighted edit transducer fitted by expectation-maximisation, scores by it, and decoding over its lattice.

The channel reads a clean text character by character. Before each character, and at the end, it writes any number of inserted characters, each
with its own probability; then it goes on, and the clean character becomes another, itself, or nothing. For any clean text the probabilities of all
noisy texts add up to 1.

Training is one pass over the pairs a round: forward and backward sums over all edit paths of each pair, expected counts per task, added up by Spark. What
goes through the driver is the table of the channel, (SYMBOLS + 1)^2 numbers at most; rarer characters share one symbol. The likelihood never falls
from round to round. `fine_tuned` starts from a trained channel, takes a part of each step, and keeps a prior that fades.

Decoding looks for the clean texts with the highest product of a character model and of the best edit path. It is a best-first search with an upper bound on
what is left, so its results are exact.

Nulls and edge cases: pairs with a null side, and with a side of no characters that the channel cannot explain, count for nothing; an empty table gives the
channel it started from; long pairs are summed over a band whose width follows from CELLS, which is a lower bound of the likelihood.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions.text import LETTERS
from glyphlake.sources.tables import written

#: Characters with a symbol of their own; cells of a batch's grids; pairs of a batch.
SYMBOLS, CELLS, PAIRS = 512, 1 << 21, 64
#: Part of a step, of the prior that is left each round, and of an untrained channel to begin with, in fine-tuning.
RATE, FADING, BLANK = 0.3, 0.5, 0.05
#: Rounds at most, and the gain of the log-likelihood per pair under which they end.
ROUNDS, GAIN = 12, 1e-3
NEVER = -np.inf
#: Log-probability of what the channel cannot do, where a finite score is asked for.
IMPOSSIBLE = -1e4


@dataclass
class Channel:
    """sigma[c, o]: what a clean symbol becomes, the last column being nothing; iota[o]: what is inserted. The last symbol stands for all rarer ones."""

    symbols: list[str]
    sigma: np.ndarray
    iota: np.ndarray
    index: dict[str, int] = field(init=False, repr=False)

    def __post_init__(self):
        self.index = {c: i for i, c in enumerate(self.symbols)}

    @property
    def other(self) -> int:
        return len(self.symbols)

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms: of going on and becoming, and of being inserted."""
        with np.errstate(divide="ignore"):
            return np.log(self.sigma) + math.log(max(1.0 - self.iota.sum(), 1e-300)), np.log(self.iota)

    def numbers(self, text: str) -> np.ndarray:
        return np.array([self.index.get(c, self.other) for c in text], np.int64)

    def table(self, spark: SparkSession) -> DataFrame:
        """(clean, noisy, p): all that is possible; '' stands for nothing, and '\\ufffd' for rarer characters."""
        names = [*self.symbols, "�"]
        rows = [(names[c], [*names, ""][o], float(self.sigma[c, o])) for c, o in zip(*np.nonzero(self.sigma), strict=True)] + [("", names[o], float(self.iota[o])) for o in np.flatnonzero(self.iota)]
        return spark.createDataFrame(rows, "clean string, noisy string, p double")

    def pruned(self, least: float) -> Channel:
        """Without what has a probability under `least`; what is left adds up to 1 again."""
        sigma = np.where(self.sigma >= least, self.sigma, 0.0)
        rows = sigma.sum(1, keepdims=True)
        return Channel(self.symbols, np.where(rows > 0, sigma / np.where(rows > 0, rows, 1), np.eye(*sigma.shape)), np.where(self.iota >= least / 10, self.iota, 0.0))

    @staticmethod
    def of(table: DataFrame) -> Channel:
        """The channel that `table` gave; the table has (SYMBOLS + 1)^2 rows at most."""
        rows = [(r["clean"], r["noisy"], r["p"]) for r in table.collect()]
        names = sorted({x for r in rows for x in r[:2]} - {"", "�"})
        at = {c: i for i, c in enumerate([*names, "�"])}
        sigma, iota = np.zeros((len(at), len(at) + 1)), np.zeros(len(at))
        for c, o, p in rows:
            if c:
                sigma[at[c], at[o] if o else len(at)] = p
            else:
                iota[at[o]] = p
        return Channel(names, sigma, iota)


def untrained(pairs: DataFrame, clean: str = "clean", noisy: str = "noisy", most: int = SYMBOLS, kept: float = 0.9, inserted: float = 0.02) -> Channel:
    """A channel that mostly copies, over the most frequent characters of both sides."""
    both = pairs.select(F.explode(F.array(clean, noisy)).alias("t")).select(F.explode(F.split("t", "")).alias("c")).filter("c <> ''")
    symbols = sorted(r["c"] for r in both.groupBy("c").count().orderBy(F.desc("count"), "c").limit(most).collect())
    n = len(symbols) + 1
    sigma = np.full((n, n + 1), (1.0 - kept) / n)
    sigma[np.arange(n), np.arange(n)] = kept
    return Channel(symbols, sigma, np.full(n, inserted / n))


def _shifted(a: np.ndarray, k: int) -> np.ndarray:
    """a[:, x + k], NEVER where that is outside."""
    out = np.full_like(a, NEVER)
    n = a.shape[1]
    if k >= 0:
        out[:, : n - k] = a[:, k:] if k < n else out[:, : n - k]
    else:
        out[:, -k:] = a[:, :k]
    return out


def path_sums(clean: list[np.ndarray], noisy: list[np.ndarray], logs: tuple[np.ndarray, np.ndarray], weights: np.ndarray | None = None, best: bool = False, band: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-likelihood of each pair over all edit paths (or of its best one), and, with weights, the expected counts of all pairs.

    Counts are (n + 1) x (n + 1) for n symbols: the last column has deletions, the last row insertions. Grids are swept by anti-diagonals, all pairs at once.
    """
    become, insert = logs
    n = len(insert)
    go_on = _log_rest(insert)
    size_c, size_o = np.array([len(x) for x in clean]), np.array([len(x) for x in noisy])
    m, k = int(size_c.max(initial=0)), int(size_o.max(initial=0))
    pad = lambda rows, width: np.stack([np.concatenate([x, np.zeros(width - len(x), np.int64)]) for x in rows]) if width else np.zeros((len(rows), 1), np.int64)
    c, o = pad(clean, m), pad(noisy, k)
    width = m + 1 if band is None else min(m + 1, 2 * band + 1)
    low = [0 if width > m else max(0, min(m + 1 - width, round(d * m / max(m + k, 1)) - width // 2)) for d in range(m + k + 1)]
    add = np.maximum if best else np.logaddexp

    def arcs(d: int):
        i = low[d] + np.arange(width)
        j = d - i
        ok = (i <= size_c[:, None]) & (j >= 0) & (j <= size_o[:, None])
        ci, oj = c[:, np.clip(i - 1, 0, c.shape[1] - 1)], o[:, np.clip(j - 1, 0, o.shape[1] - 1)]
        some_c, some_o = ok & (i >= 1), ok & (j >= 1)
        return ci, oj, np.where(some_o, insert[oj], NEVER), np.where(some_c, become[ci, n], NEVER), np.where(some_c & some_o, become[ci, oj], NEVER)

    start = np.full((len(clean), width), NEVER)
    start[:, 0] = 0.0  # low[0] is 0
    forward, end = [start], np.full(len(clean), NEVER)
    for d in range(1, m + k + 1):
        _, _, ins, gone, sub = arcs(d)
        now = add(_shifted(forward[d - 1], low[d] - low[d - 1]) + ins, _shifted(forward[d - 1], low[d] - 1 - low[d - 1]) + gone)
        if d > 1:
            now = add(now, _shifted(forward[d - 2], low[d] - 1 - low[d - 2]) + sub)
        forward.append(now)
    for d in np.unique(size_c + size_o):
        for b in np.flatnonzero(size_c + size_o == d):
            if 0 <= size_c[b] - low[d] < width:
                end[b] = forward[d][b, size_c[b] - low[d]] + go_on
    if weights is None:
        return end, None
    fine = np.isfinite(end)
    finite = np.where(fine, end, 0.0)
    codes, mass = [], []
    backward = {d: np.full((len(clean), width), NEVER) for d in (m + k, m + k - 1, m + k - 2)}
    for d in range(m + k, 0, -1):
        here = backward.pop(d)
        backward.setdefault(d - 2, np.full((len(clean), width), NEVER))
        for b in np.flatnonzero(fine & (size_c + size_o == d)):
            here[b, size_c[b] - low[d]] = go_on
        ci, oj, ins, gone, sub = arcs(d)
        for arc, code, back, drop in ((ins, n * (n + 1) + oj, 1, 0), (gone, ci * (n + 1) + n, 1, 1), (sub, ci * (n + 1) + oj, 2, 1)):
            if d - back < 0:
                continue
            move = low[d] - drop - low[d - back]
            through = arc + here
            backward[d - back] = np.logaddexp(backward[d - back], _shifted(through, -move))
            share = _shifted(forward[d - back], move) + through - finite[:, None]
            hit = np.isfinite(share) & fine[:, None]
            codes.append(code[hit])
            mass.append((np.exp(share) * weights[:, None])[hit])
    counts = np.bincount(np.concatenate(codes), np.concatenate(mass), (n + 1) ** 2) if codes else np.zeros((n + 1) ** 2)
    return end, counts.reshape(n + 1, n + 1)


def _log_rest(insert: np.ndarray) -> float:
    return math.log(max(1.0 - float(np.exp(insert).sum()), 1e-300))


def _batches(rows: list[tuple], *sides: int) -> Iterator[list[tuple]]:
    """Rows of like lengths together, as many as CELLS allow."""
    held: list[tuple] = []
    for r in sorted(rows, key=lambda r: tuple(len(r[k]) for k in sides)):
        a, b = (max([len(x[k]) for x in [*held, r]]) for k in sides)
        if held and (len(held) == PAIRS or (len(held) + 1) * (a + b + 1) * (a + 1) > CELLS):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def _band(held: list[tuple], *sides: int) -> int | None:
    a, b = (max(len(x[k]) for x in held) for k in sides)
    return None if (a + b + 1) * (a + 1) <= CELLS else max(abs(a - b) + 16, CELLS // (a + b + 1) // 2)


def expected(pairs: DataFrame, channel: Channel, clean: str = "clean", noisy: str = "noisy", weight: str | None = None) -> tuple[np.ndarray, float, float]:
    """Expected counts of a round, the log-likelihood, and the weight of the pairs that have one."""
    spark, n = pairs.sparkSession, channel.other + 1
    shared = spark.sparkContext.broadcast(channel)  # bounded by SYMBOLS
    rows = pairs.select(F.col(clean).alias("c"), F.col(noisy).alias("o"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).filter("c is not null and o is not null and w > 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ch = shared.value
        logs, total = ch.logs(), np.zeros((n + 1) ** 2 + 2)
        for b in batches:
            listed = [(ch.numbers(x), ch.numbers(y), w) for x, y, w in zip(b["c"], b["o"], b["w"], strict=True)]
            for held in _batches(listed, 0, 1):
                w = np.array([x[2] for x in held])
                like, counts = path_sums([x[0] for x in held], [x[1] for x in held], logs, w, band=_band(held, 0, 1))
                fine = np.isfinite(like)
                total[:-2] += counts.ravel()
                total[-2:] += (w[fine] * like[fine]).sum(), w[fine].sum()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    found = np.zeros((n + 1) ** 2 + 2)
    for r in rows.mapInPandas(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        found[r["at"]] = r["n"]
    return found[:-2].reshape(n + 1, n + 1), float(found[-2]), float(found[-1])


def maximised(counts: np.ndarray, pairs: float) -> tuple[np.ndarray, np.ndarray]:
    """sigma and iota from counts; a symbol that never was keeps to itself."""
    n = len(counts) - 1
    became, inserted = counts[:n], counts[n, :n]
    rows = became.sum(1, keepdims=True)
    sigma = np.where(rows > 0, became / np.where(rows > 0, rows, 1), np.eye(n, n + 1))
    went_on = became.sum() + pairs  # once for each clean character and once at the end of each text
    return sigma, inserted / (inserted.sum() + went_on) if went_on else inserted


def trained(pairs: DataFrame, start: Channel | None = None, clean: str = "clean", noisy: str = "noisy", weight: str | None = None, rounds: int = ROUNDS, gain: float = GAIN, rate: float = 1.0, prior: np.ndarray | None = None, fading: float = FADING) -> tuple[Channel, list[float]]:
    """The channel after rounds of expectation-maximisation, and the log-likelihood before each and at the end.

    `rate` is the part of each step that is taken: the likelihood still never falls, as the expected log-likelihood is concave. `prior` are counts that
    are added to those of a round; `fading` of them is left after it.
    """
    pairs = written(pairs)
    channel, seen = start or untrained(pairs, clean, noisy), []
    for k in range(rounds + 1):
        counts, like, n = expected(pairs, channel, clean, noisy, weight)
        seen.append(like)
        if k == rounds or not n or (k and prior is None and like - seen[-2] < gain * n):
            break
        if prior is not None:
            counts = counts + prior
            prior = prior * fading if prior.sum() * fading > gain else None
        sigma, iota = maximised(counts, n)
        channel = Channel(channel.symbols, (1 - rate) * channel.sigma + rate * sigma, (1 - rate) * channel.iota + rate * iota)
    return channel, seen


def fine_tuned(synthetic: DataFrame, real: DataFrame, clean: str = "clean", noisy: str = "noisy", rounds: int = ROUNDS, rate: float = RATE, weight: float = 1.0) -> tuple[Channel, list[float], list[float]]:
    """Trained on synthetic pairs, then on real ones by steps of `rate` from there, with `weight` pairs' worth of the synthetic counts as a fading prior."""
    blank = untrained(synthetic.select(clean, noisy).unionByName(real.select(clean, noisy)), clean, noisy)
    first, before = trained(synthetic, blank, clean, noisy, rounds=rounds)
    # What synthetic pairs never show stays possible.
    first = Channel(first.symbols, (1 - BLANK) * first.sigma + BLANK * blank.sigma, (1 - BLANK) * first.iota + BLANK * blank.iota)
    counts, _, n = expected(synthetic, first, clean, noisy)
    second, after = trained(real, first, clean, noisy, rounds=rounds, rate=rate, prior=counts * (weight / n) if n else None)
    return second, before, after


REGIMES = ("real_only", "synthetic_only", "synthetic_plus_real")


def of_regime(regime: str, synthetic: DataFrame, real: DataFrame, clean: str = "clean", noisy: str = "noisy", rounds: int = ROUNDS) -> Channel:
    if regime == "synthetic_plus_real":
        return fine_tuned(synthetic, real, clean, noisy, rounds)[0]
    if regime not in REGIMES:
        raise ValueError(regime)
    return trained(real if regime == "real_only" else synthetic, None, clean, noisy, rounds=rounds)[0]


# The character model of the clean side


@dataclass
class CharModel:
    """Character n-grams with a count added to each, over texts that begin with order - 1 marks and end with one."""

    counts: dict[str, float]
    order: int
    k: float
    symbols: int

    BEGIN, END = "\x02", "\x03"

    def __post_init__(self):
        self.context: dict[str, float] = {}
        for g, n in self.counts.items():
            self.context[g[:-1]] = self.context.get(g[:-1], 0.0) + n

    def logp(self, context: str, c: str) -> float:
        return math.log((self.counts.get(context + c, 0.0) + self.k) / (self.context.get(context, 0.0) + self.k * self.symbols))

    def bounds(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the log-probability of each of `names`, and of any other character, and of the end, by the character before.

        Rows: the names, the begin, any other character. An n-gram that was never seen has at most the share of a context that was never seen.
        """
        n, at = len(names), {c: i for i, c in enumerate(names)}
        unseen = -math.log(self.symbols)
        follow, last = np.full((n + 2, n + 1), unseen), np.full(n + 2, unseen)
        for g in self.counts:
            p = self.logp(g[:-1], g[-1])
            rows = range(n + 2) if self.order == 1 else [n if g[-2] == self.BEGIN else at.get(g[-2], n + 1)]
            for r in rows:
                if g[-1] == self.END:
                    last[r] = max(last[r], p)
                else:
                    c = at.get(g[-1], n)
                    follow[r, c] = max(follow[r, c], p)
        return follow, last


def char_model(types: DataFrame, word: str = "word", n: str | None = "n", order: int = 4, k: float = 0.1, limit: int = 500_000) -> CharModel:
    """Of distinct words, each counted `n` times. The order falls until the n-grams are at most `limit`; at order 1 they are as many as characters."""
    weight = F.col(n) if n else F.lit(1)
    while True:
        marked = F.concat(F.lit(CharModel.BEGIN * (order - 1)), F.col(word), F.lit(CharModel.END))
        grams = types.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(marked) - order + 1), lambda i: F.substring(marked, i, F.lit(order)))).alias("g"), weight.cast("double").alias("n"))
        found = written(grams.groupBy("g").agg(F.sum("n").alias("n")))
        if order == 1 or found.count() <= limit:
            break
        order -= 1
    counts = {r["g"]: r["n"] for r in found.collect()}
    return CharModel(counts, order, k, max(1, len({g[-1] for g in counts})))


# Decoding


class Lattice:
    """Clean texts for a noisy one. A state is a place in the noisy text and the text written so far."""

    def __init__(self, channel: Channel, model: CharModel, channel_weight: float = 1.0):
        self.ch, self.lm, self.lam = channel, model, channel_weight
        become, insert = channel.logs()
        self.go_on, self.insert = channel_weight * _log_rest(insert), channel_weight * insert
        fine = np.isfinite(become)
        scaled = np.where(fine, channel_weight * np.where(fine, become, 0.0), NEVER)
        n, names = channel.other, channel.symbols
        self.sources = [[(names[c], float(scaled[c, o])) for c in np.flatnonzero(np.isfinite(scaled[:n, o]))] for o in range(n + 1)]
        self.lost = [(names[c], float(scaled[c, n + 1])) for c in np.flatnonzero(np.isfinite(scaled[:n, n + 1]))]
        self.kept_other = float(scaled[n, n])
        #: Upper bounds of writing c after p, of the end after p, and of each of the channel's steps; the last p stands for all other characters, the one before for the begin.
        follow, self.last = model.bounds(names)
        self.become_bound = follow[:, None, :] + scaled.T[None, :, :]  # p, o, c; the last o being nothing
        self.lost_bound = self.become_bound[:, n + 1, :]

    def left(self, at: np.ndarray) -> np.ndarray:
        """[j, p]: upper bound of what the rest of the noisy text can score where j of its characters are done and p was written last."""
        n = self.ch.other
        out = np.full((len(at) + 1, n + 2), NEVER)
        rows = [*range(n), n + 1]  # what c is called as the character before
        for j in range(len(at), -1, -1):
            if j == len(at):
                h = self.go_on + self.last
            else:
                h = np.maximum(self.insert[at[j]] + out[j + 1], (self.become_bound[:, at[j], :] + out[j + 1][rows]).max(1))
            while True:  # characters written for nothing, any number of them
                more = np.maximum(h, (self.lost_bound + h[rows]).max(1))
                if (more <= h + 1e-12).all():
                    break
                h = more
            out[j] = h
        return out

    def best(self, noisy: str, k: int = 1, most_states: int | None = None) -> list[tuple[str, float]]:
        """The k best clean texts and their scores, best first; of equal scores the smaller text. None where no text explains the noisy one. `most_states` ends a search early, None never."""
        at = self.ch.numbers(noisy)
        left, n = self.left(at).tolist(), self.ch.other
        before = lambda t: self.ch.index.get(t[-1], n + 1) if t else n
        order, begin = self.lm.order - 1, CharModel.BEGIN * (self.lm.order - 1)
        heap = [(-left[0][n], "", 0, 0.0, False)] if left[0][n] > NEVER else []
        seen: dict[tuple[int, str], int] = {}
        taken: set[tuple[int, str]] = set()
        out: list[tuple[str, float]] = []
        states = 0
        while heap and len(out) < k:
            _, text, j, score, ended = heapq.heappop(heap)
            if ended:
                if all(t != text for t, _ in out):
                    out.append((text, score))
                continue
            context = (begin + text)[len(begin) + len(text) - order :]
            if (j, text) in taken or seen.get((j, context), 0) >= k:
                continue  # reached before with a better score, or k better texts share all that matters from here on
            taken.add((j, text))
            seen[j, context] = seen.get((j, context), 0) + 1
            states += 1
            if most_states and states > most_states:
                break

            def push(t: str, i: int, s: float) -> None:
                bound = s + left[i][before(t)]
                if bound > NEVER:  # else the rest cannot be explained, however much is written
                    heapq.heappush(heap, (-bound, t, i, s, False))

            if j == len(at):
                s = score + self.go_on + self.lm.logp(context, CharModel.END)
                heapq.heappush(heap, (-s, text, j, s, True))
            else:
                push(text, j + 1, score + float(self.insert[at[j]]))
                if at[j] == self.ch.other:
                    push(text + noisy[j], j + 1, score + self.kept_other + self.lm.logp(context, noisy[j]))
                for c, p in self.sources[at[j]]:
                    push(text + c, j + 1, score + p + self.lm.logp(context, c))
            for c, p in self.lost:
                push(text + c, j, score + p + self.lm.logp(context, c))
        return out

    def path(self, noisy: str, clean: str) -> float:
        """Log-probability of the best edit path."""
        logs = self.ch.logs()
        return self.lam * max(IMPOSSIBLE, float(path_sums([self.ch.numbers(clean)], [self.ch.numbers(noisy)], logs, best=True)[0][0]))

    def written_chars(self, text: str) -> list[float]:
        """Log-probability of each character of a clean text and of its end."""
        marked = CharModel.BEGIN * (self.lm.order - 1) + text + CharModel.END
        return [self.lm.logp(marked[i : i + self.lm.order - 1], marked[i + self.lm.order - 1]) for i in range(len(text) + 1)]


class LatticeScorer:
    """Score of a target for a noisy text, by length, and the log-probabilities of the target's bytes; what `gates.gate_edits` asks of a model."""

    def __init__(self, lattice: Lattice, temperature: float = 1.0):
        self.lattice, self.temperature = lattice, temperature

    def score(self, noisy: str, target: str) -> tuple[float, list[float]]:
        chars = self.lattice.written_chars(target)
        per_byte = [p / len(c.encode()) / self.temperature for p, c in zip(chars, target, strict=False) for _ in c.encode()]
        total = (sum(chars) + self.lattice.path(noisy, target)) / self.temperature
        return total / ((5 + len(per_byte)) / 6) ** 0.6, per_byte


def target_scores(spark: SparkSession, lattice: Lattice, temperature: float = 1.0):
    """A pandas UDF of (noisy, target) with the score of `LatticeScorer`."""
    shared = spark.sparkContext.broadcast(LatticeScorer(lattice, temperature))

    @F.pandas_udf("double")
    def run(noisy: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(a or "", b or "")[0] for a, b in zip(noisy, target, strict=True)], dtype=float)

    return run


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[{LETTERS}]+"), F.lit(0))


def decoded_words(words: DataFrame, lattice: Lattice, word: str = "word", k: int = 4) -> DataFrame:
    """(word, cand, score, confidence, rank) of distinct words; confidence is the candidate's share of the k best.

    Words are searched one by one in their tasks; texts are joined to the table of words, so a frequent word is searched once.
    """
    shared = words.sparkSession.sparkContext.broadcast(lattice)  # a channel of SYMBOLS, and the n-grams that char_model limits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for w in b["word"]:
                found = shared.value.best(w, k)
                top = max((s for _, s in found), default=0.0)
                mass = sum(math.exp(s - top) for _, s in found)
                rows += [(w, c, s, math.exp(s - top) / mass, r + 1) for r, (c, s) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["word", "cand", "score", "confidence", "rank"])

    parts = 4 * words.sparkSession.sparkContext.defaultParallelism  # few rows, each of them a search: not to be gathered in one task
    return words.select(F.col(word).alias("word")).filter("word is not null").distinct().repartition(parts, "word").mapInPandas(run, "word string, cand string, score double, confidence double, rank int")


def corrected_with_logs(texts: DataFrame, key: str, text: str, lattice: Lattice, skip: str | None = None, margin: float = 0.0, k: int = 4) -> DataFrame:
    """(key, input, prediction, score, confidence, gate_decision): each word of letters by its best candidate, where that leads the word itself by the margin.

    Words are decoded in lower case; one that begins with a capital letter gets it back.

    Decisions: headroom_skip where the column `skip` is true, identity where nothing changes, kept_pred_partial where some candidates fail the margin,
    else kept_pred. score is the mean lead of the words taken, confidence the least of their confidences (1 without any).
    """
    rows = written(texts.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), (F.coalesce(F.col(skip), F.lit(False)) if skip else F.lit(False)).alias("_skip")))
    parts = rows.filter("not _skip").select("_row", F.posexplode(_words(F.col("_text"))).alias("_at", "word"))
    capital = F.lower(F.substring("word", 1, 1)) != F.substring("word", 1, 1)
    parts = written(parts.filter(F.col("word").rlike(r"^\p{L}+$")).select("_row", "_at", capital.alias("_capital"), F.lower("word").alias("word")))
    found = written(decoded_words(parts.select("word"), lattice, k=k))
    own = found.filter("cand = word").select("word", F.col("score").alias("same"))
    first = found.filter("rank = 1 and cand <> word").join(own, "word", "left")
    floor = found.groupBy("word").agg(F.min("score").alias("least"))  # a word that is not among its own k best is worse than all of them
    options = first.join(floor, "word").select("word", "cand", "confidence", (F.col("score") - F.coalesce("same", "least")).alias("lead"))
    changes = parts.join(options, "word").withColumn("taken", F.col("lead") >= margin)
    changes = changes.withColumn("cand", F.when(F.col("_capital"), F.concat(F.upper(F.substring("cand", 1, 1)), F.expr("substring(cand, 2)"))).otherwise(F.col("cand")))
    of_row = changes.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.when(F.col("taken"), F.struct("_at", "cand")))).alias("new"), F.avg(F.when(F.col("taken"), F.col("lead"))).alias("score"), F.min(F.when(F.col("taken"), F.col("confidence"))).alias("confidence"), F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("left"))
    out = rows.join(of_row, "_row", "left").withColumn("_parts", _words(F.col("_text")))
    replaced = F.transform("_parts", lambda w, i: F.coalesce(F.element_at("new", i), w))
    # White space and whatever stands between words is kept: the text is cut at its words.
    gaps = F.split("_text", f"[{LETTERS}]+", -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("_parts")), replaced, lambda g, w: F.concat(g, w)), ""), F.element_at(gaps, -1))
    changed = F.coalesce(F.col("taken"), F.lit(0)) > 0
    decision = F.when(F.col("_skip"), "headroom_skip").when(~changed, "identity").when(F.col("left") > 0, "kept_pred_partial").otherwise("kept_pred")
    return out.select(F.col("_key").alias(key), F.col("_text").alias("input"), F.when(changed, joined).otherwise(F.col("_text")).alias("prediction"), F.when(changed, F.col("score")).otherwise(0.0).alias("score"), F.when(changed, F.col("confidence")).otherwise(1.0).alias("confidence"), decision.alias("gate_decision"))


def in_batches(pairs: DataFrame, text: str, budget: int, largest: int | None = None) -> DataFrame:
    """`batch` and `padded`: rows in the order of their bytes, cut so that a batch, padded to its longest row, has `budget` bytes at most.

    Rows of one length class (powers of two) share a budget, so a row wastes less than half of its padding; classes are numbered apart and the
    running number in a class comes from counts per range of a partition, not from one sorted task. A row longer than the budget is a batch of its own.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    rows = pairs.withColumn("_size", size).withColumn("_class", F.ceil(F.log2(F.greatest(F.col("_size"), F.lit(1)))).cast("int"))
    ranged = written(rows.repartitionByRange(F.col("_class"), F.col("_size"), F.xxhash64(text)).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part", "_class").orderBy("_size", text)))
    before = ranged.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = before.withColumn("_before", F.sum("_rows").over(Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_class", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    per = F.greatest(F.lit(1), F.floor(F.lit(largest or budget) / F.pow(F.lit(2.0), F.col("_class"))))
    at = inside.join(F.broadcast(before), ["_class", "_part"]).withColumn("batch", F.concat_ws("-", "_class", F.floor((F.col("_n") + F.col("_before") - 1) / per).cast("long")))  # a row per partition and class
    return at.withColumn("padded", F.max("_size").over(Window.partitionBy("batch")).cast("long")).drop("_size", "_class", "_part", "_n", "_before")
