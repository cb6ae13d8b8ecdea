"""Language models as count tables, the edit channel, candidates and the beam corrector."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from glyphlake.functions.edits import edit_ops
from glyphlake.functions.text import LETTERS, shingles, tokens, words
from glyphlake.sources.tables import written

# Fixed values of the models and the corrector.
CHAR_ORDER, ADD_K, TOO_SHORT = 4, 0.1, -5.0
DISCOUNT = 0.75
SUBSTITUTED, INSERTED = -2.0, -3.0
LEXICON, EDITS, POOL, TOP, BEAM = 120_000, 2, 64, 8, 6
BEGIN, END = "<bos>", "<eos>"
WEIGHTS = (1.0, 0.6, 0.3)
FLOOR = 1e-12


def lexicon(texts: DataFrame, text: str = "text", size: int = LEXICON) -> DataFrame:
    """(word, n, len): the most frequent words of letters, in lower case."""
    rows = texts.select(F.explode(tokens(F.lower(text))).alias("word")).filter(F.col("word").rlike(r"^\p{L}+$"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size).withColumn("len", F.length("word"))


# Character model


def char_counts(types: DataFrame, word: str = "word", order: int = CHAR_ORDER) -> DataFrame:
    """(gram, n) of the marked words ^w$."""
    marked = F.concat(F.lit("^"), F.col(word), F.lit("$"))
    return types.select(F.explode(shingles(marked, order)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def char_scores(types: DataFrame, counts: DataFrame, word: str = "word", order: int = CHAR_ORDER, k: float = ADD_K) -> DataFrame:
    """Distinct words with `logp`, the sum over their grams of log((n + k) / (n of the context + k symbols))."""
    context = counts.groupBy(F.substring("gram", 1, order - 1).alias("ctx")).agg(F.sum("n").alias("ctx_n"))
    symbols = counts.agg(F.greatest(F.countDistinct(F.substring("gram", order, 1)), F.lit(1)).alias("v"))
    marked = F.concat(F.lit("^"), F.col(word), F.lit("$"))
    each = types.select(F.col(word)).distinct()
    grams = each.select(word, F.explode(shingles(marked, order)).alias("gram")).withColumn("ctx", F.substring("gram", 1, order - 1))
    joined = grams.join(counts, "gram", "left").join(context, "ctx", "left").crossJoin(F.broadcast(symbols))  # one row
    logp = F.sum(F.log((F.coalesce("n", F.lit(0)) + k) / (F.coalesce("ctx_n", F.lit(0)) + k * F.col("v"))))
    return each.join(joined.groupBy(word).agg(logp.alias("logp")), word, "left").withColumn("logp", F.coalesce("logp", F.lit(TOO_SHORT)))


def perplexity(logp: Column, word: Column) -> Column:
    return -logp / F.greatest(F.lit(1), F.length(word) + 2)


# Word model


def word_counts(texts: DataFrame, text: str = "text", order: int = 3) -> dict[int, DataFrame]:
    """Per order the table (ctx array, w, n) of the padded sentences."""
    padded = F.concat(F.array_repeat(F.lit(BEGIN), order - 1), words(F.lower(text)), F.array(F.lit(END)))
    rows = texts.select(padded.alias("s"))

    def grams(n: int) -> DataFrame:
        return rows.select(F.explode(F.when(F.size("s") >= n, F.transform(F.sequence(F.lit(1), F.size("s") - n + 1), lambda i: F.slice("s", i, n)))).alias("g"))

    out = {}
    for n in range(1, order + 1):
        out[n] = grams(n).select(F.slice("g", 1, n - 1).alias("ctx"), F.element_at("g", -1).alias("w")).groupBy("ctx", "w").agg(F.count(F.lit(1)).alias("n"))
    return out


def kneser_ney(counts: dict[int, DataFrame], queries: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """`p` for rows (ctx, w), ctx being as long as the largest order less one; interpolated with one discount, unrolled as joins."""
    order = max(counts)
    pairs = counts[2]
    seen = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("before"))  # distinct words before w
    totals = pairs.agg(F.count(F.lit(1)).alias("kinds")).crossJoin(counts[1].agg(F.countDistinct("w").alias("v")))
    out = queries.join(seen, "w", "left").crossJoin(F.broadcast(totals))  # one row
    out = out.withColumn("p", (F.coalesce("before", F.lit(0)) + 1) / (F.col("kinds") + F.col("v"))).drop("before", "kinds", "v")
    for n in range(2, order + 1):
        context = counts[n].groupBy("ctx").agg(F.sum("n").alias("ctx_n"), F.count(F.lit(1)).alias("followers")).withColumnRenamed("ctx", "c")
        out = out.withColumn("c", F.slice("ctx", F.size("ctx") - n + 2, n - 1)).join(context, "c", "left")
        out = out.join(counts[n].withColumnRenamed("ctx", "c"), ["c", "w"], "left")
        higher = (F.greatest(F.coalesce("n", F.lit(0)) - discount, F.lit(0.0)) + discount * F.col("followers") * F.col("p")) / F.col("ctx_n")
        out = out.withColumn("p", F.when(F.col("ctx_n").isNull(), F.col("p")).otherwise(higher)).drop("c", "ctx_n", "followers", "n")
    return out


def sentence_scores(texts: DataFrame, key: str, counts: dict[int, DataFrame], text: str = "text") -> DataFrame:
    """Log-probability of each text under the word model."""
    order = max(counts)
    padded = F.concat(F.array_repeat(F.lit(BEGIN), order - 1), words(F.lower(text)), F.array(F.lit(END)))
    rows = texts.select(key, padded.alias("s")).select(key, F.explode(F.transform(F.sequence(F.lit(order), F.size("s")), lambda i: F.struct(F.slice("s", i - order + 1, order - 1).alias("ctx"), F.element_at("s", i).alias("w")))).alias("q"))
    flat = rows.select(key, "q.ctx", "q.w")
    p = kneser_ney(counts, flat.select("ctx", "w").distinct())
    return flat.join(p, ["ctx", "w"]).groupBy(key).agg(F.sum(F.log(F.greatest("p", F.lit(FLOOR)))).alias("logp"))


# Channel


def channel_table(confusions: DataFrame) -> DataFrame:
    """(hyp, noisy, logp): log-probability of reading a character as another, keyed in the channel's direction."""
    w = Window.partitionBy("clean")
    p = confusions.withColumn("p", F.col("n") / F.sum("n").over(w)).filter((F.col("clean") != F.col("noisy")) & (F.length("clean") == 1) & (F.length("noisy") == 1))
    return p.select(F.col("clean").alias("hyp"), "noisy", F.log(F.greatest("p", F.lit(1e-8))).alias("logp"))


def channel_logp(noisy: str, hyp: str, table: dict[tuple[str, str], float]) -> float:
    """Of reading `hyp` as `noisy`; table: by (hyp character, noisy character)."""
    a, b = noisy.lower(), hyp.lower()
    if a == b:
        return 0.0
    return sum(table.get((c, n), SUBSTITUTED) if op == "substitution" else INSERTED for op, n, c in edit_ops(a, b) if op != "match")


def channel_distance(noisy: Column, hyp: Column) -> Column:
    """The channel without a table: by edit distance and length."""
    return F.when(noisy == hyp, 0.0).otherwise(SUBSTITUTED * F.levenshtein(noisy, hyp) + 0.5 * INSERTED * F.abs(F.length(noisy) - F.length(hyp)))


# Candidates

#: Words up to this length meet by what is left after deletions, longer ones by parts that edits leave whole.
SHORT = 20


def _left_after(word: Column, edits: int) -> Column:
    """The distinct strings that up to `edits` deletions of a letter leave."""
    once = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    found = last = F.array(word)
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, once)))
        found = F.concat(found, last)
    return F.array_distinct(found)


def within_edits(words_table: DataFrame, cands: DataFrame, edits: int = EDITS) -> DataFrame:
    """(word, cand, distance) of the pairs within `edits` of each other, from distinct (word) and (cand).

    Two words within k edits leave a common string after k deletions each, so short words join on these. Of k + 1 parts of a long word, one
    is in the other word, at most k places off; so long words join on length, part and its number. No key gathers all words of a length.
    """
    short = lambda df, c: df.filter(F.length(c) <= SHORT + edits).select(c, F.explode(_left_after(F.col(c), edits)).alias("key"))
    parts, n = edits + 1, F.length("cand")
    start = lambda i, n: F.floor(n * i / parts).cast("int")
    own = cands.filter(n > SHORT).select("cand", F.explode(F.array(*[F.concat_ws(":", n, F.lit(i), F.substring("cand", start(i, n) + 1, start(i + 1, n) - start(i, n))) for i in range(parts)])).alias("key"))
    size = F.length("word") + F.col("d")
    shifted = words_table.filter(F.length("word") > SHORT).select("word", F.explode(F.sequence(F.lit(-edits), F.lit(edits))).alias("d")).select("word", size.alias("m"), F.explode(F.sequence(F.lit(-edits), F.lit(edits))).alias("s"))
    other = shifted.select("word", F.explode(F.array(*[F.when(start(i, F.col("m")) + F.col("s") >= 0, F.concat_ws(":", "m", F.lit(i), F.substring("word", start(i, F.col("m")) + F.col("s") + 1, start(i + 1, F.col("m")) - start(i, F.col("m"))))) for i in range(parts)])).alias("key")).distinct()
    met = short(words_table, "word").join(short(cands, "cand"), "key").unionByName(other.join(own, "key")).select("word", "cand")
    return met.withColumn("distance", F.levenshtein("word", "cand", edits)).filter("distance >= 0").distinct()


def candidates(types: DataFrame, lexicon_table: DataFrame, swaps: DataFrame, scores: DataFrame | None = None, edits: int = EDITS, pool: int = POOL, top: int = TOP) -> DataFrame:
    """(word, cand, rank) for distinct words: itself, the lexicon within `edits` of it, and each confusion of a letter swapped; the best by `scores` (word, logp).

    `pool` and `top` are the corrector's own beam sizes.
    """
    alpha = types.filter(F.col("word").rlike(r"^\p{L}+$")).withColumn("low", F.lower("word"))
    lexemes = lexicon_table.withColumnRenamed("word", "cand")
    met = within_edits(alpha.select(F.col("low").alias("word")).distinct(), lexemes.select("cand"), edits).withColumnRenamed("word", "low")
    near = alpha.join(met, "low").join(lexemes, "cand")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.abs(F.length("low") - F.col("len")), F.desc("n"), "cand"))).filter(F.col("r") <= pool).select("word", "cand")
    letters = alpha.select("word", "low", F.explode(F.array_distinct(F.split("low", ""))).alias("noisy"))
    swapped = letters.join(F.broadcast(swaps.select("noisy", "hyp").distinct()), "noisy").select("word", F.expr("replace(low, noisy, hyp)").alias("cand"))  # swaps: all pairs of letters seen, bounded by the alphabet
    own = types.select("word", F.col("word").alias("cand"))
    both = near.unionByName(swapped).unionByName(own).distinct()
    if scores is not None:
        both = both.join(scores.withColumnRenamed("word", "cand"), "cand", "left")
    else:
        both = both.withColumn("logp", F.lit(None).cast("double"))
    order = Window.partitionBy("word").orderBy(F.desc(F.col("cand") == F.col("word")), F.desc_nulls_last("logp"), "cand")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("word", "cand", "logp", "rank")


# Beam


class BackOff:
    """The word model as dicts, for models of a few rows: `corrected` scores n-grams by joins."""

    def __init__(self, rows: list[tuple[list[str], str, int]], discount: float = DISCOUNT):
        self.n: dict[tuple, dict[str, int]] = defaultdict(dict)
        before: dict[str, set] = defaultdict(set)
        for ctx, w, n in rows:
            self.n[tuple(ctx)][w] = n
            if len(ctx) == 1:
                before[w].add(ctx[0])
        self.before = {w: len(s) for w, s in before.items()}
        self.kinds, self.v, self.discount = sum(self.before.values()), len(self.n.get((), {})), discount
        self.totals = {c: sum(f.values()) for c, f in self.n.items()}

    def p(self, ctx: tuple, w: str) -> float:
        p = (self.before.get(w, 0) + 1) / max(self.kinds + self.v, 1)
        for k in range(1, len(ctx) + 1):
            c = ctx[-k:]
            f = self.n.get(c)
            if f:
                p = (max(f.get(w, 0) - self.discount, 0.0) + self.discount * len(f) * p) / self.totals[c]
        return max(p, FLOOR)


def beam(parts: list[str], options: dict[str, list[tuple[str, float]]], lm: BackOff, channel: dict, weights=WEIGHTS, width: int = BEAM) -> list[tuple[float, list[str]]]:
    """Best token sequences by word model, channel and mean character score; the input itself comes last, without the character term."""
    states: list[tuple[float, float, tuple[str, ...]]] = [(0.0, 0.0, ())]
    for token in parts:
        grown = []
        for score, chars, seq in states:
            ctx = tuple(([BEGIN, BEGIN, *(x.lower() for x in seq)])[-2:])
            for cand, logp in options.get(token, [(token, 0.0)]):
                step = weights[0] * math.log(lm.p(ctx, cand.lower())) + weights[1] * channel_logp(token, cand, channel)
                grown.append((score + step, chars + logp, (*seq, cand)))
        states = sorted(grown, key=lambda s: (-(s[0] + weights[2] * s[1] / max(len(s[2]), 1)), s[2]))[:width]

    def ended(score: float, seq: tuple) -> float:
        return score + weights[0] * math.log(lm.p(tuple(([BEGIN, BEGIN, *(x.lower() for x in seq)])[-2:]), END))

    found = [(ended(s, seq) + weights[2] * c / max(len(seq), 1), list(seq)) for s, c, seq in states]
    same, ctx = 0.0, (BEGIN, BEGIN)
    for token in parts:
        same += weights[0] * math.log(lm.p(ctx, token.lower()))
        ctx = (ctx[1], token.lower())
    return [*sorted(found, key=lambda x: (-x[0], x[1])), (same + weights[0] * math.log(lm.p(ctx, END)), list(parts))]


CORRECTED = "input string, prediction string, gain double, changed boolean, raised boolean"
PARTS = re.compile(r"\w+|[^\w\s]")


def _decided(parts: list[str], text: str, options: dict, lm, table: dict, known: Callable[[str], int], margin: float, extra: float, weights: tuple) -> tuple[str, float, bool, bool]:
    """(prediction, gain, whether it was taken, whether the margin was raised): the best rival of the input must lead it by the margin, raised where a token is a name or rare."""
    *best, same = beam(parts, options, lm, table, weights)
    rival = next((x for x in best if x[1] != parts), None)
    raised = any(p[:1].isupper() or known(p.lower()) <= 1 for p in parts if p.isalpha())
    need = margin + (extra if raised else 0.0)
    gain = rival[0] - same[0] if rival else 0.0
    taken = rival is not None and gain >= need
    return re.sub(r"\s+([,.;:!?])", r"\1", " ".join(rival[1])) if taken else text, gain, taken, raised


@F.pandas_udf(ArrayType(StringType()))
def parts_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: PARTS.findall(t or ""))


class _Scored:
    """The word model of one sentence: the probabilities that joins found for it."""

    def __init__(self, rows):
        self.found = {(tuple(r["ctx"]), r["w"]): r["p"] for r in rows}

    def p(self, ctx: tuple, w: str) -> float:
        return max(self.found.get((ctx, w), FLOOR), FLOOR)


def corrected(sentences: DataFrame, key: str, text: str, options: DataFrame, counts: dict[int, DataFrame], channel: DataFrame, margin: float = 1.5, extra: float = 1.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(key, input, prediction, gain, changed, raised) by beam search with an accept margin, raised where a token is a name or rare.

    No model goes through the driver: a place has at most TOP candidates, so it asks for at most TOP^3 trigrams, which are scored once each by joins and come
    with their sentence. The channel has a row per pair of letters, bounded by the alphabet, and is broadcast. Null and empty texts stay as they are.
    """
    rows = written(sentences.select(key, text, parts_udf(text).alias("parts")).withColumn("_id", F.monotonically_increasing_id()))
    listed = options.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "cand", F.coalesce("logp", F.lit(TOO_SHORT)).alias("logp")))).alias("cands"))
    known = counts[1].select(F.col("w").alias("low"), F.col("n").alias("known"))
    flat = rows.select("_id", F.posexplode("parts").alias("pos", "word")).withColumn("low", F.lower("word"))
    own = F.array(F.struct(F.lit(0).alias("rank"), F.col("word").alias("cand"), F.lit(0.0).alias("logp")))
    flat = written(flat.join(listed, "word", "left").join(known, "low", "left").withColumn("cands", F.coalesce("cands", own)).withColumn("known", F.coalesce("known", F.lit(0))))
    lows = flat.select("_id", "pos", F.array_distinct(F.concat(F.transform("cands", lambda c: F.lower(c["cand"])), F.array("low"))).alias("w"))
    ends = rows.select("_id", F.size("parts").alias("pos"), F.array(F.lit(END)).alias("w"))
    order, first = Window.partitionBy("_id").orderBy("pos"), F.array(F.lit(BEGIN))
    met = lows.unionByName(ends).select("_id", F.coalesce(F.lag("w", 2).over(order), first).alias("a"), F.coalesce(F.lag("w", 1).over(order), first).alias("b"), "w")
    asked = met.withColumn("a", F.explode("a")).withColumn("b", F.explode("b")).select("_id", F.array("a", "b").alias("ctx"), F.explode("w").alias("w"))
    scored = written(kneser_ney(counts, asked.select("ctx", "w").distinct()).select("ctx", "w", "p"))
    probs = asked.join(scored, ["ctx", "w"]).groupBy("_id").agg(F.collect_set(F.struct("ctx", "w", "p")).alias("probs"))
    places = flat.groupBy("_id").agg(F.collect_set(F.struct("word", "low", "known", "cands")).alias("places"))
    table = sentences.sparkSession.sparkContext.broadcast({(r["hyp"], r["noisy"]): r["logp"] for r in channel.collect()})
    kind = sentences.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, parts, places, probs in zip(b[key], b[text], b["parts"], b["places"], b["probs"], strict=True):
                places = [] if places is None else places
                options = {x["word"]: [(c["cand"], c["logp"]) for c in x["cands"]] for x in places}
                seen = {x["low"]: x["known"] for x in places}
                out.append((k, t, *_decided(list(parts), t, options, _Scored(probs), table.value, lambda w, seen=seen: seen.get(w, 0), margin, extra, weights)))
            yield pd.DataFrame(out, columns=[key, "input", "prediction", "gain", "changed", "raised"])

    whole = rows.join(places, "_id", "left").join(probs, "_id", "left").select(key, text, "parts", "places", "probs")
    return whole.mapInPandas(run, f"`{key}` {kind}, {CORRECTED}")


def is_rare(n: Column) -> Column:
    return F.coalesce(n, F.lit(0)) <= 1


def is_name(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}")


LETTER_CLASS = LETTERS
