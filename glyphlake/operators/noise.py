"""Deterministic noise: every draw is a hash of key, place and salt, so a run repeats anywhere and under any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.profiles import LATIN, Profile
from glyphlake.functions.text import paragraphs, sentences


def draw(*parts: Column) -> Column:
    """A number from 0 to 1 for the parts: the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def below(p: float, key: Column, at: Column, salt: str) -> Column:
    """Whether `draw` of the three is less than p, told from the digits of the MD5 without making a number of them."""
    least = math.ceil(p * 4294967296)
    return F.lit(True) if least > 0xFFFFFFFF else F.md5(F.concat(key.cast("string"), F.lit(":"), at.cast("string"), F.lit(":" + salt))) < F.lit(f"{max(least, 0):08x}")


def once(c: Column) -> Column:
    """The column as a generator of one row, which filters above do not evaluate again."""
    return F.explode(F.array(c))


def characters(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("pos", "c"))


def _pick(alphabet: str, u: Column) -> Column:
    letters = F.array(*[F.lit(c) for c in alphabet])
    return F.element_at(letters, (F.floor(u * len(alphabet)) + 1).cast("int"))


def noised(df: DataFrame, key: str, text: str, substitute, p_del: float, p_sub: float, p_ins: float, insert=None, salt: str = "noise") -> DataFrame:
    """(key, clean, noisy): each character is dropped, replaced or kept, and may have another after it. substitute, insert: of (char, draw)."""
    noisy = noisy_text(F.col(key), F.col(text), substitute, p_del, p_sub, p_ins, insert, salt)
    return df.select(key, F.col(text).alias("clean"), once(noisy).alias("noisy"))


def noisy_text(key: Column, text: Column, substitute, p_del: float, p_sub: float, p_ins: float, insert=None, salt: str = "noise") -> Column:
    """The text as `noised` makes it, within its row; a null text or key gives the empty text."""

    def changed(c, at):
        other = F.when(below(p_del, key, at, salt), "").otherwise(substitute(c, draw(key, at, F.lit(salt + "s"))))
        first = F.when(below(p_del + p_sub, key, at, salt), other).otherwise(c)
        after = F.when(below(p_ins, key, at, salt + "+"), (insert or substitute)(c, draw(key, at, F.lit(salt + "i")))).otherwise("")
        return F.concat(first, after)

    return F.when(key.isNotNull() & text.isNotNull(), F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), changed), "")).otherwise("")


def uniform(alphabet: str):
    """Substitution by any letter; white space stays."""
    return lambda c, u: F.when(c.rlike(r"^\s$"), c).otherwise(_pick(alphabet, u))


def confusion_noise(df: DataFrame, key: str, text: str, counts: DataFrame, alphabet: str, p_del: float, p_sub: float, p_ins: float, salt: str = "conf") -> DataFrame:
    """Substitutions and insertions drawn from confusion counts (clean, noisy, n); an unseen character takes any letter, an insertion without counts repeats the character."""
    w = Window.partitionBy("clean").orderBy("noisy").rowsBetween(Window.unboundedPreceding, 0)
    p = counts.filter("noisy <> '<DEL>' and clean <> noisy").withColumn("hi", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("clean")))
    table = p.groupBy("clean").agg(F.array_sort(F.collect_list(F.struct("hi", "noisy"))).alias("row"))
    rows = characters(df, key, text).join(table.withColumnRenamed("clean", "c"), "c", "left")
    inserted = table.filter("clean = '<INS>'").agg(F.first("row").alias("inserted"))
    rows = rows.crossJoin(F.broadcast(inserted))  # one row
    pick = lambda row, u: F.filter(row, lambda x: x["hi"] > u)[0]["noisy"]
    at = F.col("pos")
    u, v = draw(F.col(key), at, F.lit(salt)), draw(F.col(key), at, F.lit(salt + "+"))
    s, i = draw(F.col(key), at, F.lit(salt + "s")), draw(F.col(key), at, F.lit(salt + "i"))
    sub = F.when(F.col("c").rlike(r"^\s$"), F.col("c")).otherwise(F.coalesce(pick(F.col("row"), s), _pick(alphabet, s)))
    first = F.when(u < p_del, "").when(u < p_del + p_sub, sub).otherwise(F.col("c"))
    after = F.when(v < p_ins, F.coalesce(pick(F.col("inserted"), i), F.col("c"))).otherwise("")
    joined = rows.select(key, "pos", F.concat(first, after).alias("o")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "o"))), lambda x: x["o"]), "").alias("noisy"))
    return df.select(key, F.col(text).alias("clean")).join(joined, key, "left").withColumn("noisy", F.coalesce("noisy", F.lit("")))


def shifted(c: Column, u: Column, profile: Profile, p_diacritic: float, p_homoglyph: float, p_mark: float) -> Column:
    """One draw for three families, tried in order."""

    def mapped(pairs) -> Column:
        return F.create_map(*[F.lit(x) for p in pairs for x in p])

    d, h, m = mapped(profile.diacritics)[c], mapped(profile.homoglyphs)[c], mapped(profile.shifts)[c]
    return F.when(d.isNotNull() & (u < p_diacritic), d).when(h.isNotNull() & (u < p_homoglyph), h).when(m.isNotNull() & (u < p_mark), m).otherwise(c)


def structured_words(key: Column, text: Column, p_merge: float, p_split: float, salt: str = "struct") -> Column:
    """Text with some neighbours merged and then some words of four letters or more cut; white space becomes one space."""
    parts = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    start = F.struct(F.lit(False).alias("merged"), F.array().cast("array<string>").alias("out"))

    def step(a, i):
        joins = ~a["merged"] & (i > 1) & (draw(key, i, F.lit(salt + "m")) < p_merge)
        word = F.element_at(parts, i)
        grown = F.when(joins, F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.concat(F.element_at(a["out"], -1), word)))).otherwise(F.concat(a["out"], F.array(word)))
        return F.struct(joins.alias("merged"), grown.alias("out"))

    merged = F.when(F.size(parts) > 0, F.aggregate(F.sequence(F.lit(1), F.size(parts)), start, step, lambda a: a["out"])).otherwise(parts)

    def cut(w, i):
        at = (2 + F.floor(draw(key, i, F.lit(salt + "c")) * (F.length(w) - 3))).cast("int")
        hit = w.rlike(r"^\p{L}{4,}$") & (draw(key, i, F.lit(salt + "s")) < p_split)
        return F.when(hit, F.concat(w.substr(F.lit(1), at), F.lit(" "), w.substr(at + 1, F.length(w)))).otherwise(w)

    return F.array_join(F.transform(merged, cut), " ")


def structure_noise(df: DataFrame, key: str, text: str, profile: Profile = LATIN, p_diacritic: float = 0.2, p_homoglyph: float = 0.05, p_mark: float = 0.1, p_merge: float = 0.02, p_split: float = 0.02, salt: str = "struct") -> DataFrame:
    """(key, clean, noisy): families of confusable characters, then merged and split words."""
    rows = characters(df, key, text)
    o = shifted(F.col("c"), draw(F.col(key), F.col("pos"), F.lit(salt)), profile, p_diacritic, p_homoglyph, p_mark)
    joined = rows.select(key, "pos", o.alias("o")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "o"))), lambda x: x["o"]), "").alias("shifted"))
    out = df.select(key, F.col(text).alias("clean")).join(joined, key, "left")
    return out.select(key, "clean", structured_words(F.col(key), F.coalesce("shifted", F.lit("")), p_merge, p_split, salt).alias("noisy"))


def sentence_pairs(docs: DataFrame, key: str, text: str, noise) -> DataFrame:
    """(key, par, pos, clean, noisy) for the sentences of the paragraphs; noise: of (rows with id and clean) to (id, clean, noisy). Empty results go."""
    rows = docs.select(key, F.posexplode(paragraphs(F.col(text))).alias("par", "p")).select(key, "par", F.posexplode(sentences(F.col("p"))).alias("pos", "clean"))
    rows = rows.withColumn("id", F.concat_ws("-", key, "par", "pos"))
    made = noise(rows.select("id", "clean")).select("id", "noisy").filter("noisy <> ''")
    return rows.join(made, "id").drop("id")


def rejoined(pairs: DataFrame, key: str) -> DataFrame:
    """The noisy texts, sentences joined by a space and paragraphs by a blank line."""
    per = pairs.groupBy(key, "par").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "noisy"))), lambda x: x["noisy"]), " ").alias("p"))
    return per.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par", "p"))), lambda x: x["p"]), "\n\n").alias("noisy"))


def calibrated(ops: DataFrame, boundary: DataFrame, texts: DataFrame, text: str = "clean", profile: Profile = LATIN) -> DataFrame:
    """One row of rates: p_del, p_sub, p_ins by reference length, p_split and p_merge by words and gaps, and families by eligible characters."""
    from glyphlake.operators.confusion import families

    n = lambda op: F.count_if(F.col("op") == op)
    ref = F.greatest(F.count_if(F.col("op") != "insertion"), F.lit(1))
    fam = families(F.col("clean"), F.col("noisy"), profile)
    sub = F.col("op") == "substitution"
    rates = ops.agg((n("deletion") / ref).alias("p_del"), (n("substitution") / ref).alias("p_sub"), (n("insertion") / ref).alias("p_ins"), *[F.count_if(sub & fam[f"is_{k}"]).alias(k) for k in ("diacritic", "homoglyph", "punctuation")])
    edges = boundary.agg(F.count_if(F.col("type") == "split").alias("splits"), F.count_if(F.col("type") == "merge").alias("merges"))
    count = lambda chars: F.sum(F.length(text) - F.length(F.translate(text, "".join(chars), "")))
    own = texts.agg(F.sum(F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))).alias("n_words"), count([a for a, _ in profile.diacritics]).alias("e_diacritic"), count([a for a, _ in profile.homoglyphs]).alias("e_homoglyph"), count([a for a, _ in profile.shifts]).alias("e_punctuation"))
    clamp = lambda a, b: F.least(F.lit(1.0), F.coalesce(F.col(a) / F.greatest(b, F.lit(1)), F.lit(0.0)))
    row = rates.crossJoin(edges).crossJoin(own)  # one row each
    return row.select("p_del", "p_sub", "p_ins", clamp("splits", F.col("n_words")).alias("p_split"), clamp("merges", F.col("n_words") - 1).alias("p_merge"), *[clamp(k, F.col(f"e_{k}")).alias(f"p_{k}") for k in ("diacritic", "homoglyph", "punctuation")])


# At training time


def swaps(counts: DataFrame) -> DataFrame:
    """(a, b, n, p) of single characters read as others, from confusion counts; p is of all readings of a."""
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("clean"))).filter("length(clean) = 1 and length(noisy) = 1 and clean <> noisy")
    return p.select(F.col("clean").alias("a"), F.col("noisy").alias("b"), "n", "p")


def training_pairs(pairs: DataFrame, key: str, table: DataFrame, same: float = 0.0, swap: float = 0.25, noisy: str = "noisy", clean: str = "clean") -> DataFrame:
    """(key, clean, noisy): a share `same` becomes identity pairs, and in a share `swap` one letter is swapped by the weights of `swaps`."""
    rows = pairs.select(key, F.col(clean).alias("clean"), F.when(draw(F.col(key), F.lit("same")) < same, F.col(clean)).otherwise(F.col(noisy)).alias("t"))
    letters = F.filter(F.transform(F.split("t", ""), lambda c, i: F.struct(i.alias("at"), c.alias("c"))), lambda x: x["c"].rlike(r"^\p{L}$"))
    place = F.floor(draw(F.col(key), F.lit("place")) * F.size("_letters")).cast("int")
    hit = F.when((F.size("_letters") > 0) & (draw(F.col(key), F.lit("swap")) < swap), F.element_at("_letters", place + 1))
    rows = rows.withColumn("_letters", letters).withColumn("_hit", hit).drop("_letters")
    w = Window.partitionBy("a")
    upto = table.withColumn("hi", F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w))
    lists = upto.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("hi", "b"))).alias("_row"))
    found = rows.join(lists, F.col("_hit.c") == F.col("a"), "left")
    other = F.element_at(F.filter("_row", lambda x: x["hi"] > draw(F.col(key), F.lit("letter"))), 1)["b"]
    at = F.col("_hit.at")
    changed = F.when(F.col("_row").isNotNull(), F.concat(F.substring("t", F.lit(1), at), other, F.col("t").substr(at + 2, F.length("t")))).otherwise(F.col("t"))
    return found.select(key, "clean", changed.alias("noisy"))
