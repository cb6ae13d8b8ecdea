"""Confusion counts and error statistics from edit rows (op, noisy, clean).

Everything is a long table; `matrix` pivots for export only. Counts combine before the shuffle, so frequent characters do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.edits import char_ops_udf, word_ops_udf
from glyphlake.functions.profiles import LATIN, Profile

DELETED, INSERTED = "<DEL>", "<INS>"


def edits(pairs: DataFrame, keys: list[str], level: str = "char", noisy: str = "noisy", clean: str = "clean") -> DataFrame:
    """One row per edit, with its place in the pair."""
    ops = (char_ops_udf if level == "char" else word_ops_udf)(noisy, clean)
    return pairs.select(*keys, F.posexplode(ops).alias("op_pos", "e")).select(*keys, F.lit(level).alias("level"), "op_pos", F.col("e.op").alias("op"), F.col("e.noisy").alias("noisy"), F.col("e.clean").alias("clean"))


def confusion(ops: DataFrame, errors_only: bool = False) -> DataFrame:
    """(clean, noisy, n); what is missing on a side has its own label."""
    rows = ops.filter(F.col("op") != "match") if errors_only else ops
    return rows.groupBy(F.when(F.col("op") == "insertion", INSERTED).otherwise(F.col("clean")).alias("clean"), F.when(F.col("op") == "deletion", DELETED).otherwise(F.col("noisy")).alias("noisy")).agg(F.count(F.lit(1)).alias("n"))


def probabilities(counts: DataFrame) -> DataFrame:
    """With `p`, the share within the clean character's row."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("clean")))


def matrix(counts: DataFrame, value: str = "n") -> DataFrame:
    return counts.groupBy("clean").pivot("noisy").agg(F.sum(value)).na.fill(0).orderBy("clean")


def _pair_in(clean: Column, noisy: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.concat_ws("\x1f", clean, noisy).isin(["\x1f".join(p) for p in pairs])


def families(clean: Column, noisy: Column, profile: Profile = LATIN) -> Column:
    """Which families a substitution is of; families overlap. Letters of two scripts are homoglyphs."""
    cyrillic, latin = "[\\u0400-\\u04FF]", "[A-Za-z]"
    crossed = (clean.rlike(cyrillic) & noisy.rlike(latin)) | (clean.rlike(latin) & noisy.rlike(cyrillic))
    marks = list(profile.punctuation)
    return F.struct(_pair_in(clean, noisy, profile.both_ways(profile.diacritics)).alias("is_diacritic"), (_pair_in(clean, noisy, profile.both_ways(profile.homoglyphs)) | crossed).alias("is_homoglyph"), (clean.isin(marks) | noisy.isin(marks)).alias("is_punctuation"))


def family_counts(ops: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Substitutions with their families."""
    counts = ops.filter("op = 'substitution'").groupBy("clean", "noisy").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("clean", "noisy", "n", families(F.col("clean"), F.col("noisy"), profile).alias("f")).select("clean", "noisy", "n", "f.*")


def diacritic_rates(counts: DataFrame) -> DataFrame:
    """Diacritic substitutions with their share of all substitutions and of those of the same character."""
    rows = counts.groupBy("clean", "noisy", "is_diacritic").agg(F.sum("n").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    shared = rows.withColumn("of_source", F.col("n") / F.sum("n").over(Window.partitionBy("clean"))).crossJoin(F.broadcast(total))  # one row
    return shared.filter("is_diacritic").select("clean", "noisy", "n", (F.col("n") / F.col("total")).alias("of_all"), "of_source")


def top(counts: DataFrame, k: int = 30) -> DataFrame:
    return counts.orderBy(F.desc("n"), "clean", "noisy").limit(k)


def heatmap(counts: DataFrame, rows: int = 25, columns: int = 25) -> DataFrame:
    """Counts of the strongest clean characters, and of the strongest noisy ones among those."""
    best = counts.groupBy("clean").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "clean").limit(rows).select("clean")
    left = counts.join(F.broadcast(best), "clean")  # `rows` rows
    wide = left.groupBy("noisy").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "noisy").limit(columns).select("noisy")
    return left.join(F.broadcast(wide), "noisy").select("clean", "noisy", "n")


def op_totals(ops: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda op: F.count_if(F.col("op") == op).alias(op)
    return ops.groupBy(*keys).agg(n("match"), n("substitution"), n("deletion"), n("insertion"))


def rate(match="match", sub="substitution", deleted="deletion", inserted="insertion") -> Column:
    return (F.col(sub) + F.col(deleted) + F.col(inserted)) / F.greatest(F.col(match) + F.col(sub) + F.col(deleted), F.lit(1))


def error_distribution(ops: DataFrame, boundary: DataFrame | None = None, word_ops: DataFrame | None = None) -> DataFrame:
    """One row: percentages of all character edits, and of word edits that are splits and merges."""
    t = op_totals(ops, [])
    total = F.col("match") + F.col("substitution") + F.col("deletion") + F.col("insertion")
    share = lambda c: (100.0 * F.col(c) / F.greatest(total, F.lit(1))).alias(f"{c}_pct")
    out = t.select(total.alias("total_ops"), *[share(c) for c in ("match", "substitution", "deletion", "insertion")])
    if boundary is not None and word_ops is not None:
        counts = boundary.agg(F.count_if(F.col("type") == "split").alias("splits"), F.count_if(F.col("type") == "merge").alias("merges"))
        n = word_ops.agg(F.count(F.lit(1)).alias("n_word_ops"))
        pct = lambda c: (100.0 * F.col(c) / F.greatest("n_word_ops", F.lit(1)))
        out = out.crossJoin(counts.crossJoin(n))  # one row each
        out = out.withColumn("split_pct", pct("splits")).withColumn("merge_pct", pct("merges")).withColumn("structural", F.col("splits") + F.col("merges")).withColumn("structural_pct", pct("structural")).drop("n_word_ops")
    return out


def stratified(ops: DataFrame, key: str, groups: list[str] | None = None) -> DataFrame:
    """Per document: errors, reference length, cer, and whether it is in the upper or lower quarter (linear quantiles)."""
    per = op_totals(ops, [key, *(groups or [])]).withColumn("cer", rate()).withColumn("errors", F.col("substitution") + F.col("deletion") + F.col("insertion")).withColumn("ref_total", F.col("match") + F.col("substitution") + F.col("deletion"))
    q = per.agg(F.percentile("cer", 0.25).alias("q25"), F.percentile("cer", 0.75).alias("q75"))
    out = per.crossJoin(F.broadcast(q))  # one row
    return out.select(key, *(groups or []), "errors", "ref_total", "cer", (F.col("cer") >= F.col("q75")).alias("is_high"), (F.col("cer") <= F.col("q25")).alias("is_low"))


def by_split(ops: DataFrame, split: str, key: str) -> DataFrame:
    t = op_totals(ops, [split, key]).groupBy(split).agg(F.countDistinct(key).alias("n_docs"), *[F.sum(c).alias(c) for c in ("match", "substitution", "deletion", "insertion")])
    return t.withColumn("cer", rate())
