"""The phases as Spark jobs over tables: alignment, error analysis, synthetic noise, and evaluation of correctors.

Each takes and returns tables; nothing but parameters, model sizes and report rows comes to the driver. `stage` skips what is complete for the same content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions import edits
from glyphlake.functions import text as T
from glyphlake.functions.profiles import MACEDONIAN, Profile
from glyphlake.operators import align, boundary, confusion, manifest, models, noise, realism, scripts
from glyphlake.sources import published, tables


def stage(spark: SparkSession, folder: str, name: str, content: dict, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table of this content under <folder>/<name>, made unless a run with it is complete and its table is there whole. Tables of other contents stay."""
    key = manifest.content_hash({"name": name, **content})
    path = f"{folder}/{name}/{key[:16]}"
    if force or not tables.finished(spark, f"{folder}/runs", key) or not tables.exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
        tables.append_run(spark, f"{folder}/runs", {"name": name, "hash": key, "status": "complete"})
    return spark.read.parquet(path)


#: Tables of `alignment`.
ALIGNED = ("pairs", "char_ops", "word_ops", "boundary", "stats", "quality")


def alignment(books: DataFrame, splits: DataFrame, profile: Profile = MACEDONIAN, key: str = "book") -> dict[str, DataFrame]:
    """From (book, noisy, clean) whole texts: pairs, char_ops, word_ops, boundary, stats, quality. Books without a split are `unassigned`."""
    cut = lambda t: T.extracted_sentences(t, profile)
    sentences = align.as_sentences(books, key, "noisy", "noisy", cut).unionByName(align.as_sentences(books, key, "clean", "clean", cut))
    pairs = align.sentence_pairs(sentences, key).join(splits, key, "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))
    pairs = tables.written(pairs)  # all tables come from it, and the sentences are aligned once
    keys = [key, "split", F.col("pos").alias("pair_pos")]
    names = [key, "split", "pair_pos"]
    rows = tables.written(scripts.alignment_rows(pairs.select(*keys, "noisy", "clean"), names))  # each pair is read once for its edits and boundary errors
    chars, words, edges = scripts.edit_rows(rows, names, "char"), scripts.edit_rows(rows, names, "word"), scripts.boundary_rows(rows, names)
    counts = sentences.groupBy(key).agg(F.count_if(F.col("side") == "noisy").alias("n_noisy"), F.count_if(F.col("side") == "clean").alias("n_clean"))
    quality = align.alignment_quality(pairs, counts, key)

    def rates(ops: DataFrame, name: str) -> DataFrame:
        return confusion.op_totals(ops, [key]).select(key, F.bround(confusion.rate(), 4).alias(name))

    stats = counts.join(rates(chars, "cer"), key, "left").join(rates(words, "wer"), key, "left").join(boundary.boundary_statistics(edges, [key]), key, "left")
    return {"pairs": pairs, "char_ops": chars, "word_ops": words, "boundary": edges, "stats": stats, "quality": quality}


def corpus_summary(char_ops: DataFrame, word_ops: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over all books, micro-averaged."""
    one = lambda ops, name: confusion.op_totals(ops, []).select(F.bround(confusion.rate(), 6).alias(name))
    n = edges.agg(F.count_if(F.col("type") == "split").alias("splits"), F.count_if(F.col("type") == "merge").alias("merges"))
    return one(char_ops, "cer").crossJoin(one(word_ops, "wer")).crossJoin(n)  # one row each


def error_analysis(char_ops: DataFrame, word_ops: DataFrame, edges: DataFrame, key: str = "book", profile: Profile = MACEDONIAN) -> dict[str, DataFrame]:
    counts, errors = confusion.confusion(char_ops), confusion.confusion(char_ops, errors_only=True)
    fam = confusion.family_counts(char_ops, profile)
    return {
        "confusion": counts, "confusion_probabilities": confusion.probabilities(counts), "error_confusion": errors, "error_probabilities": confusion.probabilities(errors), "families": fam, "top_substitutions": confusion.top(errors),
        "diacritic_rates": confusion.diacritic_rates(fam), "distribution": confusion.error_distribution(char_ops, edges, word_ops), "documents": confusion.stratified(char_ops, key, ["split"]), "splits": confusion.by_split(char_ops, "split", key),
        "heatmap": confusion.heatmap(errors),
    }


def synthetic_corpus(texts: DataFrame, counts: DataFrame, rates: dict[str, float], alphabet: str, key: str = "book", text: str = "clean", profile: Profile = MACEDONIAN) -> DataFrame:
    """(generator, key, par, pos, clean, noisy) of the three generators."""
    p = (rates["p_del"], rates["p_sub"], rates["p_ins"])
    makers = {
        "random_edit": lambda d: noise.noised(d, "id", "clean", noise.uniform(alphabet), *p, salt="random"),
        "confusion_matrix": lambda d: noise.confusion_noise(d, "id", "clean", counts, alphabet, *p),
        "structure_aware": lambda d: noise.structure_noise(d, "id", "clean", profile, rates["p_diacritic"], rates["p_homoglyph"], rates["p_punctuation"], rates["p_merge"], rates["p_split"]),
    }
    out = None
    for name, make in makers.items():
        rows = noise.sentence_pairs(texts, key, text, make).select(F.lit(name).alias("generator"), key, "par", "pos", "clean", "noisy")
        out = rows if out is None else out.unionByName(rows)
    return out


def realism_by_generator(real: DataFrame, made: DataFrame, key: str = "book") -> DataFrame:
    """One row per generator; real and made have clean and noisy."""
    ops = confusion.edits(real, [key])
    out = None
    for name in sorted(r["generator"] for r in made.select("generator").distinct().collect()):  # three names
        own = made.filter(F.col("generator") == name)
        row = realism.evaluation(ops, confusion.edits(own, [key]), real, own).withColumn("generator", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def manifests(real: DataFrame, synthetic: DataFrame, splits: DataFrame, domains: DataFrame, ratio: float = 4.0) -> dict[str, DataFrame]:
    """The three regimes; raises on duplicates, overlaps and pairs of low quality."""
    good = real.filter(edits.good_pair(F.col("noisy"), F.col("clean"), 0.55, 0.5))
    manifest.check_quality(manifest.pair_quality(synthetic.withColumn("r", edits.ratio_udf("noisy", "clean")), F.col("r"), []))
    a, b = manifest.manifest(good, splits, domains, "real"), manifest.manifest(synthetic, splits, domains, "synthetic")
    out = {"real_only": a, "synthetic_only": b, "synthetic_plus_real": manifest.combined(a, b, ratio)}
    for name, rows in out.items():
        manifest.assert_empty(manifest.duplicates(rows), f"duplicates in {name}")
    return out


def predictions(rows: DataFrame, train: DataFrame, confusions: DataFrame) -> DataFrame:
    """The classical corrector, fitted on train's clean side, over a manifest's rows, with all measures."""
    clean = train.select(F.col("clean").alias("text"))
    lex = models.lexicon(clean)
    channel = models.channel_table(confusions)
    types = rows.select(F.explode(T.tokens(F.col("noisy"))).alias("word")).distinct()
    options = models.candidates(types, lex, channel, models.char_scores(lex.select("word"), models.char_counts(lex)))
    done = models.corrected(rows, "sample_id", "noisy", options, models.word_counts(clean), channel)
    joined = rows.join(done.select("sample_id", "prediction", "gain", F.col("changed").alias("changed_flag")), "sample_id")
    return measured(joined.withColumnRenamed("noisy", "input_noisy"))


def measured(rows: DataFrame) -> DataFrame:
    c, n, p = F.col("clean"), F.col("input_noisy"), F.col("prediction")
    out = rows.withColumn("input_cer", edits.cer(c, n)).withColumn("cer", edits.cer(c, p)).withColumn("wer", edits.wer(c, p)).withColumn("chrf", edits.chrf_udf(c, p)).withColumn("changed", n != p)
    return out.withColumn("error_reduction", edits.reduction(F.col("input_cer"), F.col("cer")))


def identity(rows: DataFrame) -> DataFrame:
    """The baseline: predictions that are the input."""
    return measured(rows.withColumnRenamed("noisy", "input_noisy").withColumn("prediction", F.col("input_noisy")).withColumn("changed_flag", F.lit(False)))


def corpus(spark: SparkSession, raw: str, corrected: str, splits: DataFrame, out: str, profile: Profile = MACEDONIAN) -> dict[str, DataFrame]:
    """Folders of raw and corrected books to the tables of alignment and error analysis under `out`.

    Books are published with all their tables at once; only those are aligned whose files, split or profile have changed. What is known of the
    files tells that before any text is read. The analysis is made anew where any book has changed.
    """
    given = tables.book_versions(spark, raw, corrected).join(splits.select("book", "split"), "book", "left")
    content = given.select("book", F.sha2(F.to_json(F.struct("version", "split", F.lit(repr(profile)).alias("profile"))), 256).alias("digest"))
    names, folder = list(ALIGNED), f"{out}/books"
    known = published.latest(spark, folder, names)
    fresh = tables.written(published.pending(content, known))
    if known is None or not fresh.isEmpty():
        books = tables.book_pairs(spark, raw, corrected).join(fresh.filter("digest is not null").select("book"), "book", "left_semi")
        published.commit(spark, folder, alignment(books, splits, profile), fresh, by=("split",))
        known = published.latest(spark, folder, names)
    aligned = {k: published.read(spark, folder, k, names) for k in ALIGNED}
    key = {"books": published.digest(known)}
    return aligned | {k: stage(spark, out, k, key, lambda v=v: v) for k, v in error_analysis(aligned["char_ops"], aligned["word_ops"], aligned["boundary"], profile=profile).items()}
