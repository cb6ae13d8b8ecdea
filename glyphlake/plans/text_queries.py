"""Queries on cleaning, segmentation, tokens and language models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphlake.functions import text as T
from glyphlake.functions.profiles import LATIN, MACEDONIAN
from glyphlake.operators import align, models
from glyphlake.plans.registry import query, table

W = r"[\p{L}\p{N}_]"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""
SELECT doc_id, length(text) AS n_chars, len(regexp_extract_all(text, '{W}+')) AS n_tokens,
  len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS n_sentences,
  round(len(regexp_extract_all(text, '{W}+')) / greatest(len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')), 1)::DOUBLE, 4) AS tokens_per_sentence
FROM documents""")
def text_statistics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.statistics(F.col("text")).alias("s")).select("doc_id", "s.*")


GARBAGE = rf"(length({STRIP.format('line')}) <= 1 OR NOT regexp_matches(line, '{W}') OR regexp_matches({STRIP.format('line')}, '^\p{{Nd}}+$'))"


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({GARBAGE}) AS n_garbage FROM l GROUP BY doc_id""")
def clean_lines_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_garbage_line(F.col("line"))).alias("n_garbage"))


def _cleaned_sql() -> str:
    text = "text"
    for p in (*T.PAGE_MARKERS, *T.BATCH_LINES):
        text = "regexp_replace({}, '{}', '', 'g')".format(text, p.replace("'", "''"))
    text = rf"regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    for p in T.DASHES:
        text = f"regexp_replace({text}, '{p}', ' ', 'g')"
    return STRIP.format(rf"regexp_replace({text}, '\s{{2,}}', ' ', 'g')")


@query(f"SELECT doc_id, md5({_cleaned_sql()}) AS digest, length({_cleaned_sql()}) AS n FROM documents")
def cleaned_text(spark, sf_dir):
    text = T.without_dash_noise(T.without_batch_lines(T.without_page_markers(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("cleaned")).select("doc_id", F.md5("cleaned").alias("digest"), F.length("cleaned").alias("n"))


#: Texts with a page marker, a batch line and runs of dashes put in, by the document's number.
MARKED = r"concat(text, chr(10), '-- Page ', doc_id % 9, ' --', chr(10), 'BATCH ', doc_id % 7, chr(10), '#', doc_id, chr(10), chr(10), chr(10), 'a -- b --- ', substr(text, 1, 30), chr(10), '=== part ===', chr(10), '----', chr(10), '[Page 3] end')"


@query(f"SELECT doc_id, md5({_cleaned_sql()}) AS digest, length({_cleaned_sql()}) AS n FROM (SELECT doc_id, {MARKED} AS text FROM documents)")
def cleaned_marked_text(spark, sf_dir):
    text = T.without_dash_noise(T.without_batch_lines(T.without_page_markers(F.expr(MARKED.replace("chr(10)", "char(10)")))))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("cleaned")).select("doc_id", F.md5("cleaned").alias("digest"), F.length("cleaned").alias("n"))


@query(rf"SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(concat(text, ' 5€ x² ¿ж Кé'), '\p{{C}}', '', 'g'), ''), lambda c: NOT regexp_matches(c, '\p{{L}}') OR regexp_matches(c, '[A-Za-z{MACEDONIAN.letters}{MACEDONIAN.letters.upper()}]')), '')) AS digest FROM documents")
def sanitized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.sanitized(F.concat("text", F.lit(" 5€ x² ¿ж Кé")))).alias("digest"))


SENTENCES = r"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(rf"SELECT doc_id, pos, sentence FROM (SELECT doc_id, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) - 1 AS pos FROM documents)")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(rf"""
SELECT doc_id, len({SENTENCES}) AS n_collapsed,
  len(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '([;:])\s+([A-ZÀ-ÖØ-Þ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {STRIP.format('x')} <> '')) AS n_segments
FROM documents""")
def segmentation_policy_diff(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(t)).alias("n_collapsed"), F.size(T.segments(t, LATIN)).alias("n_segments"))


@query(rf"""
WITH s AS (SELECT doc_id, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) AS pos FROM documents)
SELECT doc_id, ((pos - 1) // 20)::INT AS chunk, count(*) AS n, sum(length(sentence))::BIGINT AS n_chars FROM s GROUP BY ALL""")
def chunk_fixed_window(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return T.chunks(rows, "doc_id", "pos").groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("n_chars"))


@query(rf"SELECT word, count(*) AS n, length(word) AS len FROM (SELECT unnest(regexp_extract_all(lower(text), '{W}+|[^\p{{L}}\p{{N}}_\s]')) AS word FROM documents) WHERE regexp_full_match(word, '\p{{L}}+') GROUP BY word ORDER BY n DESC, word LIMIT 120000")
def token_freq_lexicon(spark, sf_dir):
    return models.lexicon(table(spark, sf_dir, "documents"))


@query(rf"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{W}+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM c) WHERE r <= 10""")
def top_k_tokens_by_lang(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"{W}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter("r <= 10").drop("r")


@query(r"""
WITH t AS (SELECT item_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM benchmark), c AS (SELECT lower(w) AS lw, count(*) AS n FROM t GROUP BY ALL)
SELECT item_id, count(*) AS n_words, count(*) FILTER (n <= 1) AS n_rare, count(*) FILTER (regexp_matches(w, '^\p{Lu}')) AS n_proper FROM t JOIN c ON lower(w) = lw GROUP BY item_id""")
def rare_and_proper_tokens(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.words(F.col("text"))).alias("w"))
    counts = words.groupBy(F.lower("w").alias("lw")).agg(F.count(F.lit(1)).alias("n"))
    joined = words.withColumn("lw", F.lower("w")).join(counts, "lw")
    return joined.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(models.is_rare(F.col("n"))).alias("n_rare"), F.count_if(models.is_name(F.col("w"))).alias("n_proper"))


TYPES = rf"SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '{W}+')) AS word FROM benchmark) WHERE regexp_full_match(word, '\p{{L}}+')"
GRAMS = f"SELECT word, unnest(list_transform(range(1, greatest(length(word), 1)), lambda i: substr('^' || word || '$', i, 4))) AS gram FROM ({TYPES})"


def _types(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"{W}+"), F.lit(0))).alias("word"))
    return rows.filter(F.col("word").rlike(r"^\p{L}+$")).distinct()


@query(f"SELECT gram, count(*) AS n FROM ({GRAMS}) GROUP BY gram")
def char_ngram_counts(spark, sf_dir):
    return models.char_counts(_types(spark, sf_dir))


@query(f"""
WITH ty AS ({TYPES}), g AS ({GRAMS}), c AS (SELECT gram, count(*) AS n FROM g GROUP BY gram), x AS (SELECT substr(gram, 1, 3) AS ctx, sum(n) AS m FROM c GROUP BY ALL), v AS (SELECT count(DISTINCT substr(gram, 4, 1)) AS v FROM c),
s AS (SELECT word, sum(ln((n + 0.1::DOUBLE) / (m + 0.1::DOUBLE * v))) AS logp FROM g JOIN c USING (gram) JOIN x ON substr(gram, 1, 3) = ctx, v GROUP BY word)
SELECT word, round(coalesce(logp, -5.0), 6) AS logp FROM ty LEFT JOIN s USING (word)""")
def char_lm_score(spark, sf_dir):
    types = _types(spark, sf_dir)
    return models.char_scores(types, models.char_counts(types)).select("word", F.round("logp", 6).alias("logp"))


@query(r"""
WITH s AS (SELECT item_id, list_concat(list_concat(['<bos>'], list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')), ['<eos>']) AS s FROM benchmark),
b AS (SELECT s[i] AS a, s[i + 1] AS w FROM (SELECT s, unnest(range(1, len(s))) AS i FROM s)), u AS (SELECT DISTINCT w FROM (SELECT unnest(s) AS w FROM s)), c AS (SELECT a, w, count(*) AS n FROM b GROUP BY ALL),
x AS (SELECT a, sum(n) AS m, count(*) AS f FROM c GROUP BY a), p AS (SELECT w, count(*) AS before FROM c GROUP BY w), k AS (SELECT count(*) AS kinds FROM c), v AS (SELECT count(*) AS v FROM u)
SELECT a, w, round((greatest(n - 0.75::DOUBLE, 0) + 0.75::DOUBLE * f * ((before + 1) / (kinds + v)::DOUBLE)) / m, 6) AS p FROM c JOIN x USING (a) JOIN p USING (w), k, v""")
def word_ngram_kn_bigram(spark, sf_dir):
    counts = models.word_counts(table(spark, sf_dir, "benchmark"), order=2)
    return models.kneser_ney(counts, counts[2].select("ctx", "w")).select(F.col("ctx")[0].alias("a"), "w", F.round("p", 6).alias("p"))


@query(None)
def word_kn_sentence_scores(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return models.sentence_scores(b, "item_id", models.word_counts(b))


@query(r"""
WITH c AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS a, lead(text) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, concat_ws(' | ', a, text, b) AS context FROM c""")
def context_window_concat(spark, sf_dir):
    return T.with_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", " | ").select("conv_id", "turn", "context")


SH = "SELECT {k} AS k, lower(substr(text, i, 5)) AS s, i - 1 AS pos FROM (SELECT {k}, text, unnest(range(1, length(text) - 3)) AS i FROM {t})"


@query(f"""
WITH a AS ({SH.format(k='item_id', t='benchmark')}), b AS ({SH.format(k='item_id', t="(SELECT item_id, translate(text, 'oi', '0j') AS text FROM benchmark)")}),
ua AS (SELECT k, s, min(pos) AS pa FROM a GROUP BY ALL HAVING count(*) = 1), ub AS (SELECT k, s, min(pos) AS pb FROM b GROUP BY ALL HAVING count(*) = 1)
SELECT k AS item_id, count(*) AS n_anchors, min(pa) AS first_left, max(pb) AS last_right FROM ua JOIN ub USING (k, s) GROUP BY k""")
def unique_shingle_anchors(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    found = align.unique_anchors(b, b.withColumn("text", F.translate("text", "oi", "0j")), "item_id")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_anchors"), F.min("left_pos").cast("long").alias("first_left"), F.max("right_pos").cast("long").alias("last_right"))


@query(r"""
WITH p AS (SELECT item_id, text AS a, translate(text, 'oi', '0j') AS b FROM benchmark),
ga AS (SELECT item_id, substr(a, i, 5) AS s, count(*) AS n FROM (SELECT item_id, a, unnest(range(1, length(a) - 3)) AS i FROM p) GROUP BY ALL), gb AS (SELECT item_id, substr(b, i, 5) AS s, count(*) AS n FROM (SELECT item_id, b, unnest(range(1, length(b) - 3)) AS i FROM p) GROUP BY ALL),
d AS (SELECT item_id, sum(coalesce(ga.n, 0) * coalesce(gb.n, 0)) AS dot, sum(ga.n * ga.n) AS aa, sum(gb.n * gb.n) AS bb FROM ga FULL JOIN gb USING (item_id, s) GROUP BY item_id),
w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(a), '\s+'), lambda x: x <> '')) AS wa, list_distinct(list_filter(string_split_regex(lower(b), '\s+'), lambda x: x <> '')) AS wb FROM p)
SELECT item_id, round(0.75 * coalesce(dot, 0) / (sqrt(coalesce(aa, 0)) * sqrt(coalesce(bb, 0)) + 1e-6) + 0.25 * len(list_intersect(wa, wb)) / (sqrt(len(wa) * len(wb)) + 1e-6), 6) AS similarity FROM w LEFT JOIN d USING (item_id)""")
def shingle_cosine_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"), F.translate("text", "oi", "0j").alias("b"))
    return align.fast_similarity(p, ["item_id"], "a", "b").select("item_id", F.round("similarity", 6).alias("similarity"))


ASCII = rf"SELECT DISTINCT word FROM ({TYPES}) WHERE regexp_full_match(word, '[a-z]+')"


@query(f"SELECT a.word AS word, b.word AS cand, levenshtein(a.word, b.word) AS distance FROM ({ASCII}) a JOIN ({ASCII}) b ON abs(length(a.word) - length(b.word)) <= 2 AND levenshtein(a.word, b.word) <= 2")
def length_blocked_candidates(spark, sf_dir):
    words = _types(spark, sf_dir).filter(F.col("word").rlike("^[a-z]+$")).select("word").distinct()
    return models.within_edits(words, words.toDF("cand"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), ' '), '\s+([,.;:!?])', '\1', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g')) AS digest FROM documents")
def detokenized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.detokenized(T.tokens(F.col("text")))).alias("digest"))
