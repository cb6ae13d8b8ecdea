"""Queries on noise, confusions, error statistics, manifests and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.functions import edits, profiles
from glyphlake.functions import text as T
from glyphlake.operators import align, boundary, confusion, manifest, metrics, models, noise, realism
from glyphlake.plans.registry import query, table

ALPHABET = "etaoinshrdlu"
LATIN = profiles.LATIN

# The noised benchmark: characters of each item with their draws. Rates are fixed values of the fixtures.
P_DEL, P_SUB, P_INS = 0.02, 0.08, 0.02


def _u(salt: str) -> str:
    return f"('0x' || substr(md5(item_id || ':' || pos || ':{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _letter(salt: str) -> str:
    return f"CASE WHEN regexp_full_match(c, '\\s') THEN c ELSE substr('{ALPHABET}', floor({_u(salt)} * {len(ALPHABET)})::INT + 1, 1) END"


CHARS = "ch AS (SELECT item_id, i - 1 AS pos, substr(text, i, 1) AS c FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark))"
#: Substitutions only: each character beside what became of it.
SUBBED = f"{CHARS}, sub AS (SELECT item_id, pos, c, CASE WHEN {_u('n')} < {P_SUB} THEN {_letter('ns')} ELSE c END AS o FROM ch)"
#: Whole texts with drops, substitutions and insertions.
NOISED = f"""{CHARS}, no AS (SELECT item_id, string_agg(CASE WHEN {_u('n')} < {P_DEL} THEN '' WHEN {_u('n')} < {P_DEL + P_SUB} THEN {_letter('ns')} ELSE c END
  || CASE WHEN {_u('n+')} < {P_INS} THEN {_letter('ni')} ELSE '' END, '' ORDER BY pos) AS noisy FROM ch GROUP BY item_id),
noised AS (SELECT item_id, text AS clean, coalesce(noisy, '') AS noisy FROM benchmark LEFT JOIN no USING (item_id))"""


def noised(spark, sf_dir, salt: str = "n", p_del: float = P_DEL, p_sub: float = P_SUB, p_ins: float = P_INS):
    return noise.noised(table(spark, sf_dir, "benchmark"), "item_id", "text", noise.uniform(ALPHABET), p_del, p_sub, p_ins, salt=salt)


def subbed(spark, sf_dir):
    """Edit rows of the substitution-only noise: pairs by position, no alignment needed."""
    rows = noise.characters(table(spark, sf_dir, "benchmark"), "item_id", "text")
    hit = noise.draw(F.col("item_id"), F.col("pos"), F.lit("n")) < P_SUB
    o = F.when(hit, noise.uniform(ALPHABET)(F.col("c"), noise.draw(F.col("item_id"), F.col("pos"), F.lit("ns")))).otherwise(F.col("c"))
    return rows.select("item_id", "pos", F.col("c").alias("clean"), o.alias("noisy")).withColumn("op", F.when(F.col("clean") == F.col("noisy"), "match").otherwise("substitution"))


@query(f"WITH {NOISED} SELECT item_id, clean, noisy FROM noised")
def hash_char_noise(spark, sf_dir):
    return noised(spark, sf_dir)


_MAP = " ".join(f"WHEN c = '{a}' AND {{u}} < {{p}} THEN '{b}'" for a, b in LATIN.homoglyphs)


@query(f"WITH {CHARS}, o AS (SELECT item_id, pos, CASE {_MAP.format(u=_u('struct'), p=0.05)} ELSE c END AS o FROM ch) SELECT item_id, string_agg(o, '' ORDER BY pos) AS noisy FROM o GROUP BY item_id")
def homoglyph_noise(spark, sf_dir):
    rows = noise.characters(table(spark, sf_dir, "benchmark"), "item_id", "text")
    o = noise.shifted(F.col("c"), noise.draw(F.col("item_id"), F.col("pos"), F.lit("struct")), LATIN, 0.0, 0.05, 0.0)
    return rows.select("item_id", "pos", o.alias("o")).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "o"))), lambda x: x["o"]), "").alias("noisy"))


@query(f"WITH {SUBBED} SELECT c AS clean, o AS noisy, count(*) AS n FROM sub GROUP BY ALL")
def confusion_counts(spark, sf_dir):
    return confusion.confusion(subbed(spark, sf_dir))


@query(f"WITH {SUBBED}, k AS (SELECT c AS clean, o AS noisy, count(*) AS n FROM sub GROUP BY ALL) SELECT clean, noisy, n, round(n / sum(n) OVER (PARTITION BY clean), 6) AS p FROM k")
def confusion_probs(spark, sf_dir):
    return confusion.probabilities(confusion.confusion(subbed(spark, sf_dir))).withColumn("p", F.round("p", 6))


@query(f"WITH {SUBBED} SELECT c AS clean, o AS noisy, count(*) AS n FROM sub WHERE c <> o GROUP BY ALL ORDER BY n DESC, clean, noisy LIMIT 30")
def top_substitutions(spark, sf_dir):
    return confusion.top(confusion.confusion(subbed(spark, sf_dir), errors_only=True))


def _pairs_sql(pairs) -> str:
    return "(clean, noisy) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in LATIN.both_ways(pairs)) + ")"


MARKS = "(" + ", ".join("'" + c.replace("'", "''") + "'" for c in LATIN.punctuation) + ")"


@query(f"""WITH {SUBBED} SELECT c AS clean, o AS noisy, count(*) AS n, {_pairs_sql(LATIN.diacritics).replace('clean, noisy', 'c, o')} AS is_diacritic, {_pairs_sql(LATIN.homoglyphs).replace('clean, noisy', 'c, o')} AS is_homoglyph,
  (c IN {MARKS} OR o IN {MARKS}) AS is_punctuation FROM sub WHERE c <> o GROUP BY ALL""")
def family_counts(spark, sf_dir):
    return confusion.family_counts(subbed(spark, sf_dir))


@query(f"""WITH {SUBBED}, k AS (SELECT c AS clean, o AS noisy, count(*) AS n FROM sub WHERE c <> o GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER () AS of_all, n / sum(n) OVER (PARTITION BY clean) AS of_source FROM k)
SELECT clean, noisy, n, round(of_all, 6) AS of_all, round(of_source, 6) AS of_source FROM r WHERE {_pairs_sql(LATIN.diacritics)}""")
def diacritic_rates(spark, sf_dir):
    found = confusion.diacritic_rates(confusion.family_counts(subbed(spark, sf_dir)))
    return found.withColumn("of_all", F.round("of_all", 6)).withColumn("of_source", F.round("of_source", 6))


@query(f"WITH {SUBBED} SELECT count(*) AS total_ops, round(100.0 * count(*) FILTER (c = o) / count(*), 6) AS match_pct, round(100.0 * count(*) FILTER (c <> o) / count(*), 6) AS substitution_pct, 0.0::DOUBLE AS deletion_pct, 0.0::DOUBLE AS insertion_pct FROM sub")
def error_distribution(spark, sf_dir):
    d = confusion.error_distribution(subbed(spark, sf_dir))
    return d.select("total_ops", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query(f"""WITH {SUBBED}, d AS (SELECT item_id, count(*) FILTER (c <> o) AS errors, count(*) AS ref_total, count(*) FILTER (c <> o) / count(*)::DOUBLE AS cer FROM sub GROUP BY item_id),
q AS (SELECT quantile_cont(cer, 0.25) AS q25, quantile_cont(cer, 0.75) AS q75 FROM d)
SELECT item_id, errors, ref_total, round(cer, 6) AS cer, cer >= q75 AS is_high, cer <= q25 AS is_low FROM d, q""")
def doc_cer_stratified(spark, sf_dir):
    return confusion.stratified(subbed(spark, sf_dir), "item_id").withColumn("cer", F.round("cer", 6))


@query(f"WITH {SUBBED} SELECT CASE item_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, count(DISTINCT item_id) AS n_docs, count(*) FILTER (c = o) AS match, count(*) FILTER (c <> o) AS substitution, 0::BIGINT AS deletion, 0::BIGINT AS insertion, round(count(*) FILTER (c <> o) / count(*)::DOUBLE, 6) AS cer FROM sub GROUP BY ALL")
def split_level_stats(spark, sf_dir):
    split = F.when(F.col("item_id") % 5 == 0, "test").when(F.col("item_id") % 5 == 1, "val").otherwise("train")
    return confusion.by_split(subbed(spark, sf_dir).withColumn("split", split), "split", "item_id").withColumn("cer", F.round("cer", 6))


@query(f"WITH {SUBBED}, t AS (SELECT item_id, count(*) FILTER (c <> o) AS errors, count(*) AS total FROM sub GROUP BY item_id) SELECT item_id, errors, total, round(errors / total::DOUBLE, 6) AS cer FROM t UNION ALL SELECT NULL, sum(errors)::BIGINT, sum(total)::BIGINT, round(sum(errors) / sum(total), 6) FROM t")
def error_report(spark, sf_dir):
    """Error rate of each text and of all of them, micro-averaged, in one pass."""
    rows = subbed(spark, sf_dir).rollup("item_id").agg(F.count_if(F.col("op") != "match").alias("errors"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("cer", F.round(F.col("errors") / F.col("total"), 6))


FOLD = r"regexp_replace({}, '[^\x00-\x7F]', '?', 'g')"


@query(f"WITH {NOISED} SELECT item_id, levenshtein({FOLD.format('clean')}, {FOLD.format('noisy')}) AS distance, round(levenshtein({FOLD.format('clean')}, {FOLD.format('noisy')}) / greatest(length(clean), 1)::DOUBLE, 6) AS cer FROM noised")
def cer_lev_ascii(spark, sf_dir):
    fold = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    p = noised(spark, sf_dir).select("item_id", fold("clean").alias("clean"), fold("noisy").alias("noisy"))
    return p.select("item_id", F.levenshtein("clean", "noisy").alias("distance"), F.round(edits.cer_levenshtein(F.col("clean"), F.col("noisy")), 6).alias("cer"))


@query(f"""WITH {NOISED}, o AS (SELECT item_id, clean, noisy, unnest(range(1, 7)) AS k FROM noised),
g AS (SELECT item_id, k, 'r' AS side, unnest(CASE WHEN length(clean) < k THEN [clean] ELSE list_transform(range(1, length(clean) - k + 2), lambda i: substr(clean, i, k)) END) AS g FROM o
 UNION ALL SELECT item_id, k, 'h', unnest(CASE WHEN length(noisy) < k THEN [noisy] ELSE list_transform(range(1, length(noisy) - k + 2), lambda i: substr(noisy, i, k)) END) FROM o),
c AS (SELECT item_id, k, g, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'h') AS h FROM g GROUP BY ALL), s AS (SELECT item_id, k, sum(least(r, h)) AS b, sum(r) AS r, sum(h) AS h FROM c GROUP BY ALL)
SELECT item_id, round(sum(CASE WHEN b = 0 THEN 0 ELSE 5 * (b / h) * (b / r) / (4 * (b / h) + (b / r)) END) / 6, 6) AS chrf FROM s GROUP BY item_id""")
def chrf_score(spark, sf_dir):
    return noised(spark, sf_dir).select("item_id", F.round(edits.chrf_udf("clean", "noisy"), 6).alias("chrf"))


# Records of two noise levels and the identity, in ASCII, with edit distance as the error.
RECORDS = f"""WITH {NOISED}, rec AS (SELECT item_id, (item_id % 3)::INT AS domain, levenshtein({FOLD.format('clean')}, {FOLD.format('noisy')}) / greatest(length(clean), 1)::DOUBLE AS input_cer,
 levenshtein({FOLD.format('clean')}, translate({FOLD.format('noisy')}, 'ldu', '')) / greatest(length(clean), 1)::DOUBLE AS cer, {FOLD.format('noisy')} <> translate({FOLD.format('noisy')}, 'ldu', '') AS changed FROM noised)"""


def records(spark, sf_dir):
    fold = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    p = noised(spark, sf_dir).select("item_id", (F.col("item_id") % 3).cast("int").alias("domain"), fold("clean").alias("clean"), fold("noisy").alias("noisy")).withColumn("fixed", F.translate("noisy", "ldu", ""))
    return p.select("item_id", "domain", edits.cer_levenshtein(F.col("clean"), F.col("noisy")).alias("input_cer"), edits.cer_levenshtein(F.col("clean"), F.col("fixed")).alias("cer"), (F.col("noisy") != F.col("fixed")).alias("changed"))


@query(RECORDS + """ SELECT domain, round(avg(cer), 6) AS mean_cer, round(avg(input_cer), 6) AS mean_input_cer, round(avg(changed::INT), 6) AS correction_rate, round(count(*) FILTER (changed AND cer >= input_cer) / greatest(count(*) FILTER (changed), 1)::DOUBLE, 6) AS overcorrection,
 count(*) FILTER (changed) AS edited, count(*) AS n, round(greatest(-1, least(1, (avg(input_cer) - avg(cer)) / avg(input_cer))), 6) AS reduction FROM rec GROUP BY GROUPING SETS ((), (domain))""")
def aggregate_metrics_by_domain(spark, sf_dir):
    rec = records(spark, sf_dir).withColumn("wer", F.col("cer")).withColumn("chrf", 1 - F.col("cer")).withColumn("model", F.lit("drop"))
    out = metrics.aggregate(rec, ["model"], "domain")
    return out.select("domain", *[F.round(c, 6).alias(c) for c in ("mean_cer", "mean_input_cer", "correction_rate", "overcorrection")], "edited", "n", F.round("reduction", 6).alias("reduction"))


@query("""WITH r AS (SELECT doc_id, (doc_id * 37 % 101) / 100.0::DOUBLE AS conf, quality::DOUBLE AS ok FROM labels), b AS (SELECT least(9, floor(conf * 10))::INT AS bin, count(*) AS n, avg(conf) AS c, avg(ok) AS a FROM r GROUP BY ALL)
SELECT i::INT AS bin, coalesce(n, 0) AS n, round(coalesce(c, 0), 6) AS confidence, round(coalesce(a, 0), 6) AS accuracy FROM range(10) t(i) LEFT JOIN b ON bin = i""")
def calibration_bins(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select(((F.col("doc_id") * 37 % 101) / 100.0).alias("conf"), F.col("quality").cast("double").alias("ok"))
    return metrics.calibration_bins(r, "conf", "ok").select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query("""WITH r AS (SELECT (doc_id * 37 % 101) / 100.0::DOUBLE AS conf, quality::DOUBLE AS ok FROM labels), b AS (SELECT least(9, floor(conf * 10))::INT AS bin, count(*) AS n, avg(conf) AS c, avg(ok) AS a FROM r GROUP BY ALL)
SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b""")
def calibration_ece(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select(((F.col("doc_id") * 37 % 101) / 100.0).alias("conf"), F.col("quality").cast("double").alias("ok"))
    return metrics.calibration_error(metrics.calibration_bins(r, "conf", "ok")).select(F.round("ece", 6).alias("ece"))


@query(RECORDS + " SELECT round(avg(least(input_cer, cer)), 6) AS oracle_cer, round(avg(least(input_cer, cer)), 6) AS oracle_wer, count(*) AS n FROM rec")
def oracle_best_of(spark, sf_dir):
    rec = records(spark, sf_dir)
    both = rec.select("item_id", F.col("input_cer").alias("cer"), F.lit(0).alias("rank")).unionByName(rec.select("item_id", "cer", F.lit(1).alias("rank"))).withColumn("wer", F.col("cer"))
    return metrics.oracle_best(both, "item_id").select(F.round("oracle_cer", 6).alias("oracle_cer"), F.round("oracle_wer", 6).alias("oracle_wer"), "n")


@query(RECORDS + """, d AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, cer - input_cer AS d FROM rec), n AS (SELECT count(*) AS n FROM d),
g AS (SELECT b, ('0x' || substr(md5(b || ':' || k || ':boot'), 1, 8))::BIGINT % n AS i FROM range(1000) x(b), n, range(100000) y(k) WHERE k < n), m AS (SELECT b, avg(d) AS m FROM g JOIN d USING (i) GROUP BY b),
l AS (SELECT list_sort(list(m)) AS m FROM m), w AS (SELECT avg(d) AS mean FROM d)
SELECT round(mean, 6) AS mean, round(m[26], 6) AS low, round(m[975], 6) AS high, least(1, 2 * CASE WHEN mean < 0 THEN len(list_filter(m, lambda x: x >= 0)) ELSE len(list_filter(m, lambda x: x <= 0)) END / 1000.0::DOUBLE) AS p, n FROM w, l, n""")
def paired_bootstrap_ci(spark, sf_dir):
    d = records(spark, sf_dir).select(F.col("item_id").alias("sample_id"), (F.col("cer") - F.col("input_cer")).alias("delta"))
    return metrics.bootstrap(d).select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "p", "n")


THRESHOLDS = [0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10, 0.13, 0.16, 0.20, 0.25, 0.30]


@query(RECORDS + f""" SELECT t AS threshold, round(avg(CASE WHEN input_cer >= t THEN cer ELSE input_cer END), 6) AS mean_cer, round(avg((input_cer >= t)::INT), 6) AS kept_share,
 round(count(*) FILTER (input_cer >= t AND changed AND cer > input_cer) / greatest(count(*) FILTER (input_cer >= t AND changed), 1)::DOUBLE, 6) AS overcorrection FROM rec, (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS t) GROUP BY t""")
def threshold_sweep(spark, sf_dir):
    s = metrics.threshold_sweep(records(spark, sf_dir).withColumn("estimate", F.col("input_cer")), THRESHOLDS)
    return s.select("threshold", *[F.round(c, 6).alias(c) for c in ("mean_cer", "kept_share", "overcorrection")])


@query(RECORDS + """, f AS (SELECT input_cer AS y, length(text)::DOUBLE AS x FROM rec JOIN benchmark USING (item_id)) SELECT round(regr_intercept(y, x), 6) AS intercept, round(regr_slope(y, x), 9) AS slope FROM f""")
def headroom_features_ols(spark, sf_dir):
    rows = records(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("x")), "item_id")
    a, b = metrics.ols(rows, ["x"], "input_cer")
    return spark.createDataFrame([(a, b)], "intercept double, slope double").select(F.round("intercept", 6).alias("intercept"), F.round("slope", 9).alias("slope"))


@query(RECORDS + """, e AS (SELECT quantile_cont(input_cer, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM rec), b AS (SELECT i::INT AS bin, e[i + 1] AS lo, e[i + 2] AS hi FROM e, range(5) t(i))
SELECT bin, count(*) AS n, round(avg(input_cer), 6) AS mean_input_cer, round(avg(cer), 6) AS mean_cer FROM rec JOIN b ON input_cer >= lo AND (input_cer < hi OR (bin = 4 AND input_cer <= hi)) GROUP BY bin""")
def headroom_quantile_curve(spark, sf_dir):
    return metrics.headroom_curve(records(spark, sf_dir), 5).select("bin", "n", F.round("mean_input_cer", 6).alias("mean_input_cer"), F.round("mean_cer", 6).alias("mean_cer"))


# Distributions over languages

LETTER = r"SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}')) AS c FROM documents"


@query(f"""WITH l AS ({LETTER}), a AS (SELECT c, count(*)::DOUBLE AS n FROM l WHERE lang = 'en' GROUP BY c), b AS (SELECT c, count(*)::DOUBLE AS n FROM l WHERE lang = 'fr' GROUP BY c),
u AS (SELECT coalesce(a.n, 0) + 1e-12 AS a, coalesce(b.n, 0) + 1e-12 AS b FROM a FULL JOIN b USING (c)), s AS (SELECT sum(a) AS sa, sum(b) AS sb FROM u), p AS (SELECT a / sa AS p, b / sb AS q FROM u, s)
SELECT round(0.5 * sum(p * log2(p / ((p + q) / 2))) + 0.5 * sum(q * log2(q / ((p + q) / 2))), 6) AS js FROM p""")
def js_divergence_lang(spark, sf_dir):
    letters = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}"), F.lit(0))).alias("c"))
    n = letters.groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n"))
    return realism.js_divergence(n.filter("lang = 'en'"), n.filter("lang = 'fr'"), "c").select(F.round("js", 6).alias("js"))


@query("""WITH v AS (SELECT length(text) AS v, (lang = 'en')::INT AS x FROM documents WHERE lang IN ('en', 'fr')), p AS (SELECT v, sum(x) AS x, sum(1 - x) AS y FROM v GROUP BY v),
r AS (SELECT sum(x) OVER w AS cx, sum(y) OVER w AS cy, sum(x) OVER () AS nx, sum(y) OVER () AS ny FROM p WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(cx / nx - cy / ny)), 6) AS ks FROM r""")
def ks_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("v"))
    return realism.ks_distance(d.filter("lang = 'en'"), d.filter("lang = 'fr'"), "v").select(F.round("ks", 6).alias("ks"))


@query("""WITH q AS (SELECT quantile_cont(length(text)::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (lang = 'en') AS a, quantile_cont(length(text)::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (lang = 'fr') AS b FROM documents)
SELECT round(list_sum(list_transform(range(1, 10), lambda i: abs(a[i] - b[i]))) / 9, 6) AS diff FROM q""")
def quantile_abs_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").cast("double").alias("v"))
    return realism.quantile_difference(d.filter("lang = 'en'"), d.filter("lang = 'fr'"), "v").select(F.round("diff", 6).alias("diff"))


# Manifests

HOME = "('0x' || substr(md5(source), 1, 8))::BIGINT % 5"
SPLIT = f"CASE {HOME} WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


def _manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    home = F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("bigint") % 5
    split = F.when(home == 0, "test").when(home == 1, "val").otherwise("train")
    rows = docs.select("doc_id", split.alias("split"), F.concat_ws("-", "source", "doc_id").alias("sample_id"), F.when(F.col("quality") == 1, "real").otherwise("synthetic").alias("source_type"))
    return rows


BASE = f"m AS (SELECT doc_id, {SPLIT} AS split, source || '-' || doc_id AS sample_id, CASE quality WHEN 1 THEN 'real' ELSE 'synthetic' END AS source_type FROM documents JOIN labels USING (doc_id))"
OVER = f"{BASE}, o AS (SELECT doc_id, split, CASE WHEN k > 0 THEN sample_id || '__dup' || k ELSE sample_id END AS sample_id, source_type FROM (SELECT *, unnest(range(CASE WHEN split = 'train' AND source_type = 'synthetic' THEN 3 ELSE 1 END)) AS k FROM m))"


def _oversampled(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    return manifest.oversampled(m.filter("source_type = 'synthetic'"), 3).unionByName(m.filter("source_type = 'real'"))


@query(f"WITH {OVER} SELECT * FROM o")
def manifest_oversample(spark, sf_dir):
    return _oversampled(spark, sf_dir)


@query(f"WITH {OVER} SELECT 'mixed' AS regime, split, source_type, count(*) AS n FROM o GROUP BY split, source_type UNION ALL SELECT 'mixed', split, NULL, count(*) FROM o GROUP BY split UNION ALL SELECT 'mixed', NULL, NULL, count(*) FROM o UNION ALL SELECT NULL, NULL, NULL, count(*) FROM o")
def manifest_summary(spark, sf_dir):
    return manifest.summary({"mixed": _oversampled(spark, sf_dir)})


@query(f"WITH {BASE} SELECT doc_id, sample_id, source_type, count(*) AS count FROM m GROUP BY ALL HAVING count(*) > 1")
def manifest_duplicate_check(spark, sf_dir):
    return manifest.duplicates(_manifest(spark, sf_dir))


@query(f"WITH s AS (SELECT DISTINCT source, ({HOME})::INT AS home FROM documents) SELECT f::INT AS fold, source, CASE WHEN home = f THEN 'test' WHEN home = (f + 1) % 5 THEN 'val' ELSE 'train' END AS split FROM s, range(5) t(f)")
def kfold_assignment(spark, sf_dir):
    return manifest.folds(table(spark, sf_dir, "documents").select("source").distinct(), "source")


@query("SELECT lang, count(*) AS n_folds, round_even(avg(m), 6) AS m_mean, round_even(coalesce(stddev_pop(m), 0), 6) AS m_std FROM (SELECT lang, doc_id % 5 AS fold, avg(n_chars) AS m FROM documents GROUP BY ALL) GROUP BY lang")
def kfold_mean_std(spark, sf_dir):
    per = table(spark, sf_dir, "documents").groupBy("lang", (F.col("doc_id") % 5).alias("fold")).agg(F.avg("n_chars").alias("m"))
    return metrics.spread(per, ["lang"], ["m"])


@query("SELECT DISTINCT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def leak_antijoin(spark, sf_dir):
    return manifest.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Edit scripts: not expressible in SQL; their tests hold them against their definitions.


@query()
def opcode_cer(spark, sf_dir):
    c, n = F.col("clean"), F.col("noisy")
    return noised(spark, sf_dir).select("item_id", edits.cer(c, n).alias("cer"), edits.wer(c, n).alias("wer"), edits.cer_levenshtein(c, n).alias("cer_least"))


@query()
def edit_ops_table(spark, sf_dir):
    """Every edit of every pair by the table function in a lateral join."""
    spark.udtf.register("edit_ops", edits.edit_ops_udtf)
    noised(spark, sf_dir).createOrReplaceTempView("noised_benchmark")
    return spark.sql("SELECT item_id, e.* FROM noised_benchmark, LATERAL edit_ops(noisy, clean) e")


@query()
def boundary_errors(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("clean"), noise.structured_words(F.col("item_id"), F.col("text"), 0.1, 0.1).alias("noisy"))
    return boundary.boundary_table(b, ["item_id"])


@query()
def split_merge_greedy(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("clean"), noise.structured_words(F.col("item_id"), F.col("text"), 0.1, 0.1).alias("noisy"))
    return b.select("item_id", boundary.greedy_counts_udf("noisy", "clean").alias("c")).select("item_id", "c.*")


@query()
def sentence_dp_align(spark, sf_dir):
    """Turns of conversations as sentences, against the same with noise."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("pos"), "text")
    noisy = noise.noisy_text(F.col("id"), F.col("text"), noise.uniform(ALPHABET), 0.01, 0.04, 0.01)
    sides = F.array(*[F.struct(F.lit(side).alias("side"), "pos", text.alias("text")) for side, text in (("noisy", noisy), ("clean", F.col("text")))])
    rows = align.dealt(c.withColumn("id", F.concat_ws("-", "conv_id", "pos")), "conv_id").select("conv_id", F.inline(sides)).filter("side = 'clean' or text <> ''")
    return align.sentence_pairs(rows, "conv_id")


def _corrector(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    pairs = noised(spark, sf_dir, p_del=0.0, p_ins=0.0)
    lex = models.lexicon(b)
    channel = models.channel_table(confusion.confusion(subbed(spark, sf_dir)))
    types = pairs.select(F.explode(T.tokens(F.col("noisy"))).alias("word")).distinct()
    scored = models.char_scores(lex.select("word"), models.char_counts(lex))
    options = models.candidates(types, lex.select("word", "n", "len"), channel, scored)
    return b, pairs, options, models.word_counts(b), channel


@query()
def beam_correct(spark, sf_dir):
    _, pairs, options, counts, channel = _corrector(spark, sf_dir)
    return models.corrected(pairs, "item_id", "noisy", options, counts, channel)


@query()
def structure_noise(spark, sf_dir):
    return noise.structure_noise(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query()
def confusion_matrix_noise(spark, sf_dir):
    return noise.confusion_noise(table(spark, sf_dir, "benchmark"), "item_id", "text", confusion.confusion(subbed(spark, sf_dir), errors_only=True), ALPHABET, P_DEL, P_SUB, P_INS)


@query()
def realism_report(spark, sf_dir):
    real, made = noised(spark, sf_dir), noised(spark, sf_dir, salt="m")
    ops = lambda p: confusion.edits(p, ["item_id"])
    return realism.evaluation(ops(real), ops(made), real, made)


@query()
def calibrated_rates(spark, sf_dir):
    p = noised(spark, sf_dir)
    return noise.calibrated(confusion.edits(p, ["item_id"]), boundary.boundary_table(p, ["item_id"]), p)
