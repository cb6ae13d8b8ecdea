"""Queries on report tables, training noise and band joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.functions import edits
from glyphlake.operators import align, confusion, noise, reports, tuning
from glyphlake.plans.error_queries import CHARS, FOLD, P_DEL, P_INS, P_SUB, SUBBED, _letter, _u, noised, subbed
from glyphlake.plans.registry import query, table

# Records of three systems on two noises of the benchmark, in ASCII: the input as it is, and two that drop letters.
SALTS = {1: "n", 2: "m"}
DROPPED = {"identity": "", "classical": "ldu", "other": "u"}


def _noised_sql(seed: int, s: str) -> str:
    changed = f"CASE WHEN {_u(s)} < {P_DEL} THEN '' WHEN {_u(s)} < {P_DEL + P_SUB} THEN {_letter(s + 's')} ELSE c END || CASE WHEN {_u(s + '+')} < {P_INS} THEN {_letter(s + 'i')} ELSE '' END"
    return f"SELECT {seed} AS seed, item_id, string_agg({changed}, '' ORDER BY pos) AS noisy FROM ch GROUP BY item_id"


def _rate(a: str) -> str:
    return f"levenshtein(clean, {a}) / greatest(length(clean), 1)::DOUBLE"


RECORDS = f"""WITH {CHARS}, no AS ({' UNION ALL '.join(_noised_sql(*x) for x in SALTS.items())}),
folded AS (SELECT b.item_id, s.seed, {FOLD.format('b.text')} AS clean, {FOLD.format("coalesce(no.noisy, '')")} AS noisy FROM benchmark b CROSS JOIN (VALUES {', '.join(f'({k})' for k in SALTS)}) s(seed) LEFT JOIN no ON no.item_id = b.item_id AND no.seed = s.seed),
made AS ({' UNION ALL '.join(f"SELECT *, '{m}' AS model, translate(noisy, '{cut}', '') AS fixed FROM folded" for m, cut in DROPPED.items())}),
rec AS (SELECT item_id AS sample_id, seed, model, CASE item_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS regime, (item_id % 3)::INT AS subset_domain, {_rate('noisy')} AS input_cer, {_rate('fixed')} AS cer,
 abs(length(clean) - length(fixed)) / greatest(length(clean), 1)::DOUBLE AS wer, 1 - {_rate('fixed')} AS chrf, noisy <> fixed AS changed, length(noisy) * 0.5::DOUBLE AS ms, item_id % 4 = 0 AS is_rare, regexp_matches(clean, '^[A-Z]') AS is_proper,
 1 - {_rate('noisy')} AS confidence, ({_rate('fixed')} < 0.1)::INT::DOUBLE AS correct FROM made)"""


def records(spark, sf_dir):
    fold = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    pairs = None
    for seed, salt in SALTS.items():
        p = noised(spark, sf_dir, salt=salt).select("item_id", F.lit(seed).alias("seed"), fold("clean").alias("clean"), fold("noisy").alias("noisy"))
        pairs = p if pairs is None else pairs.unionByName(p)
    systems = F.array(*[F.struct(F.lit(m).alias("model"), (F.translate("noisy", cut, "") if cut else F.col("noisy")).alias("fixed")) for m, cut in DROPPED.items()])
    made = pairs.withColumn("s", F.explode(systems)).select("item_id", "seed", "clean", "noisy", "s.*")
    before, after = edits.cer_levenshtein(F.col("clean"), F.col("noisy")), edits.cer_levenshtein(F.col("clean"), F.col("fixed"))
    size = F.greatest(F.length("clean"), F.lit(1))
    return made.select(
        F.col("item_id").alias("sample_id"), "seed", "model", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("regime"), (F.col("item_id") % 3).cast("int").alias("subset_domain"), before.alias("input_cer"), after.alias("cer"),
        (F.abs(F.length("clean") - F.length("fixed")) / size).alias("wer"), (1 - after).alias("chrf"), (F.col("noisy") != F.col("fixed")).alias("changed"), (F.length("noisy") * 0.5).alias("ms"), (F.col("item_id") % 4 == 0).alias("is_rare"),
        F.col("clean").rlike("^[A-Z]").alias("is_proper"), (1 - before).alias("confidence"), (after < 0.1).cast("double").alias("correct"),
    )


MAIN = """round(avg(input_cer), 5) AS input_cer, round(avg(cer), 5) AS cer, round(greatest(-1, least(1, (avg(input_cer) - avg(cer)) / avg(input_cer))), 5) AS cer_reduction_rate, round(avg(wer), 5) AS wer, round(avg(chrf), 5) AS chrf,
 round(avg((cer = 0)::INT), 5) AS sentence_accuracy, round(avg(changed::INT), 5) AS correction_rate, round(count(*) FILTER (changed AND cer >= input_cer) / greatest(count(*) FILTER (changed), 1)::DOUBLE, 5) AS overcorrection_rate,
 round(count(*) FILTER (changed AND cer < input_cer) / greatest(count(*) FILTER (changed), 1)::DOUBLE, 5) AS useful_correction_rate, count(*) FILTER (changed) AS edited_count"""


@query(RECORDS + f""" SELECT model, regime, count(*) AS n, {MAIN}, round(count(*) FILTER (is_rare AND cer > input_cer) / greatest(count(*) FILTER (is_rare), 1)::DOUBLE, 5) AS rare_word_corruption_rate,
 round(count(*) FILTER (is_proper AND cer > input_cer) / greatest(count(*) FILTER (is_proper), 1)::DOUBLE, 5) AS proper_name_corruption_rate, list_sort(list(ms))[count(*) // 2 + 1] AS median_ms_per_sentence,
 list_sort(list(ms))[least(count(*) - 1, floor(0.95::DOUBLE * count(*)))::INT + 1] AS p95_ms_per_sentence FROM rec WHERE seed = 1 GROUP BY model, regime""")
def main_report(spark, sf_dir):
    rec = records(spark, sf_dir).filter("seed = 1")
    return reports.main_table(rec, reports.efficiency(rec, reports.KEYS))


@query(RECORDS + """, b AS (SELECT model, regime, least(9, floor(confidence * 10))::INT AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM rec WHERE seed = 1 GROUP BY ALL),
e AS (SELECT model, regime, sum(n * abs(c - a)) / sum(n) AS ece FROM b GROUP BY ALL)
SELECT e.model, e.regime, round(ece, 5) AS ece, i / 10.0::DOUBLE AS bin_lo, (i + 1) / 10.0::DOUBLE AS bin_hi, coalesce(n, 0) AS count, round(coalesce(c, 0), 5) AS mean_confidence, round(coalesce(a, 0), 5) AS mean_accuracy
FROM e CROSS JOIN range(10) t(i) LEFT JOIN b ON b.model = e.model AND b.regime = e.regime AND b.bin = i""")
def calibration_report(spark, sf_dir):
    return reports.calibration_table(records(spark, sf_dir).filter("seed = 1"), "confidence", "correct").drop("temperature", "token_ece_pre", "token_ece_post")


@query(RECORDS + """, pair AS (SELECT s.regime, s.model AS system, o.model AS vs, s.sample_id, s.cer - o.cer AS c, s.wer - o.wer AS w FROM rec s JOIN rec o USING (regime, seed, sample_id) WHERE seed = 1 AND s.model <> 'identity' AND s.model <> o.model AND o.model IN ('identity', 'classical')),
d AS (SELECT *, row_number() OVER (PARTITION BY regime, system, vs ORDER BY sample_id) - 1 AS i, count(*) OVER (PARTITION BY regime, system, vs) AS n FROM pair),
sizes AS (SELECT DISTINCT n FROM d), g AS (SELECT n, b, ('0x' || substr(md5(b || ':' || k || ':boot'), 1, 8))::BIGINT % n AS i FROM sizes, range(1000) x(b), range(100000) y(k) WHERE k < n),
m AS (SELECT regime, system, vs, b, avg(c) AS c, avg(w) AS w FROM g JOIN d USING (n, i) GROUP BY ALL), l AS (SELECT regime, system, vs, list_sort(list(c)) AS c, list_sort(list(w)) AS w FROM m GROUP BY ALL),
t AS (SELECT regime, system, vs, count(*) AS n, avg(c) AS mc, avg(w) AS mw FROM d GROUP BY ALL)
SELECT regime, system, vs AS vs_baseline, n, round(mc, 6) AS cer_mean_delta, round(c[26], 6) AS cer_ci_low, round(c[975], 6) AS cer_ci_high,
 round(least(1, 2 * CASE WHEN mc < 0 THEN len(list_filter(c, lambda x: x >= 0)) ELSE len(list_filter(c, lambda x: x <= 0)) END / 1000.0::DOUBLE), 5) AS cer_p_value, round(mw, 6) AS wer_mean_delta,
 round(least(1, 2 * CASE WHEN mw < 0 THEN len(list_filter(w, lambda x: x >= 0)) ELSE len(list_filter(w, lambda x: x <= 0)) END / 1000.0::DOUBLE), 5) AS wer_p_value FROM t JOIN l USING (regime, system, vs)""")
def significance_report(spark, sf_dir):
    return reports.significance_table(records(spark, sf_dir).filter("seed = 1"))


@query(RECORDS + """, s AS (SELECT model, regime, seed, avg(cer) AS c, avg(wer) AS w, avg(chrf) AS f, avg((cer = 0)::INT) AS a FROM rec GROUP BY ALL)
SELECT model, regime, count(*) AS n_seeds, round(avg(c), 5) AS cer_mean, round(stddev_pop(c), 5) AS cer_std, round(avg(w), 5) AS wer_mean, round(stddev_pop(w), 5) AS wer_std, round(avg(f), 5) AS chrf_mean, round(avg(a), 5) AS sent_acc_mean FROM s GROUP BY ALL""")
def seed_variance_report(spark, sf_dir):
    return reports.seed_variance_table(records(spark, sf_dir))


@query(RECORDS + """, k AS (SELECT *, row_number() OVER (PARTITION BY regime, sample_id ORDER BY cer, model <> 'identity', model) AS r FROM rec WHERE seed = 1)
SELECT regime, round(avg(cer), 5) AS oracle_cer, round(avg(wer), 5) AS oracle_wer, count(*) AS n FROM k WHERE r = 1 GROUP BY regime""")
def oracle_report(spark, sf_dir):
    rec = records(spark, sf_dir).filter("seed = 1")
    return reports.oracle_table(rec.withColumn("rank", (F.col("model") != "identity").cast("int")))


@query(RECORDS + f""", p AS (SELECT model, regime, seed, count(*) AS n, {MAIN}, count(DISTINCT subset_domain) AS domains, round(avg(cer) FILTER (subset_domain = 0), 5) AS cer_of_0 FROM rec GROUP BY ALL),
b AS (SELECT model, regime, seed, least(9, floor(confidence * 10))::INT AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM rec GROUP BY ALL), e AS (SELECT model, regime, seed, round(sum(n * abs(c - a)) / sum(n), 5) AS ece FROM b GROUP BY ALL)
SELECT model, regime, seed, n, cer, wer, chrf, cer_reduction_rate, overcorrection_rate, edited_count, domains, cer_of_0, ece FROM p JOIN e USING (model, regime, seed)""")
def validation_payload(spark, sf_dir):
    out = reports.payload(records(spark, sf_dir), "confidence", "correct")
    return out.select("model", "regime", "seed", "n", "cer", "wer", "chrf", "cer_reduction_rate", "overcorrection_rate", "edited_count", F.size("per_domain").cast("long").alias("domains"), F.round(F.col("per_domain")["0"]["mean_cer"], 5).alias("cer_of_0"), "ece")


# Noise at training time

SWAPS = f"{SUBBED}, k AS (SELECT c AS a, o AS b, count(*) AS n FROM sub GROUP BY ALL), sw AS (SELECT a, b, n, n / sum(n) OVER (PARTITION BY a) AS p FROM k)"


@query(f"WITH {SWAPS} SELECT a, b, round(p, 6) AS p FROM sw WHERE a <> b")
def swap_table(spark, sf_dir):
    return noise.swaps(confusion.confusion(subbed(spark, sf_dir))).select("a", "b", F.round("p", 6).alias("p"))


@query(f"""WITH {SWAPS}, cum AS (SELECT a, b, sum(n) OVER (PARTITION BY a ORDER BY b) / sum(n) OVER (PARTITION BY a) AS hi FROM sw WHERE a <> b), src AS (SELECT item_id, text AS clean, CASE WHEN ('0x' || substr(md5(item_id || ':same'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 THEN text ELSE reverse(text) END AS t FROM benchmark),
li AS (SELECT item_id, i - 1 AS pos, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY item_id) AS n, substr(t, i, 1) AS c FROM (SELECT item_id, t, unnest(range(1, length(t) + 1)) AS i FROM src) WHERE regexp_full_match(substr(t, i, 1), '\\p{{L}}')),
hit AS (SELECT item_id, pos, c FROM li WHERE r = floor(('0x' || substr(md5(item_id || ':place'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n) AND ('0x' || substr(md5(item_id || ':swap'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.25),
got AS (SELECT item_id, pos, min(b) AS b FROM hit JOIN cum ON a = c WHERE hi > ('0x' || substr(md5(item_id || ':letter'), 1, 8))::BIGINT / 4294967296.0::DOUBLE GROUP BY ALL)
SELECT item_id, clean, CASE WHEN b IS NULL THEN t ELSE substr(t, 1, pos::INT) || b || substr(t, pos::INT + 2) END AS noisy FROM src LEFT JOIN got USING (item_id)""")
def training_noise(spark, sf_dir):
    """Reversed texts as the noisy side, of which a fifth become identity pairs and a quarter get one letter swapped."""
    pairs = table(spark, sf_dir, "benchmark").select("item_id", F.reverse("text").alias("noisy"), F.col("text").alias("clean"))
    return noise.training_pairs(pairs, "item_id", noise.swaps(confusion.confusion(subbed(spark, sf_dir))), same=0.2, swap=0.25)


# Band join


@query("""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), o AS (SELECT conv_id, i, n FROM s WHERE i % 2 = 0)
SELECT s.conv_id, s.i, o.i AS j FROM s JOIN o USING (conv_id) WHERE abs(s.i / s.n::DOUBLE - o.i / o.n::DOUBLE) <= 0.15::DOUBLE""")
def band_candidates(spark, sf_dir):
    """Pairs of turns whose relative places are near each other."""
    from pyspark.sql import Window

    conv = Window.partitionBy("conv_id")
    s = table(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(conv.orderBy("turn", "text")) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(conv).alias("n"))
    a = s.select("conv_id", "i", (F.col("i") / F.col("n")).alias("at"))
    return align.band_join(a, a.filter("i % 2 = 0").withColumnRenamed("i", "j"), "conv_id", 0.15).select("conv_id", "i", "j")


# Acceptance token by token


@query(r"""WITH t AS (SELECT item_id, (item_id % 7) / 4.0::DOUBLE AS lead, string_split(text, ' ') AS w FROM benchmark), e AS (SELECT item_id, lead, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM t),
b AS (SELECT *, CASE WHEN substr(md5(tok), 1, 1) < '6' THEN tok || 'x' ELSE tok END AS best, greatest(1.0, CASE WHEN regexp_matches(tok, '^\p{Lu}') THEN 1.5 ELSE 0 END, CASE WHEN length(tok) > 7 THEN 1.3 ELSE 0 END)::DOUBLE AS need, greatest(lead, length(tok) / 5.0::DOUBLE) AS m FROM e)
SELECT item_id, string_agg(CASE WHEN m >= need THEN best ELSE tok END, ' ' ORDER BY pos) AS chosen, count(*) FILTER (m >= need AND best <> tok) AS n_changed, round(sum(CASE WHEN best = tok THEN 0 ELSE least(1, m) END), 5) AS confidence FROM b GROUP BY item_id""")
def token_acceptance(spark, sf_dir):
    """Of made-up candidates, those whose lead or whose token's own lead is enough."""
    w = F.split("text", " ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", w.alias("tokens"), ((F.col("item_id") % 7) / 4.0).alias("lead"))
    rows = rows.withColumns({"best": F.transform("tokens", lambda t: F.when(F.substring(F.md5(t), 1, 1) < "6", F.concat(t, F.lit("x"))).otherwise(t)), "leads": F.transform("tokens", lambda t: F.length(t) / 5.0), "is_rare": F.transform("tokens", lambda t: F.length(t) > 7)})
    got = tuning.accepted(rows, 1.0)
    changed = F.size(F.filter(F.arrays_zip("tokens", "chosen"), lambda z: z["tokens"] != z["chosen"])).cast("long")
    return got.select("item_id", F.array_join("chosen", " ").alias("chosen"), changed.alias("n_changed"), F.round(F.aggregate("confidence", F.lit(0.0), lambda a, x: a + x), 5).alias("confidence"))
