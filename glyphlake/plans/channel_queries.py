"""Queries on the trained channel, its lattice and calibration, and on chunks, names and batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from glyphlake.functions import edits
from glyphlake.functions import text as T
from glyphlake.operators import gates, metrics, models, noise
from glyphlake.operators import transducer as X
from glyphlake.plans.error_queries import ALPHABET, CHARS, NOISED, P_SUB, _corrector, _letter, _u, noised
from glyphlake.plans.registry import query, table
from glyphlake.plans.text_queries import SENTENCES, STRIP
from glyphlake.sources import tables

# Chunks, names, batches


@query(rf"""
WITH s AS (SELECT doc_id, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) AS i FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ends, count(*) OVER (PARTITION BY doc_id) AS parts FROM l WHERE {STRIP.format('line')} <> ''),
c AS (SELECT doc_id, i, length(sentence) AS n, sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM s),
r AS (SELECT c.*, (SELECT count(*) FROM p WHERE p.doc_id = c.doc_id AND ends <= s) AS reached, coalesce((SELECT max(parts) FROM p WHERE p.doc_id = c.doc_id), 0) AS parts FROM c),
k AS (SELECT *, CASE WHEN reached > coalesce(lag(reached) OVER (PARTITION BY doc_id ORDER BY i), 0) THEN 1 ELSE 0 END AS closes FROM r),
m AS (SELECT doc_id, n, CASE WHEN parts < 8 THEN (i - 1) // 20 ELSE coalesce(sum(closes) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::INT AS chunk FROM k)
SELECT doc_id, chunk, count(*) AS n, sum(n)::BIGINT AS n_chars FROM m GROUP BY ALL""")
def chunk_paragraphs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sentences = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "sentence")).filter(T.stripped(F.col("sentence")) != "")
    return T.paragraph_chunks(sentences, lines, "doc_id", "pos", "sentence").groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("n_chars"))


@query("""
WITH h AS (SELECT page_id, string_split(regexp_extract(url, '//([^/?#:]+)', 1), '.') AS parts FROM pages),
f AS (SELECT DISTINCT array_to_string(parts, '-') || '-' || (page_id % 7) || CASE page_id % 3 WHEN 0 THEN '_corrected.txt' WHEN 1 THEN ' поправено.TXT' ELSE '.txt' END AS file FROM h
      UNION SELECT parts[1] || '_corrected.txt' FROM h WHERE page_id % 5 = 0 UNION SELECT parts[1] || ' поправено.txt' FROM h WHERE page_id % 4 = 0),
b AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN upper(parts[1]) ELSE parts[1] END AS name FROM h),
x AS (SELECT name, file, r.rank FROM b JOIN (VALUES (0, '%s_corrected.txt'), (1, '%s поправено_corrected.txt'), (2, '%s_поправено_corrected.txt'), (3, '%s_поправено.txt'), (4, '%s поправено.txt')) r(rank, form) ON true JOIN f ON file = replace(form, '%s', name)
      UNION ALL SELECT name, file, 5 FROM b, f WHERE contains(lower(regexp_replace(file, '\\.[^.]*$', '')), lower(name)) AND (lower(regexp_replace(file, '\\.[^.]*$', '')) LIKE '%corrected' OR contains(lower(file), 'поправено'))),
g AS (SELECT name, rank, min(file) AS file, count(*) AS matches FROM x GROUP BY name, rank)
SELECT name, file, rank, matches FROM g WHERE rank = (SELECT min(rank) FROM g o WHERE o.name = g.name)""")
def resolved_names(spark, sf_dir):
    """Names of books out of the pages' hosts, and files named after them in several ways."""
    h = table(spark, sf_dir, "pages").select("page_id", F.split(F.regexp_extract("url", "//([^/?#:]+)", 1), r"\.").alias("parts"))
    first, k = F.col("parts")[0], F.col("page_id")
    end = F.when(k % 3 == 0, "_corrected.txt").when(k % 3 == 1, " поправено.TXT").otherwise(".txt")
    files = h.select(F.concat(F.array_join("parts", "-"), F.lit("-"), k % 7, end).alias("file"))
    files = files.union(h.filter(k % 5 == 0).select(F.concat(first, F.lit("_corrected.txt")))).union(h.filter(k % 4 == 0).select(F.concat(first, F.lit(" поправено.txt"))))
    return tables.resolved_names(h.select(F.when(k % 2 == 0, F.upper(first)).otherwise(first).alias("name")), files)


@query("""
WITH s AS (SELECT doc_id, text, coalesce(strlen(text), 0) AS n FROM documents), c AS (SELECT *, ceil(log2(greatest(n, 1)))::INT AS k FROM s),
b AS (SELECT k, n, (row_number() OVER (PARTITION BY k ORDER BY n, text) - 1) // greatest(1, floor(65536 / 2 ** k))::BIGINT AS g FROM c)
SELECT k || '-' || g AS batch, count(*) AS n, max(n) AS padded, sum(n)::BIGINT AS n_bytes FROM b GROUP BY k, g""")
def length_batches(spark, sf_dir):
    """Batches of documents of like lengths, 65,536 bytes each when padded."""
    docs = X.in_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 65536)
    return docs.groupBy("batch", "padded").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("n_bytes"))


# Calibration

_MARGINS = ", ".join(f"({m})" for m in gates.MARGINS)
#: Edits of the substitution noise as windows: a lead drawn by hash, and what undoing the error is worth.
_WINDOWS = f"""{CHARS}, w AS (SELECT item_id, pos, CASE WHEN {_u('n')} < {P_SUB} THEN {_letter('ns')} ELSE c END AS o, c, {_u('lead')} * 2 - 0.5 AS delta FROM ch),
e AS (SELECT item_id, delta, CASE WHEN delta > 0.3 THEN 1.0 ELSE -1.0 END / (SELECT length(text) FROM benchmark b WHERE b.item_id = w.item_id) AS gain FROM w WHERE o <> c),
s AS (SELECT b.item_id, coalesce(sum(delta), 0) / 5 AS lead, count(delta) / length(any_value(text))::DOUBLE AS cer FROM benchmark b LEFT JOIN e USING (item_id) GROUP BY b.item_id)"""


@query(f"""
WITH {_WINDOWS}, m(margin) AS (VALUES {_MARGINS}), g AS (SELECT a.margin, b.margin AS edit_margin FROM m a, m b)
SELECT margin::DOUBLE AS margin, edit_margin::DOUBLE AS edit_margin, round(avg(cer - CASE WHEN lead >= margin THEN coalesce((SELECT sum(gain) FROM e WHERE e.item_id = s.item_id AND delta >= edit_margin), 0) ELSE 0 END), 9) AS mean_cer FROM g, s GROUP BY ALL""")
def gate_margin_grid(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    rows = noise.characters(b, "item_id", "text")
    draw = lambda salt: noise.draw(F.col("item_id"), F.col("pos"), F.lit(salt))
    changed = F.when(draw("n") < P_SUB, noise.uniform(ALPHABET)(F.col("c"), draw("ns"))).otherwise(F.col("c")) != F.col("c")
    wins = rows.filter(changed).select("item_id", (draw("lead") * 2 - 0.5).alias("delta")).join(b.select("item_id", F.length("text").alias("size")), "item_id")
    wins = wins.select("item_id", "size", F.struct("delta", (F.when(F.col("delta") > 0.3, 1.0).otherwise(-1.0) / F.col("size")).alias("cer_gain")).alias("w"))
    of_item = wins.groupBy("item_id").agg(F.collect_list("w").alias("windows"), (F.sum("w.delta") / 5).alias("sentence_delta"), (F.count("w") / F.first("size")).alias("input_cer"))
    scored = b.select("item_id").join(of_item, "item_id", "left").na.fill(0.0, ["sentence_delta", "input_cer"])
    return gates.margin_grid(scored, list(gates.MARGINS), list(gates.MARGINS)).select("margin", "edit_margin", F.round("mean_cer", 9).alias("mean_cer"))


_TEMPERATURES = ", ".join(f"({t}::DOUBLE)" for t in metrics.TEMPERATURES)
_LOGITS = "list_transform(range(1, {n} + 1), lambda i: CASE WHEN '{a}'[i] = o THEN 2.5 ELSE 0.0 END + i / 20.0)"


@query(f"""
WITH {CHARS}, w AS (SELECT c, CASE WHEN {_u('n')} < {P_SUB} THEN {_letter('ns')} ELSE c END AS o FROM ch WHERE contains('{ALPHABET}', c)),
l AS (SELECT {_LOGITS.format(n=len(ALPHABET), a=ALPHABET)} AS x, strpos('{ALPHABET}', c) AS gold FROM w), t(t) AS (VALUES {_TEMPERATURES}),
z AS (SELECT t, x, gold, list_sum(list_transform(x, lambda v: exp((v - list_max(x)) / t))) AS mass FROM l, t),
f AS (SELECT t, 1 / mass AS conf, CASE WHEN list_position(x, list_max(x)) = gold THEN 1 ELSE 0 END AS hit, ln(mass) - (x[gold] - list_max(x)) / t AS nll FROM z),
b AS (SELECT t, least(9, floor(conf * 10)) AS bin, sum(conf) AS c, sum(hit) AS h, count(*) AS n, sum(nll) AS nll FROM f GROUP BY ALL)
SELECT t AS temperature, round(sum(nll) / sum(n), 6) AS nll, round(sum(abs(c - h)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n_tokens FROM b GROUP BY t""")
def temperature_calibration(spark, sf_dir):
    """Logits from the noisy character for each clean one of the alphabet."""
    rows = noise.characters(table(spark, sf_dir, "benchmark"), "item_id", "text").filter(F.expr(f"contains('{ALPHABET}', c)"))
    draw = lambda salt: noise.draw(F.col("item_id"), F.col("pos"), F.lit(salt))
    o = F.when(draw("n") < P_SUB, noise.uniform(ALPHABET)(F.col("c"), draw("ns"))).otherwise(F.col("c"))
    logits = F.array(*[F.when(o == a, 2.5).otherwise(0.0) + (i + 1) / 20.0 for i, a in enumerate(ALPHABET)])
    found = metrics.temperature_table(rows.select(logits.alias("logits"), (F.expr(f"locate(c, '{ALPHABET}')") - 1).alias("target")))
    return found.select("temperature", F.round("nll", 6).alias("nll"), F.round("ece", 6).alias("ece"), "n_tokens")


# The channel

SYMBOLS = "abcdefghijklmnopqrstuvwxyz "
KEPT, INSERTED = 0.9, 0.02
#: Probability of what a lattice goes through.
LEAST = 5e-3
#: Characters of an n-gram: a search has at most as many states as places in the word times contexts of ORDER - 1 characters times candidates.
ORDER = 3


def _copying() -> X.Channel:
    """A channel of fixed rates over the lower-case letters and the space."""
    n = len(SYMBOLS) + 1
    sigma = np.full((n, n + 1), (1.0 - KEPT) / n)
    sigma[np.arange(n), np.arange(n)] = KEPT
    return X.Channel(list(SYMBOLS), sigma, np.full(n, INSERTED / n))


def _symbol(c: str) -> str:
    return f"CASE WHEN contains('{SYMBOLS}', {c}) THEN {c} ELSE '?' END"


@query(f"""
WITH RECURSIVE {NOISED},
t AS (SELECT item_id, list_transform(string_split(clean, ''), lambda x: {_symbol('x')}) AS a, list_transform(string_split(noisy, ''), lambda x: {_symbol('x')}) AS b FROM noised WHERE clean <> '' AND noisy <> ''),
r AS (SELECT item_id, 0 AS d, 0 AS i, 1.0::DOUBLE AS now, 0.0::DOUBLE AS past FROM t
  UNION ALL
  SELECT item_id, d + 1, i + k, sum(CASE WHEN k = 0 THEN CASE WHEN d + 1 - i <= len(b) THEN now * {INSERTED} / {len(SYMBOLS) + 1} ELSE 0 END
    WHEN i + 1 > len(a) THEN 0
    ELSE {1 - INSERTED} * (now * {(1 - KEPT)} / {len(SYMBOLS) + 1} + CASE WHEN d - i BETWEEN 1 AND len(b) THEN past * CASE WHEN a[i + 1] = b[d - i] THEN {KEPT} ELSE {(1 - KEPT)} / {len(SYMBOLS) + 1} END ELSE 0 END) END),
    sum(CASE WHEN k = 0 THEN now ELSE 0 END)
  FROM r JOIN t USING (item_id), (VALUES (0), (1)) s(k) WHERE d < len(a) + len(b) AND i + k <= len(a) AND d + 1 - (i + k) <= len(b) + 1 GROUP BY item_id, d, i + k)
SELECT item_id, round(ln(now * {1 - INSERTED}), 6) AS log_likelihood FROM r JOIN t USING (item_id) WHERE d = len(a) + len(b) AND i = len(a)""")
def channel_likelihood(spark, sf_dir):
    """Log-likelihood of each noised item over all edit paths, by a channel of fixed rates."""
    channel = _copying()

    def run(batches):
        for b in batches:
            rows = [(i, channel.numbers(c), channel.numbers(o)) for i, c, o in zip(b["item_id"], b["clean"], b["noisy"], strict=True)]
            for held in X._batches(rows, 1, 2):
                like, _ = X.path_sums([x[1] for x in held], [x[2] for x in held], channel.logs())
                yield b.__class__({"item_id": [x[0] for x in held], "log_likelihood": like})

    pairs = noised(spark, sf_dir).filter("clean <> '' and noisy <> ''").select("item_id", "clean", "noisy")
    return pairs.mapInPandas(run, f"item_id {pairs.schema['item_id'].dataType.simpleString()}, log_likelihood double").select("item_id", F.round("log_likelihood", 6).alias("log_likelihood"))


def _trained(spark, sf_dir, rounds: int = 4):
    b = table(spark, sf_dir, "benchmark")
    channel, seen = X.trained(noised(spark, sf_dir), rounds=rounds)
    return channel, seen, X.Lattice(channel.pruned(LEAST), X.char_model(models.lexicon(b), order=ORDER))


@query()
def channel_training(spark, sf_dir):
    """The log-likelihood of the noised benchmark before each round of expectation-maximisation and at the end."""
    _, seen, _ = _trained(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(seen)), "round int, log_likelihood double")


@query()
def trained_channel(spark, sf_dir):
    """What the trained channel gives a probability of a thousandth at least."""
    channel, _, _ = _trained(spark, sf_dir)
    return channel.table(spark).filter("p >= 0.001")


@query()
def lattice_corrected(spark, sf_dir):
    """The noised benchmark decoded with the trained channel and a character model of the clean words."""
    _, _, lattice = _trained(spark, sf_dir)
    return X.corrected_with_logs(noised(spark, sf_dir), "item_id", "noisy", lattice, margin=1.0, k=2)


@query()
def regime_cer(spark, sf_dir):
    """Error rates of held-out items by regime: channels trained on synthetic pairs, on real ones, and on both in two stages. Every fifth item is held out."""
    out = None
    held = F.pmod(F.xxhash64("item_id"), F.lit(5)) == 0
    real, synthetic = noised(spark, sf_dir), noised(spark, sf_dir, salt="m", p_sub=0.02)
    val = real.filter(held)
    model = X.char_model(models.lexicon(table(spark, sf_dir, "benchmark").filter(~held)), order=ORDER)
    for regime in X.REGIMES:
        channel = X.of_regime(regime, synthetic.filter(~held), real.filter(~held), rounds=4)
        done = X.corrected_with_logs(val, "item_id", "noisy", X.Lattice(channel.pruned(LEAST), model), margin=1.0, k=2)
        rated = done.join(val.select("item_id", "clean"), "item_id").agg(F.count(F.lit(1)).alias("n"), F.avg(edits.cer_levenshtein(F.col("clean"), F.col("input"))).alias("cer_input"), F.avg(edits.cer_levenshtein(F.col("clean"), F.col("prediction"))).alias("cer"))
        rated = rated.select(F.lit(regime).alias("regime"), "*")
        out = rated if out is None else out.unionByName(rated)
    return out


@query()
def per_edit_gate(spark, sf_dir):
    """Beam corrections, each edit of them judged by the trained channel and the character model; rare words need more."""
    _, pairs, options, counts, channel = _corrector(spark, sf_dir)
    done = models.corrected(pairs, "item_id", "noisy", options, counts, channel, margin=-1e9)
    _, _, lattice = _trained(spark, sf_dir)
    scorer = spark.sparkContext.broadcast(X.LatticeScorer(lattice))
    gate = gates.edit_gate(lambda: scorer.value, margin=0.0, edit_margin=0.0)
    return done.select("item_id", "input", "prediction", gate("input", "prediction").alias("g")).select("item_id", "input", "prediction", "g.*")


@query()
def hybrid_grid(spark, sf_dir):
    """Grid of fusion weights over candidate words of the benchmark: language model, channel by edits, and the trained channel's lattice score."""
    _, pairs, options, _, _ = _corrector(spark, sf_dir)
    _, _, lattice = _trained(spark, sf_dir)
    words = pairs.select("item_id", F.arrays_zip(T.words(F.col("noisy")).alias("n"), T.words(F.col("clean")).alias("c")).alias("z")).select(F.explode("z").alias("z")).select(F.col("z.n").alias("word"), F.col("z.c").alias("clean")).filter("word is not null and clean is not null").distinct()
    rows = words.join(options, "word").withColumn("sample_id", F.concat_ws("|", "word", "clean"))
    scores = rows.select("sample_id", "cand", F.coalesce("logp", F.lit(-20.0)).alias("lm"), models.channel_distance(F.col("word"), F.col("cand")).alias("channel"), X.target_scores(spark, lattice)(F.col("word"), F.col("cand")).alias("neural"), edits.cer_levenshtein(F.col("clean"), F.col("cand")).alias("cer"), (F.col("cand") == F.col("word")).alias("is_identity"))
    grid = [(a, b, c, m) for a in (0.5, 1.0, 1.5) for b in (0.3, 0.6, 1.0) for c in (0.5, 1.5, 2.5) for m in (0.4, 1.2, 2.0)]
    return metrics.grid_search(scores, grid)
