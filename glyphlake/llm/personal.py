"""Personal data: base patterns, and terms that disclose them by co-occurrence in the corpus. SQL functions only.

Base spans are e-mail addresses, IPv4 addresses, payment cards and phone numbers, by pattern and check. Each distinct matched text is a
protected entity. The whole words of a text, outside its base spans, are terms. All counts are of distinct texts of the corpus: N of them, c(e)
with an entity, c(t) with a term, c(t, e) with both. A text that holds both is judged by the others alone, so that one text, or any number of copies of it,
proves nothing: the term's pointwise mutual information with the entity there, log2(p (N - 1) / (c(t) - 1)), is held against the
entity's own information log2((N - 1) / (c(e) - 1)). p is the lower end of the confidence interval of the term's share of the other texts with
the entity, c(t, e) - 1 of c(e) - 1. A term that gives away at least the share `DISCLOSURE` is a span of kind `term` at all its mentions in texts
with the entity. A word that an e-mail address itself spells before its @ needs no other text, as p is 1: its log2(N / c(t)) is held
against log2(N / c(e)).
`sanitised` puts general labels in the place of base spans, of terms with a capital letter and of those with digits, and takes other terms out.

Entities that the same texts hold count as one, so that a log of many rare addresses has few pairs of entity and term.
Counts are combined before each shuffle, so a frequent term or entity gathers nowhere; the bitmaps that narrow the counted words and
pairs have a fixed size and only let too many pass: a pair is left out where the term is too common to disclose any entity of that count.
Terms and entities are 64-bit hashes. Patterns use possessive loops and a left border, and arrays are folded in chunks
and searched by bisection, so that long runs and many mentions in one text take no quadratic time.

Nulls and edge cases: null and empty texts have no spans; repeated rows are judged each and equal texts count once with an entity; rows
with a null key are judged too; any other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.words import bitmap, in_bitmap, saved

DISCLOSURE = 0.6
#: One-sided 95 % in standard deviations.
CONFIDENCE = 1.645
#: Words; those that touch a base span are not counted as terms.
TERM = r"[\p{L}\p{M}\p{N}]++"

#: Patterns in the order of the kinds; each equals its plain form, see the module's text.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
SIGNS = {"email": "contains(text, '@')", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9][ -]?[0-9]'", "phone": "text rlike '[+][0-9]'"}

_LUHN = "aggregate(sequence(1, length(d)), 0, (s, i) -> s + if((length(d) - i) % 2 = 0, int(substring(d, i, 1)), int(substring('0246813579', int(substring(d, i, 1)) + 1, 1)))) % 10 = 0"
VALID = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', right(ltrim('0', p), 3))) <= 255)",
    "card": f"exists(array(regexp_replace(m, '[ -]', '')), d -> if(length(d) between 12 and 19, {_LUHN}, false))",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15",
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN = "struct<start: int, rank: int, end: int, kind: string, value: string>"
#: Elements of an array that are folded at once: appending one copies those before it.
CHUNK = 64


def _chunks(n: str) -> str:
    """0 to n - 1 (n > 0) as arrays of CHUNK numbers."""
    return f"transform(sequence(0, shiftright({n} - 1, {CHUNK.bit_length() - 1})), i -> sequence(i * {CHUNK}, least(i * {CHUNK} + {CHUNK - 1}, {n} - 1)))"


def _folded(n: str, kind: str, step: str) -> str:
    """Fold of n places of arrays to an array of element type `kind`: step gives struct(at, out) of a (so far) and the place x, at being an int."""
    inner = f"aggregate(y, struct(b.at as at, cast(array() as array<{kind}>) as out), (a, x) -> {step}, a -> struct(a.at as at, concat(b.out, array(a.out)) as out))"
    return f"case when {n} > 0 then aggregate({_chunks(n)}, struct(0 as at, cast(array() as array<array<{kind}>>) as out), (b, y) -> {inner}, b -> flatten(b.out)) else cast(array() as array<{kind}>) end"


def _at_most(array: str, value: str) -> str:
    """How many elements of an ascending array are `value` at most, by bisection."""
    middle = "shiftright(s.lo + s.hi, 1)"
    half = f"if(get({array}, {middle}) <= {value}, struct({middle} + 1 as lo, s.hi as hi), struct(s.lo as lo, {middle} as hi))"
    return f"aggregate(sequence(1, cast(ceil(log2(size({array}) + 1)) as int)), struct(0 as lo, size({array}) as hi), (s, i) -> if(s.lo < s.hi, {half}, s), s -> s.lo)"


def _matches(docs: DataFrame, patterns: dict[str, tuple[str, str]], text: str = "text") -> DataFrame:
    """Adds per name the matches `_m_name` of its pattern, where the text has its sign, and their starts `_at_name`."""
    names = docs.columns
    found = docs.select(*names, *[F.expr(f"case when {sign} then regexp_extract_all({text}, {_quoted(p)}, 0) else array() end").alias(f"_m_{n}") for n, (p, sign) in patterns.items()])
    gaps = found.select(*found.columns, *[F.expr(f"case when size(_m_{n}) > 0 then split({text}, {_quoted(p)}, -1) else array() end").alias(f"_g_{n}") for n, (p, _) in patterns.items()])
    step = "struct(a.at + length(get(_g_{n}, x)) + length(get(_m_{n}, x)) as at, concat(a.out, array(a.at + length(get(_g_{n}, x)))) as out)"
    return gaps.select(*found.columns, *[F.expr(_folded(f"size(_m_{n})", "int", step.format(n=n))).alias(f"_at_{n}") for n in patterns])


def _spans(name: str, rank: int, valid: str) -> Column:
    """Valid matches as structs (start, rank, end, kind, value)."""
    places = f"filter(sequence(0, size(_m_{name}) - 1), x -> exists(array(get(_m_{name}, x)), m -> {valid}))"
    span = f"struct(get(_at_{name}, x) as start, {rank} as rank, get(_at_{name}, x) + length(get(_m_{name}, x)) as end, '{name}' as kind, get(_m_{name}, x) as value)"
    return F.expr(f"case when size(_m_{name}) > 0 then transform({places}, x -> {span}) else cast(array() as array<{SPAN}>) end")


def base_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, the text (empty for null) and `spans` by start and kind."""
    out = _matches(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")), {k: (p, SIGNS[k]) for k, p in KINDS.items()})
    spans = F.array_sort(F.concat(*[_spans(k, i, VALID[k]) for i, k in enumerate(KINDS)]))
    return out.select(F.col("_key").alias(key), "text", spans.alias("spans"))


def _tokens(rows: DataFrame) -> DataFrame:
    """Adds to rows with `spans` and `text`: _tokens (start, end, t, value), words with their hashes, and _starts and _ends, the latter never falling, of the spans."""
    names = rows.columns
    token = "struct(get(_at_term, x) as start, get(_at_term, x) + length(get(_m_term, x)) as end, xxhash64(lower(get(_m_term, x))) as t, get(_m_term, x) as value)"
    words = f"case when size(_m_term) > 0 then transform(sequence(0, size(_m_term) - 1), x -> {token}) else cast(array() as array<struct<start: int, end: int, t: bigint, value: string>>) end"
    ends = _folded("size(spans)", "int", "struct(greatest(a.at, get(spans, x).end) as at, concat(a.out, array(greatest(a.at, get(spans, x).end))) as out)")
    return _matches(rows, {"term": (TERM, "true")}).select(*names, F.expr(words).alias("_tokens"), F.expr("transform(spans, s -> s.start)").alias("_starts"), F.expr(ends).alias("_ends"))


def _words(text: str, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.expr(f"regexp_extract_all({text}, {_quoted(pattern)}, 0)"), lambda w: F.xxhash64(F.lower(w))))


def _term_counts(texts: DataFrame, wanted: DataFrame) -> tuple[DataFrame, int]:
    """(t, ct): how many distinct texts hold each wanted word, and how many distinct texts there are.

    Only texts that may be there more than once, by a bitmap of their digests, are shuffled, one of each task and digest.
    """
    named = texts.select(F.xxhash64(F.lower("text")).alias("digest"), "text")
    copies = saved(named.groupBy("digest").count())
    n = copies.count()
    slots = saved(bitmap(copies.filter("count > 1"), "digest"))
    single = in_bitmap(named, "digest", slots, keep=False).select(_words("text", TERM).alias("ts"))
    several = in_bitmap(named, "digest", slots).select("digest", _words("text", TERM).alias("ts")).groupBy("digest").agg(F.any_value("ts").alias("ts")).select("ts")
    words = single.unionByName(several).select(F.explode("ts").alias("t"))
    return saved(in_bitmap(words, "t", wanted).groupBy("t").agg(F.count(F.lit(1)).alias("ct"))), n


def _surely(hits: Column, of: Column) -> Column:
    """Lower end of the one-sided confidence interval (Wilson's, at CONFIDENCE) of a share that is `hits` of `of`."""
    share, z2 = hits / of, CONFIDENCE**2
    return (share + z2 / (2 * of) - CONFIDENCE * F.sqrt(share * (1 - share) / of + z2 / (4 * of * of))) / (1 + z2 / of)


def disclosing_terms(rows: DataFrame, texts: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(row, terms): spans of terms that disclose an entity of their text. rows: row, spans and text, where there are spans."""
    entity = lambda x: F.xxhash64(x["kind"], F.lower(x["value"]))
    apart = F.expr(f"filter(_tokens, t -> not coalesce(get(_ends, {_at_most('_starts', 't.end')} - 1) >= t.start, false))")
    spelled = F.flatten(F.transform(F.filter("spans", lambda x: x["kind"] == "email"), lambda x: F.transform(F.filter(F.regexp_extract_all(F.substring_index(F.lower(x["value"]), "@", 1), F.lit(TERM), F.lit(0)), lambda w: w.rlike(r"\p{L}{2}")), lambda w: F.struct(entity(x).alias("e"), F.xxhash64(w).alias("t")))))
    tokens = saved(_tokens(rows.select("row", "spans", "text")))
    about = saved(tokens.select("row", F.xxhash64(F.lower("text")).alias("digest"), F.array_distinct(F.transform("spans", entity)).alias("entities"), F.array_distinct(F.transform(apart, lambda t: t["t"])).alias("terms"), F.array_distinct(spelled).alias("spelled")))
    wanted = saved(bitmap(about.select(F.explode("terms").alias("t")), "t"))
    of_term, n = _term_counts(texts, wanted)
    firsts = saved(about.groupBy("digest").agg(F.min("row").alias("row")).select("row"))
    mentions = about.select("row", F.explode("entities").alias("e"))
    # Entities that the same texts hold have the same counts with every term: they are one, named by their count and texts.
    of_entity = saved(mentions.join(firsts, "row", "left_semi").groupBy("e").agg(F.count(F.lit(1)).alias("ce"), F.bit_xor(F.xxhash64("row")).alias("held")).select("e", F.xxhash64("ce", "held").alias("same"), "ce"))
    most = of_entity.agg(F.max("ce")).first()[0]
    # The share of the other texts with the entity is 1 at most, so a term can only disclose entities of at least a certain count; counts go by powers of 2.
    band, last, others = (lambda c: F.floor(F.log2(c)).cast("int")), int(most or 1).bit_length(), float(max(n - 1, 1))
    lowest = F.greatest(F.lit(0), F.floor(F.log2(F.lit(others)) - F.log2(F.lit(others) / (F.col("ct") - 1)) / disclosure).cast("int") - 1)
    able = of_term.filter("ct > 1").withColumn("low", lowest).filter(F.col("low") <= last).select("t", F.explode(F.sequence("low", F.lit(last))).alias("band")).select(F.xxhash64("t", "band").alias("tb"))
    slots = saved(bitmap(able, "tb"))
    known = mentions.join(of_entity.filter("ce > 1"), "e").groupBy("row").agg(F.collect_set(F.struct("same", "ce")).alias("known"))
    listed_pairs = about.join(known, "row").select("row", F.explode("known").alias("k"), "terms").select("row", "k.same", "k.ce", F.explode("terms").alias("t"))
    pairs = saved(in_bitmap(listed_pairs.withColumn("tb", F.xxhash64("t", band(F.col("ce")))), "tb", slots).select("row", "same", "ce", "t"))
    joint = pairs.join(firsts, "row", "left_semi").groupBy("same", "ce", "t").agg(F.count(F.lit(1)).alias("cte")).filter("cte > 1")
    told = F.log2(_surely(F.col("cte") - 1, F.col("ce") - 1) * others / (F.col("ct") - 1))
    chosen = joint.join(of_term, "t").filter((F.col("ce") < n) & (told >= disclosure * F.log2(F.lit(others) / (F.col("ce") - 1)))).select("same", "t")
    # A word that an address itself spells stands for it for certain; it counts if it is rare enough.
    named = about.select("row", F.explode("spelled").alias("x")).select("row", "x.e", "x.t").join(of_entity, "e").join(of_term, "t")
    named = named.filter((F.col("ce") < n) & (F.log2(F.lit(float(n)) / F.col("ct")) >= disclosure * F.log2(F.lit(float(n)) / F.col("ce")))).select("row", "t")
    of_row = pairs.join(chosen, ["same", "t"]).select("row", "t").unionByName(named).groupBy("row").agg(F.array_sort(F.collect_set("t")).alias("_terms"))
    told_at = f"get(_terms, {_at_most('_terms', 't.t')} - 1) = t.t and not coalesce(get(_ends, {_at_most('_starts', 't.end - 1')} - 1) > t.start, false)"
    spans = F.expr(f"transform(filter(_tokens, t -> {told_at}), t -> struct(t.start as start, {len(KINDS)} as rank, t.end as end, 'term' as kind, t.value as value))")
    return tokens.select("row", "_tokens", "_starts", "_ends").join(of_row, "row").select("row", spans.alias("terms"))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """Per row: the key, base (spans of the patterns) and spans (with disclosing terms), as arrays of structs by start."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = saved(base_spans(docs, key, text).select(F.col(key).alias("_key"), "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"))).withColumn("row", F.monotonically_increasing_id())
    terms = disclosing_terms(rows.filter(F.size("spans") > 0).select("row", "spans", "text"), texts, disclosure)
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    joined = rows.select(F.col("_key").alias(key), "row", F.col("spans").alias("base")).join(terms, "row", "left")
    return joined.select(key, "base", F.array_sort(F.concat("base", F.coalesce("terms", none))).alias("spans"))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised(text: str, spans: str) -> Column:
    """The text with a label such as [email] for each base span, and a label or nothing for a term; of overlapping spans the first counts.

    The text is cut once per chunk of spans, so that finding a place in it costs the length of a chunk's part.
    """
    n, one = f"size({spans})", f"get({spans}, x)"
    place = f"if({one}.start < a.at, '', concat(substring(c.part, a.at - c.low + 1, {one}.start - a.at), case when {one}.kind <> 'term' then concat('[', {one}.kind, ']') when {one}.value rlike '^\\\\p{{Lu}}' then '[name]' when {one}.value rlike '\\\\p{{N}}' then '[number]' else '' end))"
    step = f"struct(if({one}.start < a.at, a.at, {one}.end) as at, concat(a.out, array({place})) as out)"
    cut = f"struct(b.at as low, substring({text}, b.at + 1, greatest(get({spans}, element_at(y, -1)).start - b.at, 0)) as part)"
    inner = f"element_at(transform(array({cut}), c -> aggregate(y, struct(b.at as at, cast(array() as array<string>) as out), (a, x) -> {step}, a -> struct(a.at as at, concat(b.out, array(array_join(a.out, ''))) as out))), 1)"
    return F.expr(f"case when {n} > 0 then aggregate({_chunks(n)}, struct(0 as at, cast(array() as array<string>) as out), (b, y) -> {inner}, b -> concat(array_join(b.out, ''), substring({text}, b.at + 1))) else {text} end")


def op8_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
