"""Cleaning, segmentation and tokens of machine-read text, as Column expressions.

All of them work on batch and streaming DataFrames alike. Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.profiles import Profile, MACEDONIAN

LETTERS = r"\p{L}\p{N}_"

# Patterns of page markers, batch metadata and dash noise, applied in this order.
PAGE_MARKERS = (r"-{1,3}\s*[Pp]age\s+\d+\s*-{1,3}", r"={3,}\s*PAGE\s*\d+\s*={3,}", r"\[Page\s+\d+\]", r"(?m)^Page\s+\d+\s*$", r".{1,80}\s*-{3,}\s*$")
BATCH_LINES = (r"(?m)^\s*#\d+\s*$", r"(?m)^\s*BATCH\s+\d+\s*$", r"(?m)^\s*={3,}.*={3,}\s*$", r"(?mi)^.*МАКЕДОНСКИ\s+OCR\s+ИЗВЕШТАЈ.*$", r"(?m)^\s*Датум:\s*\d.*$", r"(?m)^\s*[#=*]{3,}\s*$")
DASHES = (r"[—\-]{3,}", r"\s*[—\-]{2,}\s*", r"(?m)^\s*[—\-]{2,}\s*$", r"[—\-]{2,}(\s*[—\-]{2,})+")


#: What a text must hold for any pattern of the kind to match; most texts hold nothing of it and are left as they are.
PAGE_SIGNS, BATCH_SIGNS, DASH_SIGNS = r"[Pp]age|PAGE|-{3}", r"#|BATCH|={3}|\*{3}|МАКЕДОНСКИ|Датум:|\n{3}", r"[—\-]{2}"


def _where(text: Column, signs: str, change) -> Column:
    """The change of texts that hold one of the signs. The text is bound once: a column that is named twice is computed twice."""
    return F.element_at(F.transform(F.array(text), lambda t: F.when(t.rlike(signs), change(t)).otherwise(t)), 1)


def has_page_marker(text: Column) -> Column:
    found = F.lit(False)
    for p in (*PAGE_MARKERS[:-1], r".\s*---\s*$"):  # one sign before the last marker is enough
        found = found | text.rlike(p)
    return found


#: The last page marker read from the end of the text: it starts there or not at all, while from the front each place would be tried with 80 lengths.
LAST_REVERSED = r"^\s*-{3,}\s*.{1,80}"


def _without_last_marker(text: Column) -> Column:
    """As PAGE_MARKERS[-1] replaced by nothing. The text is bound once, as in `_where`."""
    ends = lambda t: F.endswith(F.rtrim(t, F.lit(" \t\n\x0b\f\r")), F.lit("---"))
    return F.element_at(F.transform(F.array(text), lambda t: F.when(ends(t), F.reverse(F.regexp_replace(F.reverse(t), LAST_REVERSED, ""))).otherwise(t)), 1)


def _replaced(text: Column, patterns: tuple[str, ...], by: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, by)
    return text


def without_page_markers(text: Column) -> Column:
    return _where(text, PAGE_SIGNS, lambda t: _without_last_marker(_replaced(t, PAGE_MARKERS[:-1], "")))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def without_batch_lines(text: Column) -> Column:
    return _where(text, BATCH_SIGNS, lambda t: F.regexp_replace(_replaced(t, BATCH_LINES, ""), r"\n{3,}", "\n\n"))


def batch_lines_removed(text: Column) -> Column:
    return F.greatest(newlines(text) - newlines(without_batch_lines(text)), F.lit(0))


def without_dash_noise(text: Column) -> Column:
    return stripped(F.regexp_replace(_where(text, DASH_SIGNS, lambda t: _replaced(t, DASHES, " ")), r"\s{2,}", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_garbage_line(line: Column) -> Column:
    s = stripped(line)
    return (F.length(s) <= 1) | ~s.rlike(f"[{LETTERS}]") | s.rlike(r"^\p{Nd}+$")


def good_lines(text: Column) -> Column:
    """Lines (array) that are no garbage, stripped."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: ~is_garbage_line(x)), stripped)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), stripped), lambda x: x != "")


def segments(text: Column, profile: Profile = MACEDONIAN) -> Column:
    """Sentences of a paragraph: cut after . ! ?, and after ; : before a capital."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?])\s+|(?<=[;:])\s+(?=[{profile.capitals}])"), stripped), lambda x: x != "")


def sentences(text: Column) -> Column:
    """The other policy: white space runs become one space, cut after . ! ? or an ellipsis."""
    return F.filter(F.split(F.regexp_replace(stripped(text), r"\s+", " "), r"(?<=[.!?…])\s+"), lambda x: x != "")


def extracted_sentences(text: Column, profile: Profile = MACEDONIAN, compat: bool = False) -> Column:
    """Cleaning, then paragraphs, lines and sentences. compat: dash noise goes first, which joins the paragraphs of a text."""
    text = without_batch_lines(without_page_markers(text))
    if compat:
        text = without_dash_noise(text)
    parts = F.transform(paragraphs(text), lambda p: F.array_join(good_lines(p), " "))
    if not compat:
        parts = F.transform(parts, without_dash_noise)
    return F.flatten(F.transform(parts, lambda p: segments(p, profile)))


def protected_years(text: Column) -> Column:
    return F.regexp_replace(text, r"\((\d{3,4}-\d{3,4})\)", "$1")


def restored_years(text: Column) -> Column:
    return F.regexp_replace(text, "([^]*)", "($1)")


def normalized_token(token: Column, underscore: bool = True) -> Column:
    return F.regexp_replace(F.lower(F.trim(token)), rf"[^\p{{L}}\p{{N}}{'_' if underscore else ''}]+", "")


def tokens(text: Column) -> Column:
    """Words, and other marks one by one."""
    return F.regexp_extract_all(text, F.lit(rf"[{LETTERS}]+|[^{LETTERS}\s]"), F.lit(0))


def gate_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[{LETTERS}'’ʼ\-]+"), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def detokenized(parts: Column) -> Column:
    text = F.array_join(parts, " ")
    text = F.regexp_replace(text, r"\s+([,.;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"\(\s+", "("), r"\s+\)", ")")


def with_case_of(source: Column, target: Column) -> Column:
    upper = (F.upper(source) == source) & (F.lower(source) != source)
    title = (F.upper(F.substring(source, 1, 1)) == F.substring(source, 1, 1)) & (F.lower(F.substring(source, 2, 1 << 20)) == F.substring(source, 2, 1 << 20)) & (F.lower(source) != source)
    lower = (F.lower(source) == source) & (F.upper(source) != source)
    as_title = F.concat(F.upper(F.substring(target, 1, 1)), F.lower(F.substring(target, 2, 1 << 20)))
    return F.when(upper & (F.length(source) > 1), F.upper(target)).when(title | upper, as_title).when(lower, F.lower(target)).otherwise(target)


def in_script(token: Column, profile: Profile = MACEDONIAN) -> Column:
    return token.rlike(f"[{profile.script}]")


def sanitized(text: Column, profile: Profile = MACEDONIAN) -> Column:
    """Letters of kindred alphabets become the profile's; control signs, new lines among them, and letters that are then neither its own nor ASCII go."""
    if profile.replacements:
        letters = sorted(a for a, _ in profile.replacements)
        text = _where(text, f"[[{letters[0]}-{letters[-1]}]&&[{''.join(letters)}]]", lambda t: _exchanged(t, profile.replacements))  # the range first, as most texts hold nothing of it
    return F.regexp_replace(text, profile.unwanted, "")


def _exchanged(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Letters for letters in one pass, then those that become several."""
    single = [(a, b) for a, b in pairs if len(b) == 1] + [(a, b) for a, b in pairs if not b]  # translate drops what has no counterpart
    text = F.translate(text, "".join(a for a, _ in single), "".join(b for _, b in single))
    for a, b in pairs:
        if len(b) > 1:
            text = F.replace(text, F.lit(a), F.lit(b))
    return text


def utf8_offsets(text: Column) -> Column:
    """Byte offset of every character, and of the end."""
    size = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.octet_length)
    return F.transform(F.sequence(F.lit(0), F.size(size)), lambda i: F.aggregate(F.slice(size, F.lit(1), i), F.lit(0), lambda a, x: a + x))


def token_at(text: Column, position: Column) -> Column:
    """The word that holds the character at a position (from 0), or null."""
    left = F.regexp_extract(F.substring(text, 1, 1 << 30).substr(F.lit(1), position), rf"[{LETTERS}]*$", 0)
    right = F.regexp_extract(text.substr(position + 1, F.length(text)), rf"^[{LETTERS}]*", 0)
    return F.when(F.length(right) > 0, F.concat(left, right))


def shingles(text: Column, size: int = 5) -> Column:
    """Character shingles in order; a shorter text has none."""
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: text.substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def ngrams(text: Column, size: int) -> Column:
    """As shingles, but a shorter text that is not empty is one n-gram."""
    return F.when(F.length(text) >= size, shingles(text, size)).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def statistics(text: Column) -> Column:
    """characters, tokens, sentences and tokens per sentence of a text."""
    n_tokens = F.size(F.regexp_extract_all(text, F.lit(rf"[{LETTERS}]+"), F.lit(0)))
    n_sentences = F.size(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: stripped(x) != ""))
    return F.struct(F.length(text).alias("n_chars"), n_tokens.alias("n_tokens"), n_sentences.alias("n_sentences"), F.round(n_tokens / F.greatest(n_sentences, F.lit(1)), 4).alias("tokens_per_sentence"))


def with_context(df: DataFrame, group: str, order: str, text: str, separator: str = " ") -> DataFrame:
    """`context`: the text between its predecessor and successor in the group; order must be unique in a group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("context", F.concat_ws(separator, F.lag(text).over(w), text, F.lead(text).over(w)))


def chunks(df: DataFrame, group: str, order: str, window: int = 20) -> DataFrame:
    """`chunk`: number of the fixed window of rows within a group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / window).cast("int"))


def paragraph_chunks(sentences: DataFrame, paragraphs: DataFrame, group: str, order: str, text: str, window: int = 20, least: int = 8) -> DataFrame:
    """`chunk` of each sentence: along the paragraphs of its group, where there are `least` of them, else by windows of fixed size.

    A paragraph ends at the first sentence with which the sentences' running length reaches the paragraphs' running length less one; one that ends several
    paragraphs closes one chunk. So a sentence closes a chunk just if it reaches more paragraph ends than the one before, and its chunk is how many did
    before it: running sums only. Sentences after the last paragraph are one more chunk. Both tables have `group`, `order` (unique in a group) and `text`;
    null texts count as empty.
    """
    w, before = Window.partitionBy(group).orderBy(order), Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    parts = paragraphs.select(F.col(group).alias("_g"), (F.sum(size).over(w) - 1).alias("_end"))
    enough = parts.groupBy("_g").agg(F.count(F.lit(1)).alias("_parts")).filter(F.col("_parts") >= least)
    rows = sentences.withColumn("_sum", F.sum(size).over(w)).join(enough, F.col(group) == F.col("_g"), "left").drop("_g")
    marks = parts.join(enough.select("_g"), "_g").select("_g", F.col("_end").alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_one"), F.lit(None).cast(sentences.schema[order].dataType).alias("_order"))
    places = rows.filter("_parts is not null").select(F.col(group).alias("_g"), F.col("_sum").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_one"), F.col(order).alias("_order"))
    reached = marks.unionByName(places).withColumn("_reached", F.sum("_one").over(Window.partitionBy("_g").orderBy("_at", "_kind", "_order").rowsBetween(Window.unboundedPreceding, 0)))
    reached = reached.filter("_kind = 1").select("_g", "_order", "_reached")
    out = rows.join(reached, (F.col(group) == F.col("_g")) & (F.col(order) == F.col("_order")), "left").drop("_g", "_order")
    closes = (F.coalesce("_reached", F.lit(0)) > F.coalesce(F.lag("_reached").over(w), F.lit(0))).cast("int")
    out = out.withColumn("_closes", closes).withColumn("_number", F.row_number().over(w))
    chunk = F.when(F.col("_parts").isNull(), F.floor((F.col("_number") - 1) / window)).otherwise(F.coalesce(F.sum("_closes").over(before), F.lit(0)))
    return out.withColumn("chunk", chunk.cast("int")).drop("_sum", "_parts", "_reached", "_closes", "_number")


def usable_pairs(pairs: DataFrame, source: str, target: str, cap: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Pairs with two non-empty sides, and how many sides are over the cap in bytes."""
    kept = pairs.filter((stripped(F.col(source)) != "") & (stripped(F.col(target)) != ""))
    over = kept.agg(F.count_if(F.octet_length(source) > cap).alias("source_over"), F.count_if(F.octet_length(target) > cap).alias("target_over"))
    return kept, over
