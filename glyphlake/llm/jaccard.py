"""Exact Jaccard self-join of word n-gram sets by vertical partitioning.

The global order of the n-grams is that of their 64-bit hashes. It is cut into fragments; a set is kept as one row per fragment, the
overlap of a pair is counted in every fragment apart, and the counts are summed per pair. Which pairs are counted:

1. Equal sets are one class, told by a digest; everything below is about classes.
2. The start of the order: if a set may lack d of its n-grams in a partner, and the partner e, the first k common n-grams are among the
   first d + k of the one and the first e + k of the other. Here k is a tenth of the size, of a partner's size at least; classes for
   which fewer of the first n-grams occur in another's first ones are done. This takes counts per n-gram only, combined before the shuffle.
3. Of the rest, n-grams that no other class has bound the sizes that a partner can have.
4. Each class is compared with one hub (the class with the fewest such n-grams among those it shares its first n-grams with).
   Linked classes form components.
5. What could still join two components is compared pair by pair: classes of different components that share one of the first
   n-grams, whose sizes allow the threshold, and whose overlaps with one hub, fragment by fragment and then cell by cell, allow it too.
   Pairs within a component are never listed, however large the component is.

All steps are exact for any data; the bitmap that narrows the second reading of the texts has a fixed size and only lets too many pass.

Nulls and edge cases: null texts and texts without words have an empty set, size 0, and are linked with nothing; shorter texts are one
n-gram as a whole; repeated rows are linked; rows with a null key take part and get the component of what they are linked with.
Any other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.components import components, join_skewed
from glyphlake.llm.words import as_long, bitmap, distinct_shingles, in_bitmap, saved, slices, text_bytes

#: Fragments of the global order: ranges of the hash.
FRAGMENTS = 8
#: Cells that a fragment is cut into once more, for the last bound of a pair.
CELLS = 8
#: Step of the size classes of the last comparison; a row is sent once for each class that its partners may be in.
SIZE_STEP = 1.1


def _sets(docs: DataFrame, key: str, size: int, percent: int) -> DataFrame:
    """Per document: n, digest, and the first n-grams of the order: enough that a partner must share `need` of them, one of the first `must`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, digest, first, need, must = [], [], [], [], []
            for t in b.column(1).to_pylist():
                g = distinct_shingles(t, size)
                lost = len(g) * (100 - percent) // 100  # so many of them a partner can lack
                m = min(len(g), lost + 1 + len(g) // 10)
                n.append(len(g))
                digest.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                first.append(as_long(g[:m]))
                need.append(1 + len(g) * percent // 1000)  # a partner's list is as much longer than what it may lack, by its own size
                must.append(lost + 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(need, pa.int32()), pa.array(must, pa.int32())], names=["_id", "n", "digest", "first", "need", "must"])

    return docs.mapInArrow(run, "_id long, n int, digest binary, first array<long>, need int, must int")


def _fragments(docs: DataFrame, size: int, fragments: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, rows, digest, n, fragment, grams = b.column(0), [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                g = distinct_shingles(t, size)
                if not len(g):
                    continue
                d = xxhash.xxh3_128_digest(g.tobytes())
                cuts = np.searchsorted(g, np.array([k * (2**64 // fragments) for k in range(1, fragments)], np.uint64))
                for k, part in enumerate(np.split(g, cuts)):
                    if len(part):
                        rows.append(i)
                        digest.append(d)
                        n.append(len(g))
                        fragment.append(k)
                        grams.append(as_long(part))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int32())), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(fragment, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["_id", "n", "digest", "fragment", "grams"])

    return docs.mapInArrow(run, "_id long, n int, digest binary, fragment int, grams array<long>")


def _overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, fragment, o): overlaps counted in each fragment apart."""
    one = parts.select(F.col("class").alias("a"), "fragment", F.col("grams").alias("of_a"))
    two = parts.select(F.col("class").alias("b"), "fragment", F.col("grams").alias("of_b"))
    return pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "fragment", F.size(F.array_intersect("of_a", "of_b")).alias("o"))


def _cell(gram: Column) -> Column:
    """The bits of a hash that tell the cell are not those that tell the fragment."""
    return F.pmod(F.shiftrightunsigned(gram, 8), F.lit(CELLS))


def _by_cell(grams: str) -> Column:
    return F.expr(f"transform(sequence(0, {CELLS - 1}), c -> size(filter({grams}, x -> pmod(shiftrightunsigned(x, 8), {CELLS}) = c)))")


def _cells(wanted: DataFrame, parts: DataFrame, alone: DataFrame, fragments: int) -> DataFrame:
    """Per (class, hub): what the class shares with the hub in each cell, and what else it has that others have, as one array."""
    hub = parts.select(F.col("class").alias("hub"), "fragment", F.col("grams").alias("of_hub"))
    both = parts.join(wanted, "class").join(hub, ["hub", "fragment"], "left")
    both = both.select("class", "hub", "fragment", _by_cell("grams").alias("m"), F.coalesce(F.array_intersect("grams", "of_hub"), F.array().cast("array<bigint>")).alias("i"))
    lone = alone.groupBy("class", "fragment").agg(F.map_from_entries(F.collect_list(F.struct("cell", "alone"))).alias("lone"))  # CELLS entries at most
    per = both.join(lone, ["class", "fragment"], "left").select("class", "hub", "fragment", _by_cell("i").alias("o"), "m", "lone")
    rest = F.expr("transform(m, (x, c) -> greatest(x - o[c] - coalesce(cast(try_element_at(lone, cast(c as bigint)) as int), 0), 0))")
    rows = per.select("class", "hub", "fragment", F.concat("o", rest).alias("v")).groupBy("class", "hub").agg(F.map_from_entries(F.collect_list(F.struct("fragment", "v"))).alias("v"))
    none = f"array_repeat(0, {2 * CELLS})"
    return rows.select("class", "hub", F.expr(f"flatten(transform(sequence(0, {fragments - 1}), k -> coalesce(try_element_at(v, k), {none})))").alias("v"))


def _possible(pairs: DataFrame, chosen: DataFrame, parts: DataFrame, alone: DataFrame, sizes: DataFrame, percent: int, fragments: int) -> DataFrame:
    """Pairs whose overlap may reach the threshold, measured at a hub of one of the two, the one that more classes have.

    What both share with a hub, and what both have beside it, bounds their overlap: it is at most the sum over the cells of the smaller
    of either's parts. Only as many overlaps with hubs are counted as there are classes times the hubs that they meet.
    """
    by_hub = chosen.join(chosen.groupBy("b").agg(F.count(F.lit(1)).alias("asked")), "b").select(F.col("a").alias("class"), F.struct("asked", F.col("b").alias("hub")).alias("own"))
    both = pairs.join(by_hub.toDF("a", "own_a"), "a", "left").join(by_hub.toDF("b", "own_b"), "b", "left")
    both = saved(both.select("a", "b", F.greatest("own_a", "own_b")["hub"].alias("hub")))
    at_hub = both.filter("hub is not null")
    wanted = at_hub.select(F.col("a").alias("class"), "hub").unionByName(at_hub.select(F.col("b").alias("class"), "hub")).distinct()
    cells = saved(_cells(wanted, parts, alone, fragments))
    n = sizes.select("class", "n")
    met = both.join(cells.toDF("a", "hub", "va"), ["a", "hub"], "left").join(cells.toDF("b", "hub", "vb"), ["b", "hub"], "left").join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    bound = F.aggregate(F.zip_with("va", "vb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return met.filter(F.isnull("hub") | ((100 + percent) * bound >= percent * (F.col("na") + F.col("nb")))).select("a", "b")


def _linked(overlaps: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose summed overlap is at or over the threshold."""
    total = overlaps.groupBy("a", "b").agg(F.sum("o").alias("o"))
    n = sizes.select("class", "n")
    both = total.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return both.filter((100 + percent) * F.col("o") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, fragments: int = FRAGMENTS) -> DataFrame:
    """Per row: the key, n_shingles, component_id (the smallest key in its component) and class_id (equal for equal sets)."""
    source = text_bytes(docs, F.col(key).cast("long").alias("_id"), text=text)
    base = saved(_sets(source, key, size, percent)).withColumn("row", F.monotonically_increasing_id())
    classes = saved(base.filter("n > 0").groupBy("n", "digest").agg(F.min("row").alias("class"), F.min("_id").alias("low_id"), F.count(F.lit(1)).alias("copies")))

    # First n-grams that two classes have, and the classes that have enough of them.
    firsts = in_bitmap(base.filter("n > 0"), "row", saved(bitmap(classes, "class")))
    tokens = firsts.select("row", F.posexplode("first").alias("at", "token"), "must").select("token", "row", (F.col("at") < F.col("must")).alias("must"))
    shared = tokens.groupBy("token").count().filter("count > 1").select("token")
    hits = saved(tokens.join(shared, "token"))
    enough = hits.groupBy("row").count().join(base.select("row", "need"), "row").filter("count >= need").select(F.col("row").alias("class"))
    left = saved(enough.join(classes, "class"))

    # Their whole sets, by fragment; the texts are read again, but only those of these classes go on.
    again = in_bitmap(source, "_id", saved(bitmap(left.select("low_id"), "low_id")))
    some = _fragments(again, size, fragments).join(left.select("n", "digest", "class", "low_id"), ["n", "digest"]).filter(F.col("_id").eqNullSafe(F.col("low_id")))
    parts = saved(some.select("class", "fragment", "grams").dropDuplicates(["class", "fragment"]))
    token = parts.select("class", "fragment", F.explode("grams").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("class"), F.min("fragment").alias("fragment"))
    alone_cells = saved(token.filter("c = 1").groupBy("class", "fragment", _cell(F.col("token")).alias("cell")).agg(F.count(F.lit(1)).alias("alone")))
    alone_in = alone_cells.groupBy("class", "fragment").agg(F.sum("alone").alias("alone"))
    alone = alone_in.groupBy("class").agg(F.sum("alone").alias("alone"))
    sizes = left.select("class", "n").join(alone, "class", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    # A partner with m n-grams shares at least percent / (100 + percent) of n + m, and at most m or n - alone.
    sizes = sizes.withColumn("least", F.ceil(F.col("n") * percent / 100)).withColumn("most", F.floor((100 * F.col("n") - (100 + percent) * F.col("alone")) / percent))
    sizes = saved(sizes.filter("most >= least"))

    # One hub for each class.
    posts = saved(hits.filter("must").select("token", F.col("row").alias("class")).join(sizes, "class"))
    hubs = posts.groupBy("token").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), F.col("class").alias("class"))).alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", F.col("hub.class").alias("hub"))
    hubs = saved(hubs)
    offers = saved(posts.join(hubs, "token").filter("class <> hub").groupBy("class", "hub").count())
    # Of the hubs that a class shares about as much with, the one that most classes share something with: a family then has one hub.
    asked = offers.groupBy("hub").agg(F.count(F.lit(1)).alias("asked"))
    most = offers.groupBy("class").agg(F.max("count").alias("most"))
    good = offers.join(most, "class").filter("2 * count >= most").join(asked, "hub")
    chosen = saved(good.groupBy("class").agg(F.max(F.struct("asked", "count", "hub")).alias("best")).select(F.col("class").alias("a"), F.col("best.hub").alias("b")))
    with_hub = saved(_overlaps(chosen, parts))
    links = saved(_linked(with_hub, sizes, percent))
    found = components(links)

    # What may still join two components.
    # Per fragment: what a class shares with its hub, and what else it has that others have. Two classes with the same hub share no
    # more than the smaller of either in each fragment.
    per = parts.select("class", "fragment", F.size("grams").alias("m")).join(with_hub.select(F.col("a").alias("class"), "fragment", "o"), ["class", "fragment"], "left").join(alone_in, ["class", "fragment"], "left").na.fill(0, ["o", "alone"])
    at = lambda k, c: F.coalesce(F.sum(F.when(F.col("fragment") == k, c)), F.lit(0)).cast("int")
    vectors = per.groupBy("class").agg(*[at(k, F.col("o")).alias(f"o{k}") for k in range(fragments)], *[at(k, F.greatest(F.col("m") - F.col("o") - F.col("alone"), F.lit(0))).alias(f"e{k}") for k in range(fragments)])
    vectors = saved(vectors.join(chosen.select(F.col("a").alias("class"), F.col("b").alias("hub_of")), "class", "left"))
    names = [f"{x}{k}" for x in "oe" for k in range(fragments)]
    labelled = posts.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")).join(vectors, "class")
    bucket = F.floor(F.log(F.col("n").cast("double")) / float(np.log(SIZE_STEP)))
    hub_side = labelled.join(hubs, "token")
    main = hub_side.filter("class = hub").select("token", F.col("component").alias("main"))
    cut = lambda c: F.floor(F.log(c.cast("double")) / float(np.log(SIZE_STEP)))
    outside = hub_side.join(main, "token").filter("component <> main").select("token", F.col("class").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("alone").alias("ua"), F.col("least").alias("la"), F.col("most").alias("ma"), "main", F.col("hub_of").alias("ha"), *[F.col(c).alias(f"a_{c}") for c in names], F.explode(F.sequence(cut(F.col("least")), cut(F.col("most")))).alias("bucket"))
    others = labelled.select("token", bucket.alias("bucket"), F.col("class").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("alone").alias("ub"), F.col("least").alias("lb"), F.col("most").alias("mb"), F.col("hub_of").alias("hb"), *[F.col(c).alias(f"b_{c}") for c in names])
    may = (F.col("ca") != F.col("cb")) & F.col("nb").between(F.col("la"), F.col("ma")) & F.col("na").between(F.col("lb"), F.col("mb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    may &= (100 + percent) * F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub")) >= percent * (F.col("na") + F.col("nb"))
    bound = sum((F.least(f"a_{c}", f"b_{c}") for c in names), F.lit(0))
    may &= F.coalesce(F.col("ha") != F.col("hb"), F.lit(True)) | ((100 + percent) * bound >= percent * (F.col("na") + F.col("nb")))
    more = outside.join(others, ["token", "bucket"]).filter(may).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = saved(more.join(known, ["a", "b"], "left_anti"))
    rest = _linked(_overlaps(saved(_possible(more, chosen, parts, alone_cells, sizes, percent, fragments)), parts), sizes, percent)
    whole = components(links.unionByName(rest))

    of_class = saved(classes.join(whole.withColumnRenamed("node", "class"), "class", "left"))
    linked = of_class.filter("component is not null")
    lowest = saved(linked.groupBy("component").agg(F.min("low_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    labels = join_skewed(linked, lowest, ["component"], "members").unionByName(of_class.filter("component is null").withColumn("component_id", F.col("low_id")))
    labels = saved(labels.select("n", "digest", "copies", "class", "component_id"))
    found = join_skewed(base.filter("n > 0").select("_id", "n", "digest"), labels, ["n", "digest"], "copies").select("_id", "n", "component_id", "class")
    joined = found.unionByName(base.filter("n = 0").select("_id", "n", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("class")))
    return joined.select(F.col("_id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"), F.col("class").alias("class_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, size=4, percent=85).drop("class_id")


def brute_force(rows: list[tuple[int, str | None]], size: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    """The same from the definition, for tests: id -> set size, component."""
    sets = {}
    for i, t in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    holders: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[:k]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}
