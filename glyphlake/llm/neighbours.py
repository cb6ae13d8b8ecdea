"""Near-duplicates among vectors by NN-descent.

Equal vectors are one class. A first neighbour graph comes from sorted runs in buckets of sign hashes. Rounds of NN-descent follow: every vector's
neighbours, and those it is a neighbour of, meet at the vector, and each pair among them that is new may enter both lists. A list
keeps the K best. Rounds go on until at most the share SETTLED of the links is new; where nothing around a vector has changed, no pair
is compared again. A list is saturated if all its K entries are links: such vectors have their lists enlarged to all vectors of their link
component, block by block, and only the counts go on. Links below the threshold never count: every link is a cosine in double precision
of both whole vectors.

The bits of a hash follow the number of vectors, and the tables follow the bits. The links of the vectors whose id is divisible by EVERY are
then counted against all vectors, in blocks. While less than RECALL of them is found, the tables are doubled and rounds go on; once that
would compare as many pairs as there are, all pairs are compared in blocks. `recall` is the same audit of a finished result.

Nulls and edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of another
length than a partner's do not link with it; repeated rows are linked; rows with a null id take part; any other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.llm.components import components, join_skewed
from glyphlake.llm.words import saved

K = 12
#: Share of the links that may still be new when rounds end.
SETTLED = 0.001
#: Tables of sign hashes at least, vectors in a bucket on average, and how far apart in a bucket two vectors may be to meet.
TABLES, FILL, NEAR = 24, 2, 4
#: Share of the links that must be found, of the vectors whose id is divisible by EVERY; rows of a block of these, and numbers in a block of the table.
RECALL, EVERY, AUDITED, COMPONENTS = 0.9, 50, 2048, 1 << 20
#: Vectors in a block of the enlarged lists, and blocks of a component that meet in one task.
BLOCK = 512
#: What a vector v must be to link with any.
USABLE = "(v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0))"


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are brought near 1 by a power of two first, which is exact, so that no square leaves the range of a double."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def classes_of(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Usable vectors, once each: v (array of double), low_id, copies, and audited, the copies whose id is divisible by EVERY."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = vectors.select(F.col(key).cast("long").alias("_id"), v.alias("v")).filter(USABLE)
    return usable.groupBy("v").agg(F.min("_id").alias("low_id"), F.count(F.lit(1)).alias("copies"), F.count_if(F.col("_id") % EVERY == 0).alias("audited"))


def hash_sizes(n: int, threshold: float) -> tuple[int, int]:
    """Bits, so that a bucket holds FILL of n vectors, and tables, so that a pair at the threshold shares one of its buckets at a chance of RECALL."""
    bits = max(1, math.ceil(math.log2(max(n, 2) / FILL)))
    share = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    wanted = math.log(1 - RECALL) / math.log1p(-share) if 0 < share < 1 else 1.0
    return bits, max(TABLES, math.ceil(min(wanted, n / (2 * NEAR))))


def _first_graph(nodes: DataFrame, bits: int, first: int, tables: int) -> DataFrame:
    """Pairs (a, b, cos) that stand near each other in a bucket of the tables from `first` to `tables`."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                s = b.slice(i, 1024)
                dims = s.column(2).to_numpy()
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    lists = s.column(1).take(pa.array(at))
                    x = _matrix(lists)
                    p = planes.get(int(dim))
                    if p is None:
                        p = planes[int(dim)] = np.stack([np.random.default_rng((int(dim), t)).standard_normal((bits + 1, int(dim))) for t in range(first, tables)])
                    x = _unit(x)
                    for t in range(first, tables):
                        part = x @ p[t - first].T
                        bucket = (part[:, :bits] > 0) @ (1 << np.arange(bits))
                        yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(at)), lists, pa.array(((int(dim) * tables + t) << bits) + bucket), pa.array(part[:, bits])], names=["class", "v", "bucket", "along"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            bucket, ids = b.column(2).to_numpy(), b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for at in np.split(np.arange(len(bucket)), cuts):
                if not len(at):
                    continue
                x, i, k = _unit(_matrix(b.column(1).slice(at[0], len(at)))), ids[at], bucket[at[0]]
                if held is not None and held[0] == k:
                    x, i = np.concatenate([held[2], x]), np.concatenate([held[1], i])
                one, two, cos = [], [], []
                for d in range(1, min(NEAR, len(i) - 1) + 1):
                    one.append(i[:-d])
                    two.append(i[d:])
                    cos.append((x[:-d] * x[d:]).sum(1))
                held = (k, i[-NEAR:], x[-NEAR:])
                if one:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), pa.array(np.concatenate(cos))], names=["a", "b", "cos"])

    keyed = nodes.select("class", "v", "dim").mapInArrow(keys, "class long, v array<double>, bucket long, along double")
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "along").mapInArrow(meet, "a long, b long, cos double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Both directions, the k best of each vector, by a running list that is combined before the shuffle."""
    both = pairs.select("a", "b", "cos").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).filter("a <> b").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def _sent(graph: DataFrame, k: int) -> DataFrame:
    """(at, class): which vectors meet where. Each goes to those in its list and, K times at most, to those whose lists it is in."""
    out = graph.select(F.col("b").alias("at"), F.col("a").alias("class"), F.row_number().over(Window.partitionBy("b").orderBy(F.desc("cos"), "a")).alias("r")).filter(F.col("r") <= k).drop("r")
    return out.unionByName(graph.select(F.col("a").alias("at"), F.col("b").alias("class"))).distinct()


def _descend(graph: DataFrame, sent: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Pairs of neighbours of neighbours that are good enough for either list."""
    worst = graph.groupBy("a").agg(F.min("cos").alias("floor"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("class"), F.when(F.col("n") >= k, F.col("floor")).otherwise(-2.0).alias("floor"))
    carried = sent.join(nodes.select("class", "v", "dim"), "class").join(worst, "class", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = rows.filter(pa.array(dims == dim))
                i, f = part.column("class").to_numpy(), part.column("floor").to_numpy()
                x = _unit(_matrix(part.column("v").combine_chunks()))
                g = x @ x.T
                p, q = np.nonzero(np.triu((g > f[:, None]) | (g > f[None, :]), 1))
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(i[p]), pa.array(i[q]), pa.array(g[p, q])], names=["a", "b", "cos"])

        for b in batches:
            at = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(at)) + 1
            for s in np.split(np.arange(len(at)), cuts):
                if not len(s):
                    continue
                part = b.slice(s[0], len(s))
                if held and held[-1].column(0)[0].as_py() != at[s[0]]:
                    yield from flush(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from flush(pa.Table.from_batches(held))

    ordered = carried.select("at", "class", "v", "dim", "floor").repartition("at").sortWithinPartitions("at", "class")
    return ordered.mapInArrow(meet, "a long, b long, cos double")


def _settled(graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """The graph after rounds of local joins, until few links are new. Lists that links saturate do not count: they are enlarged later."""
    met = None
    while True:
        sent = saved(_sent(graph, k))
        fresh = sent if met is None else sent.join(sent.join(met, ["at", "class"], "left_anti").select("at").distinct(), "at", "left_semi")
        new = saved(_best(graph.select("a", "b", "cos").unionByName(_descend(graph, fresh, nodes, k)), k))
        is_link = F.col("cos") >= threshold
        open_lists = new.groupBy("a").agg(F.count_if(is_link).alias("n")).filter(F.col("n") < k).select("a")
        links = new.filter(is_link).join(open_lists, "a", "left_semi")
        changed, total = links.join(graph, ["a", "b"], "left_anti").count(), links.count()
        graph, met = new, sent
        if changed <= SETTLED * total:
            return graph


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) that connect what the links of a block connect."""
    rows, columns, open_rows, open_columns = [], [], hit.any(1), hit.any(0)
    while open_rows.any():
        near = np.array([int(np.argmax(open_rows))])
        open_rows[near] = False
        while len(near):
            seen = hit[near] & open_columns
            across = np.flatnonzero(seen.any(0))
            rows.append(near[seen[:, across].argmax(0)])
            columns.append(across)
            open_columns[across] = False
            back = hit[:, across] & open_rows[:, None]
            near = np.flatnonzero(back.any(1))
            rows.append(near)
            columns.append(across[back[near].argmax(1)] if len(near) else near)
            open_rows[near] = False
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _enlarged(members: DataFrame, threshold: float, joined: bool = False) -> DataFrame:
    """Links of each member of a component with all others of it: (class, other, links in vectors). Members meet in blocks of BLOCK.

    `other` is null; with `joined`, further rows without links have in it what connects the members of each pair of blocks.
    """
    sizes = saved(members.groupBy("component", "dim").agg(F.count(F.lit(1)).alias("members")).withColumn("blocks", F.ceil(F.col("members") / BLOCK)))
    blocks = join_skewed(members, sizes, ["component", "dim"], "members").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = blocks.withColumn("other", other).select("component", "dim", F.col("block").alias("p"), F.col("other").alias("q"), "class", "v", "copies", F.lit(True).alias("own"))
    right = blocks.withColumn("other", other).select("component", "dim", F.col("other").alias("p"), F.col("block").alias("q"), "class", "v", "copies", F.lit(False).alias("own"))

    def count(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy(zero_copy_only=False)
        a, b = table.filter(pa.array(own)), table.filter(pa.array(~own))
        if not a.num_rows or not b.num_rows:
            return pa.table({"class": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        i, j = a.column("class").to_numpy(), b.column("class").to_numpy()
        g = _unit(_matrix(a.column("v").combine_chunks())) @ _unit(_matrix(b.column("v").combine_chunks())).T
        hit = (g >= threshold) & (i[:, None] != j[None, :])
        r, c = _forest(hit) if joined else ([], [])
        none = pa.nulls(len(i), pa.int64())
        return pa.table({"class": pa.concat_arrays([pa.array(i), pa.array(i[r], pa.int64()) if joined else none[:0]]), "other": pa.concat_arrays([none, pa.array(j[c], pa.int64()) if joined else none[:0]]), "links": pa.concat_arrays([pa.array(hit @ b.column("copies").to_numpy()), pa.nulls(len(r), pa.int64())])})

    met = left.unionByName(right).groupBy("component", "dim", "p", "q").applyInArrow(count, "class long, other long, links long")
    return met.groupBy("class", "other").agg(F.sum("links").alias("links"))


def _counted(graph: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Per vector with a link: class, component and links in vectors, from the graph."""
    links = saved(graph.filter(F.col("cos") >= threshold).select("a", "b"))
    found = saved(components(links).toDF("class", "component"))
    # Saturated lists: the whole component takes part.
    full = links.groupBy("a").count().filter(F.col("count") >= k).select(F.col("a").alias("class"))
    dense = found.join(full, "class").select("component").distinct()
    members = found.join(dense, "component").join(nodes, "class")
    enlarged = _enlarged(members.select("component", "class", "v", "dim", "copies"), threshold).drop("other")
    pairs = links.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("class"), F.col("a").alias("other"))).distinct()
    few = pairs.join(nodes.select(F.col("class").alias("other"), "copies"), "other").groupBy("class").agg(F.sum("copies").alias("few"))
    return saved(found.join(few, "class", "left").join(enlarged, "class", "left").select("class", "component", F.coalesce("links", "few").alias("links")))


def _all_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """The same from all pairs, in blocks."""
    met = saved(_enlarged(nodes.select(F.lit(0).alias("component"), "class", "v", "dim", "copies"), threshold, joined=True))
    found = components(met.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))).toDF("class", "component")
    return saved(found.join(met.filter("other is null").select("class", "links"), "class"))


def _true_links(queries: DataFrame, usable: DataFrame, threshold: float) -> DataFrame:
    """(id, n): links in vectors of each of `queries` (id, v, dim) with all of `usable` (id, v, dim, copies) of another id.

    Blocks of AUDITED queries meet blocks of the table, of COMPONENTS numbers each, in one job; a table's block goes to each block of queries.
    """
    blocks = lambda df, each: df.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / each).alias("n"))
    sizes = blocks(queries, F.lit(AUDITED)).withColumnRenamed("n", "ps").join(blocks(usable, F.lit(COMPONENTS) / F.col("dim")).withColumnRenamed("n", "cs"), "dim")
    sizes = F.broadcast(saved(sizes))  # a row per length of vectors
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = queries.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("id"), F.col("ps")).alias("p"), all_of("cs").alias("c"), "id", "v", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("own"))
    two = usable.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("id"), F.col("cs")).alias("c"), all_of("ps").alias("p"), "id", "v", "copies", F.lit(False).alias("own"))

    def count(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy(zero_copy_only=False)
        a, b = table.filter(pa.array(own)), table.filter(pa.array(~own))
        i, total = a.column("id").to_numpy(), np.zeros(a.num_rows, np.int64)
        if len(i) and b.num_rows:
            x, y, j = _unit(_matrix(a.column("v").combine_chunks())), _unit(_matrix(b.column("v").combine_chunks())), b.column("id").to_numpy()
            for k in range(0, len(y), 1024):
                total += ((x @ y[k : k + 1024].T >= threshold) & (i[:, None] != j[None, k : k + 1024])) @ b.column("copies").to_numpy()[k : k + 1024]
        return pa.table({"id": pa.array(i), "n": pa.array(total)})

    return saved(one.unionByName(two).groupBy("dim", "p", "c").applyInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")))


def _share_found(true: DataFrame, audited: DataFrame, rated: DataFrame) -> float:
    """Share of the true links of the audited vectors that `rated` counts; copies are links that are always found."""
    got = audited.select("class", "copies", "audited").join(true.withColumnRenamed("id", "class"), "class", "left").join(rated.select("class", "links"), "class", "left").na.fill(0, ["n", "links"])
    copies = F.col("copies") - 1
    r = got.agg(F.sum(F.col("audited") * (F.col("n") + copies)).alias("total"), F.sum(F.col("audited") * (F.least("links", "n") + copies)).alias("found")).first()
    return r["found"] / r["total"] if r["total"] else 1.0


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, k: int = K) -> DataFrame:
    """Per row: the key, n_links, component_id, kept."""
    nodes = saved(classes_of(vectors, key, vector).withColumn("dim", F.size("v"))).withColumn("class", F.monotonically_increasing_id())
    n = nodes.count()
    audited = nodes.filter("audited > 0")
    named = nodes.select(F.col("class").alias("id"), "v", "dim", "copies")
    true = _true_links(audited.select(F.col("class").alias("id"), "v", "dim"), named, threshold)
    bits, tables = hash_sizes(n, threshold)
    graph, first = None, 0
    while True:
        met = _first_graph(nodes, bits, first, tables)
        graph = _settled(saved(_best(met if graph is None else graph.select("a", "b", "cos").unionByName(met), k)), nodes, k, threshold)
        rated = _counted(graph, nodes, threshold, k)
        if _share_found(true, audited, rated) >= RECALL:
            break
        first, tables = tables, 2 * tables
        if 2 * NEAR * tables >= n:
            rated = _all_pairs(nodes, threshold)
            break
    linked = saved(nodes.select("class", "v", "low_id", "copies").join(rated, "class", "left"))
    lowest = saved(linked.filter("component is not null").groupBy("component").agg(F.min("low_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    labels = join_skewed(linked.filter("component is not null"), lowest, ["component"], "members")
    labels = labels.unionByName(linked.filter("component is null").withColumn("component_id", F.col("low_id")))
    labels = saved(labels.select("v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    rows = vectors.select(F.col(key).alias("_key"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    found = join_skewed(rows.filter(USABLE), labels, ["v"], "copies").select("_key", "n_links", "component_id")
    out = found.unionByName(rows.filter(f"not coalesce({USABLE}, false)").select("_key", F.lit(0).alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    out = out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("_key").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def recall(vectors: DataFrame, result: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, every: int = EVERY) -> float:
    """Share of the links of the vectors whose id is divisible by `every`, against all vectors in blocks, that `result` counts."""
    usable = vectors.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).filter(USABLE)
    usable = usable.withColumn("dim", F.size("v")).withColumn("copies", F.lit(1).cast("long"))
    true = _true_links(usable.filter(F.col("id") % every == 0), usable, threshold)
    r = true.join(result.select(F.col(key).alias("id"), "n_links"), "id").agg(F.sum("n").alias("total"), F.sum(F.least("n", "n_links")).alias("found")).first()
    return r["found"] / r["total"] if r["total"] else 1.0


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
