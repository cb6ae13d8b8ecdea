"""Connected components of a link table, and a join with keys that may hold much of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.words import saved

#: A key of more than one row in HOT is joined by broadcast; there are fewer than HOT such keys in any table.
HOT = 1000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link; null ends and self-links do not count.

    Labels fall to the smallest among the neighbours' and then to their label's own label, so that long chains halve each round.
    Sums and minima per node are combined before the shuffle, and each round is written to the shared folder.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    edges = saved(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = saved(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("seen"))
        lower = labels.join(near, "x").select("x", "label", F.least("label", "seen").alias("low"))
        jump = lower.join(labels.select(F.col("x").alias("low"), F.col("label").alias("up")), "low", "left")
        new = saved(jump.select("x", F.least("low", F.coalesce("up", "low")).alias("label"), "label", (F.least("low", F.coalesce("up", "low")) < F.col("label")).alias("moved")).toDF("x", "new", "old", "moved"))
        moved = new.filter("moved").limit(1).count()
        labels = new.select("x", F.col("new").alias("label"))
        if not moved:
            return labels.toDF("node", "component")


def join_skewed(rows: DataFrame, values: DataFrame, keys: list[str], count: str) -> DataFrame:
    """`rows` left joined with `values`, which have a key once at most and in `count` how many of the rows have it; `count` goes.

    Rows of a key that holds much of the table stay where they are, so that no task gets all of them. `values` are read three times.
    """
    total = values.agg(F.sum(count).alias("total")).first()["total"] or 0
    is_hot = F.col(count) * HOT > total
    hot = saved(values.filter(is_hot))
    some = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(values.filter(~is_hot), keys, "left")
    return some.unionByName(rest).drop(count)
