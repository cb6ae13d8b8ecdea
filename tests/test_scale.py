"""Forms without a single task or driver list, against the plain definition."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphlake.operators import metrics, models, realism


def test_within_edits(spark):
    r = random.Random(2)
    made = lambda n: "".join(r.choice("abc") for _ in range(n))
    words = {made(r.randint(1, 9)) for _ in range(150)} | {"", "a", "b"}
    for n in (18, 19, 20, 21, 22, 23, 60):
        for _ in range(4):
            w = made(n)
            words |= {w, w[1:], w[:3] + w[4:], w[:5] + "c" + w[5:], w[:9] + "a" + w[10:-1], "b" + w + "b", "ab" + w + "c"}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    want = df.crossJoin(df.toDF("cand")).withColumn("distance", F.levenshtein("word", "cand", 2)).filter("distance >= 0")
    got = models.within_edits(df, df.toDF("cand"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_numbered_and_ks(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(f"s{r.random()}", r.randint(0, 40), k % 3) for k in range(500)], "sample_id string, v int, side int").repartition(7)
    want = df.select("sample_id", (F.row_number().over(Window.orderBy("sample_id")) - 1).alias("i"))
    assert sorted(map(tuple, metrics.numbered(df, "sample_id").select("sample_id", "i").collect())) == sorted(map(tuple, want.collect()))
    a, b = df.filter("side = 0"), df.filter("side > 0")
    x, y = ([t["v"] for t in z.collect()] for z in (a, b))
    ks = max(abs(sum(t <= v for t in x) / len(x) - sum(t <= v for t in y) / len(y)) for v in {*x, *y})
    assert abs(realism.ks_distance(a, b, "v").first()["ks"] - ks) < 1e-12
    assert realism.ks_distance(a.limit(0), b, "v").first()["ks"] == 0 and realism.ks_distance(a.limit(0), b.limit(0), "v").first()["ks"] == 0
