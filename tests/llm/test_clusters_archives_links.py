"""Clustering, archives and token links against brute force, with awkward rows."""

import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

SF = f"{DATA}/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, cluster string")


def clusters(df):
    from glyphlake.llm.centroids import cluster_vectors

    return {r["vec_id"]: (r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], list(r["centroid"])) for r in cluster_vectors(df).collect()}


def test_clusters_brute_force(spark):
    from glyphlake.llm.centroids import brute_force

    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(r.integers(-2, 3), 0.4, 64)]) for i in range(150)]
    rows += [(150 + i, [float(r.integers(0, 2))] * 64) for i in range(30)]  # ties
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [float("nan")] + [1.0] * 63), (206, [float("-inf")] + [1.0] * 63)]
    assert clusters(vectors(spark, rows + bad).repartition(5)) == brute_force(rows)


def test_clusters_edges(spark):
    from glyphlake.llm.centroids import LIMIT, brute_force

    few = [(3, [0.0] * 64), (1, [1.5] * 64), (2, [-1e300] * 32 + [1e300] * 32)]
    got = clusters(vectors(spark, few))
    assert got == brute_force(few) and max(map(abs, got[2][4])) == LIMIT
    assert clusters(vectors(spark, few).limit(0)) == {}
    same = vectors(spark, [(7, [0.25] * 64)] * 20)
    from glyphlake.llm.centroids import cluster_vectors

    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in cluster_vectors(same).collect()] == [(7, 0, 0)] * 20
    assert cluster_vectors(vectors(spark, [(None, [0.5] * 64), (1, [0.0] * 64)])).count() == 2


def test_partial_distances_are_whole_ones():
    from glyphlake.llm.centroids import nearest

    r = np.random.default_rng(1)
    for width in (64, 5, 17):
        q, c = r.integers(-3, 4, (500, width)), r.integers(-3, 4, (9, width))
        far = ((q[:, None, :] - c[None]) ** 2).sum(2)
        cluster, best = nearest(q, c, r.permutation(width))
        assert (cluster == far.argmin(1)).all() and (best == far.min(1)).all()


@pytest.fixture(scope="module")
def pages(spark):
    big, page = "<p>" + "ä" * 70_000, "<html>one</html>"
    rows = [(5, "http://a/5", page), (2, "http://a/2", page), (9, "http://a/9\r\nX: y", None), (1, "http://a/1", ""), (3, None, page), (4, "http://b/4", big), (6, "http://b/6", big)]
    rows += [(7, "http://c/7", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (8, "u", "x"), (8, "u", "x"), (None, "u", "x"), (None, "v", "only\x00here"), (10, "ж", "HTTP/1.1 200 OK\r\n\r\n")]
    return spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, record_type string, key string").repartition(3)


def test_archives(spark, pages, tmp_path):
    from glyphlake.llm import warc

    got = warc.deduplicated(pages, str(tmp_path), volume=400).collect()
    assert len(got) == pages.count()
    wanted = {}
    for r in pages.collect():
        body = (r["html"] or "").encode()
        wanted.setdefault(body, []).append(r["page_id"])
    by_digest = {}
    for r in got:
        by_digest.setdefault((r["payload_digest"], r["payload_bytes"]), []).append(r)
    assert {k: sorted(map(str, v)) for k, v in ((warc._digest(b), v) for b, v in wanted.items())} == {k[0]: sorted(str(r["key"]) for r in v) for k, v in by_digest.items()}
    assert {warc._digest(b): len(b) for b in wanted} == {k[0]: k[1] for k in by_digest}
    for group in by_digest.values():
        first = [r for r in group if r["record_type"] == "response"]
        assert len(first) == 1 and str(first[0]["key"]) == min((str(r["key"]) for r in group), key=lambda k: (k == "None", int(k) if k != "None" else 0))
        assert all(r["refers_to_id"] == first[0]["record_id"] and r["refers_to_key"] == first[0]["key"] for r in group if r["record_type"] == "revisit")
    # any gzip reader takes the files; revisits hold no payload
    files = sorted((tmp_path / "deduplicated").glob("part-*"))
    content = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert content.count("ä".encode()) == 70_000 and content.count(b"WARC-Type: revisit") == sum(r["record_type"] == "revisit" for r in got)
    assert len(files) > 3
    # resolving archives that have been resolved changes nothing
    once = warc.read_archives(spark, str(tmp_path / "deduplicated"), members=True)
    warc.write_deduplicated(once, warc.resolve(once), str(tmp_path / "again"))
    columns = ["record_id", "record_type", "key", "payload_digest", "payload_bytes", "refers_to_id", "refers_to_key"]
    assert sorted(map(str, warc.read_archives(spark, str(tmp_path / "again")).select(columns).collect())) == sorted(map(str, once.select(columns).collect()))


def test_archives_least_and_empty(spark, pages, tmp_path):
    from glyphlake.llm import warc

    got = warc.deduplicated(pages, str(tmp_path / "a"), least=17).collect()
    assert {r["payload_digest"] for r in got if r["record_type"] == "revisit"} == {warc._digest(("<p>" + "ä" * 70_000).encode())}
    assert warc.deduplicated(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_archives_hot_payload(spark, tmp_path):
    from glyphlake.llm import warc

    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 1, F.lit("same")).otherwise(F.concat(F.lit("p"), "id")).alias("html"))
    got = warc.deduplicated(rows, str(tmp_path)).groupBy("record_type", "refers_to_key").count().collect()
    assert {(r["record_type"], r["refers_to_key"]): r["count"] for r in got} == {("response", None): 2001, ("revisit", 1): 999}


def test_damaged_archive(spark, tmp_path):
    from glyphlake.llm import warc

    rows = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(rows, str(tmp_path / "a"))
    (file,) = (tmp_path / "a").glob("part-*")
    content = gzip.decompress(file.read_bytes())
    for name, bad in (("b", content.replace(b"text\r\n\r\n", b"next\r\n\r\n")), ("c", content[:-2])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_bytes(gzip.compress(bad))
        with pytest.raises(Exception, match="digest|long"):
            warc.read_archives(spark, str(tmp_path / name)).collect()


def awkward():
    r = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "d", "é", "中", "😀", "1", "23", ".", "\t", "<|endoftext|>", "the ", "and ", "==", " the", "ab ab", "　", "​"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(200)]
    return texts + [None, "", " ", "<s> x </s>", "a▁b", "▁", "xy" * 2000, " " * 300, "word " * 80, "\x00", "".join(r.choice("abcdefghij") for _ in range(3000)), "word " * 80]


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("head", [0, 50, 1 << 18])
def test_token_links(spark, tokenizers, head):
    from glyphlake.llm.crosstokens import brute_force, link_statistics

    texts = awkward()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, pairs string, n_a string").repartition(3)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in link_statistics(df, *tokenizers, head=head).collect()}
    assert got == brute_force(list(enumerate(texts)), *tokenizers)


def test_token_links_edges(spark, tokenizers):
    from glyphlake.llm.crosstokens import link_statistics

    df = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "one"), (2, None)], "doc_id long, text string")
    got = link_statistics(df, *tokenizers).collect()
    assert sorted((str(r["doc_id"]), r["count_sum"] >= r["n_links"], r["n_a"]) for r in got) == [("1", True, 2), ("1", True, 2), ("2", True, 0), ("None", True, 1)]
    assert link_statistics(df.limit(0), *tokenizers).count() == 0


def test_wide_groups_are_counted_by_distinct_ids():
    from glyphlake.llm import crosstokens as x

    r = np.random.default_rng(0)
    for wide, listed in ((4096, 1 << 22), (0, 7), (10, 50)):
        na, nb = r.integers(1, 30, 40), r.integers(1, 30, 40)
        a, b = r.integers(0, 5, na.sum()), r.integers(0, 4, nb.sum())
        ga, gb = np.repeat(np.arange(40), na), np.repeat(np.arange(40), nb)
        want = np.zeros((40, 5, 4), np.int64)
        for g, p in zip(ga, a, strict=True):
            np.add.at(want[g, p], b[gb == g], 1)
        kept = x.WIDE, x.LISTED
        x.WIDE, x.LISTED = wide, listed
        try:
            parts = list(x._links(a, b, ga, na, nb, 4))
        finally:
            x.WIDE, x.LISTED = kept
        g, pair, times = x._summed(*map(np.concatenate, zip(*parts, strict=True)))
        assert {(i, p): n for i, p, n in zip(g.tolist(), pair.tolist(), times.tolist(), strict=True)} == {(i, p * 4 + q): int(want[i, p, q]) for i, p, q in zip(*np.nonzero(want), strict=True)}


def test_packed_pairs():
    from glyphlake.llm.crosstokens import _packed, _unpacked

    for pairs, times in (([], []), ([0], [1]), ([5, 1 << 40], [1 << 33, 2])):
        p, t = np.array(pairs, np.int64), np.array(times, np.int64)
        got = _unpacked(_packed(p, t), len(p))
        assert (got[0] == p).all() and (got[1] == t).all()


def test_runs_bound_bytes():
    from glyphlake.llm.crosstokens import RUN_BYTES, _runs

    texts = ["x" * 10] * 600 + ["y" * (RUN_BYTES + 5), None, "z" * (RUN_BYTES // 2), "z" * (RUN_BYTES // 2), "w"]
    runs = list(_runs(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])])))
    assert [t for b in runs for t in b.column(1).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= RUN_BYTES for b in runs)
    assert max(b.num_rows for b in runs) == 256


@pytest.mark.parametrize("name", ["op11_partial_distance_clusters", "op12_revisit_resolution"])
def test_sql(spark, name):
    import duckdb
    from glyphlake.llm import entries

    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = con.execute(entries.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    want = sorted(map(str, sql.fetchall()))
    got = entries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in got.select(names).collect()) == want


def test_links_query(spark, tokenizers):
    from glyphlake.llm import entries
    from glyphlake.llm.crosstokens import brute_force

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in entries.queries()["op13_cross_tokenizer_alignment"](spark, SF).collect()}
    assert got == brute_force(rows, *tokenizers)
    assert hashlib.sha256(b"").hexdigest() not in {v[-1] for v in got.values()}
