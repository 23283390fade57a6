import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltrail.functions import embed as em
from labeltrail.functions.quantile import column_median
from labeltrail.functions.vectors import l2_normalize
from labeltrail.operators import search
from labeltrail.sources.collection import Collection


def table(spark, x, name="idx"):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    base = np.concatenate([rng.normal(c, 0.3, (60, 5)) for c in (-2, 0, 2)])
    base[10], base[70:90] = 0.0, base[5]  # a zero row, and one row in 21 copies
    asked = np.concatenate([rng.normal(0, 2, (25, 5)), base[:5], np.zeros((1, 5)), np.repeat(base[3:4], 30, 0)])
    return base, asked


def brute(asked, base, k, metric):
    if metric == "cosine":
        def unit(m):
            size = np.linalg.norm(m, axis=1, keepdims=True)
            return np.where(size > 0, m / np.where(size > 0, size, 1), m)
        score = -(unit(asked) @ unit(base).T)
    else:
        score = ((asked[:, None] - base[None]) ** 2).sum(-1)
    return np.round(score, 9).argsort(axis=1, kind="stable")[:, :k], np.sort(score, axis=1)[:, :k]


@pytest.mark.parametrize("metric", ["cosine", "flat"])
@pytest.mark.parametrize("block_rows", [16, None])
def test_topk_is_exact(spark, data, metric, block_rows):
    base, asked = data
    hits = search.search(table(spark, asked, "qid"), table(spark, base), 4, metric, block_rows=block_rows)
    score = -F.col("similarity") if metric == "cosine" else F.col("distance")
    rows = hits.select("qid", "rank", "idx", score.alias("s")).orderBy("qid", "rank").collect()
    _, values = brute(asked, base, 4, metric)
    assert len(rows) == 4 * len(asked)
    assert np.allclose([r.s for r in rows], values.ravel(), atol=1e-9)


def test_copies_go_to_the_smallest_ids(spark, data):
    base, _ = data
    hits = search.search(table(spark, base[5:6], "qid"), table(spark, base), 5, "flat").orderBy("rank").collect()
    assert [r.idx for r in hits] == [5, 70, 71, 72, 73]
    assert [r.distance for r in hits] == [0.0] * 5


def test_k_is_capped_and_empty_raises(spark):
    base = table(spark, [[1.0, 0.0], [0.0, 1.0]])
    assert search.search(table(spark, [[1.0, 0.0]], "qid"), base, 9).count() == 2
    with pytest.raises(ValueError):
        search.search(table(spark, [[1.0, 0.0]], "qid"), base.limit(0), 1)
    with pytest.raises(ValueError):
        search.search(table(spark, [[1.0]], "qid"), base, 1, "manhattan")


def test_metadata_before_and_after(spark):
    base = table(spark, [[float(i)] for i in range(20)]).withColumn(
        "metadata", F.create_map(F.lit("g"), (F.col("idx") % 5).cast("string")))
    asked = table(spark, [[0.0]], "qid")
    pre = search.search(asked, base, 3, "flat", {"g": "4"}, "pre").orderBy("rank").collect()
    post = search.search(asked, base, 3, "flat", {"g": "4"}, "post").orderBy("rank").collect()
    assert [r.idx for r in pre] == [4, 9, 14]
    assert [r.idx for r in post] == [4]  # only the nine nearest are looked at
    assert search.search(asked, base, 3, "flat", {"none": "1"}, "post").count() == 0


def test_inverted_lists(spark, data):
    base, asked = data
    exact = search.search(table(spark, asked, "qid"), table(spark, base), 3, "flat")
    every = search.search(table(spark, asked, "qid"), table(spark, base), 3, "ivf", nprobe=100)
    few = search.search(table(spark, asked, "qid"), table(spark, base), 3, "ivf", nprobe=3)
    want = {(r.qid, r["rank"]): r.idx for r in exact.collect()}
    assert {(r.qid, r["rank"]): r.idx for r in every.collect()} == want
    same = sum(want[r.qid, r["rank"]] == r.idx for r in few.collect())
    assert same / len(want) > 0.5


def test_normalize_keeps_zero(spark):
    rows = table(spark, [[3.0, 4.0], [0.0, 0.0]]).select("idx", l2_normalize("embedding").alias("e")).orderBy("idx")
    assert [r.e for r in rows.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_collection(spark, tmp_path):
    store = Collection(spark, str(tmp_path), "known", "cosine")
    store.append(table(spark, [[3.0, 4.0], [1.0, 0.0]]))
    store.append(table(spark, [[0.0, 2.0]]))
    rows = store.rows().orderBy("idx").collect()
    assert [(r.id, r.idx) for r in rows] == [("known_0", 0), ("known_1", 1), ("known_2", 2)]
    assert np.allclose([r.embedding for r in rows], [[0.6, 0.8], [1, 0], [0, 1]])
    info = store.info().first()
    assert (info.total_embeddings, info.embedding_dim, info.index_type) == (3, 2, "cosine")
    assert store.entries().count() == store.vectors().count() == 3
    with pytest.raises(ValueError):
        store.append(table(spark, [[1.0]]))
    with pytest.raises(ValueError):
        Collection(spark, str(tmp_path), "known", "flat").rows()
    store.append(table(spark, [[1.0, 1.0]]), mode="overwrite")
    assert [r.id for r in store.search(table(spark, [[1.0, 0.0]], "qid"), 3).collect()] == ["known_0"]


def hashed(text, dim):
    out = np.zeros(dim)
    for token in ["[CLS]", *text.lower().split(" ")]:
        h = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
        out[h % dim] += 1 if (h // dim) % 2 == 0 else -1
    size = np.linalg.norm(out)
    return out / size if size else out


def test_hashed_vectors_and_model_function(spark):
    rows = ["a b a", "", "x=1 y=2", "a b a"] + ["hot"] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "idx long, text string")
    got = {r.idx: r.embedding for r in em.embed(df, dim=8).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        assert np.allclose(got[i], hashed(t, 8))
    sized = em.embed(df, fn=lambda batch: np.array([[len(t), 1.0] for t in batch]))
    assert {r.idx: r.embedding[0] for r in sized.collect()} == {i: float(len(t)) for i, t in enumerate(rows)}


def test_cache_is_used_for_known_texts(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "idx long, text string")
    cache = spark.createDataFrame([(hashlib.md5(b"a").hexdigest(), [9.0])], "text_id string, embedding array<double>")
    got = em.embed(df, fn=lambda batch: np.ones((len(batch), 1)), cache=cache).collect()
    assert {r.idx: r.embedding for r in got} == {0: [9.0], 1: [1.0]}


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "k int, vector array<double>")
    assert {r.k: r.embedding for r in em.mean_pool(df, "k").collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}


@pytest.mark.parametrize("size", [1, 2, 101, 60_000])
def test_column_median(spark, size):
    df = spark.range(size).selectExpr("pmod(xxhash64(id), 100003) / 7.0D as v", "1 + id % 3 as w")
    rows = df.collect()
    want = np.median(np.repeat([r.v for r in rows], [r.w for r in rows]))
    assert column_median(df, "v", "w") == pytest.approx(want, abs=1e-12)


def test_column_median_of_many_equal_values(spark):
    df = spark.range(50_000).selectExpr("case when id < 49000 then 0.0D else id end as v", "1L as w")
    assert column_median(df, "v", "w") == 0.0
