import random

import pytest
from pyspark.sql import functions as F

from labeltrail.operators import bloom, ngrams
from labeltrail.operators.position import split_by_position, with_position


def sequence(spark, labels, start=0):
    return spark.createDataFrame([(start + i, x) for i, x in enumerate(labels)], "idx long, label int")


def brute(labels, n):
    return [(i, tuple(labels[i:i + n])) for i in range(len(labels) - n + 1)]


def found(df):
    return sorted((r.start_idx, tuple(r.ngram)) for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 5, 9])
@pytest.mark.parametrize("bucket", [2, 7, 10_000])
def test_ngrams_equal_the_sliding_window(spark, n, bucket):
    labels = [random.Random(1).choice([-1, 0, 1, 2]) for _ in range(100)]
    seq = sequence(spark, labels).repartition(5)
    assert found(ngrams.label_ngrams(seq, n, bucket_rows=bucket)) == brute(labels, n)
    gapped = seq.withColumn("idx", F.col("idx") * 3 + 5)
    want = [(3 * i + 5, gram) for i, gram in brute(labels, n)]
    assert found(ngrams.label_ngrams(gapped, n, bucket_rows=bucket)) == want


def test_ngrams_per_key_do_not_cross_keys(spark):
    rows = [(i, f"u{min(i % 7, 3)}", i % 3) for i in range(200)]
    seq = spark.createDataFrame(rows, "idx long, user string, label int")
    got = sorted((r.user, r.start_idx, tuple(r.ngram)) for r in ngrams.label_ngrams(
        seq, 3, keys=("user",), bucket_rows=8).collect())
    want = []
    for user in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == user]
        want += [(user, own[i][0], tuple(x[2] for x in own[i:i + 3])) for i in range(len(own) - 2)]
    assert got == sorted(want)


def test_longer_than_the_sequence_gives_none_and_no_filter(spark):
    empty = ngrams.label_ngrams(sequence(spark, [1, 2]), 3)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        bloom.build_filter(empty)


def test_top_ngrams_break_ties_by_first_place(spark):
    labels = [4, 5, 1, 2, 4, 5, 1, 2, 9, 9]
    top = ngrams.top_ngrams(ngrams.label_ngrams(sequence(spark, labels), 2), 4).collect()
    assert [(r.ngram, r.cnt, r.first_idx, r.percent) for r in top] == [
        ("(4, 5)", 2, 0, 22.22), ("(5, 1)", 2, 1, 22.22), ("(1, 2)", 2, 2, 22.22), ("(2, 4)", 1, 3, 11.11)
    ]
    one = ngrams.top_ngrams(ngrams.label_ngrams(sequence(spark, [4]), 1), 1).first()
    assert one.ngram == "(4,)"


def test_compare_sizes(spark):
    rows = ngrams.compare_sizes(sequence(spark, [0, 1, 0, 1, 0]), [2, 3]).collect()
    assert [(r.n, r.total_ngrams, r.unique_ngrams) for r in rows] == [(2, 4, 2), (3, 3, 2)]


def test_positions_are_dense_in_any_partitioning(spark):
    for parts in (1, 4, 13):
        df = spark.range(1000).selectExpr("id * 7 as k").repartition(parts)
        rows = with_position(df, ["k"], "p").orderBy("k").collect()
        assert [r.p for r in rows] == list(range(1000))


def table_of(spark, grams):
    return spark.createDataFrame([(i, list(g)) for i, g in enumerate(grams)], "start_idx long, ngram array<int>")


@pytest.mark.parametrize("shard_capacity", [50, 100_000])
@pytest.mark.parametrize("broadcast_bytes", [0, bloom.BROADCAST_BYTES])
def test_filter_never_misses_and_rarely_errs(spark, shard_capacity, broadcast_bytes):
    known = table_of(spark, [(i, i + 1, i % 5) for i in range(400)])
    fresh = table_of(spark, [(i, i + 2, i % 5) for i in range(20_000)])
    built = bloom.build_filter(known, 0.001, shard_capacity)
    assert built.capacity == 400
    hits = bloom.check_ngrams(built, known, broadcast_bytes)
    assert hits.filter("is_member").count() == hits.count() == 400
    errors = bloom.check_ngrams(built, fresh, broadcast_bytes).filter("is_member").count()
    assert errors < 0.003 * 20_000


def test_rates_out_of_range(spark):
    known = table_of(spark, [(1, 2)])
    for rate in (0.0, 1.0, -1.0):
        with pytest.raises(ValueError):
            bloom.build_filter(known, rate)
    with pytest.warns(UserWarning):
        bloom.build_filter(known, 1e-11)
    with pytest.raises(ValueError):
        bloom.check_ngrams(None, known)


def test_quality_counts_repeats(spark):
    known, test = table_of(spark, [(1, 2), (2, 3)]), table_of(spark, [(1, 2), (1, 2), (7, 7), (2, 3)])
    row = bloom.filter_quality(bloom.build_filter(known, 1e-6), known, test).first()
    assert (row.total_tested, row.true_positive, row.false_positive, row.true_negative, row.false_negative) == (
        4, 3, 0, 1, 0)
    assert (row.precision, row.recall, row.false_positive_rate) == (1.0, 1.0, 0.0)
    empty = bloom.filter_quality(bloom.build_filter(known, 1e-6), known, test.limit(0)).first()
    assert (empty.total_tested, empty.precision, empty.recall) == (0, 0.0, 0.0)


def test_exact_membership_and_self_check(spark):
    known, test = table_of(spark, [(1, 2), (2, 3)]), table_of(spark, [(1, 2), (3, 4)])
    assert [r.is_known for r in bloom.exact_membership(known, test).orderBy("start_idx").collect()] == [True, False]
    assert [tuple(r.ngram) for r in bloom.unseen_ngrams(known, test).collect()] == [(3, 4)]
    row = bloom.self_check(bloom.build_filter(known, 0.001), known).first()
    assert (row.tested, row.found) == (2, 2)


def test_split_by_position(spark):
    first, rest = split_by_position(table_of(spark, [(i,) for i in range(11)]), 0.8)
    assert (first.count(), rest.count()) == (8, 3)


def test_split_by_position_with_offset_gaps_and_repeats(spark):
    first, rest = split_by_position(spark.range(100, 150).withColumnRenamed("id", "start_idx"), 0.8)
    assert (first.count(), rest.count()) == (40, 10) and first.agg({"start_idx": "max"}).first()[0] == 139
    first, rest = split_by_position(spark.range(20).selectExpr("id div 2 * 7 as start_idx", "id as other"), 0.75)
    assert (first.count(), rest.count()) == (15, 5)


def test_membership_with_one_frequent_ngram(spark):
    rows = [(i, "(0, 1)" if i % 10 else f"({i}, {i + 1})") for i in range(400)]
    grams = spark.createDataFrame([(i, [int(x) for x in g.strip("()").split(",")]) for i, g in rows], "start_idx long, ngram array<int>")
    known = grams.filter("start_idx % 20 <> 0")
    checked = bloom.check_ngrams(bloom.build_filter(known, 1e-6), grams).collect()
    exact = {r["start_idx"]: r["is_known"] for r in bloom.exact_membership(known, grams).collect()}
    assert len(checked) == 400 and all(r["is_member"] == exact[r["start_idx"]] for r in checked)
    assert bloom.unseen_ngrams(known, grams).count() == 19 == sum(not v for v in exact.values())
