"""Repeated byte strings against brute force."""

import hashlib
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from fixtures_llm import awkward, awkward_rows, empty, prose

from labeltrail.llm import suffix_dedup as sd
from labeltrail.llm.queries import ORACLES


def _texts(rng, alphabet, length):
    base = bytes(rng.choices(alphabet, k=rng.randint(length, 500)))
    for _ in range(rng.randint(1, 6)):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(base))
            parts.append(base[a : a + rng.randint(1, 300)] if rng.random() < 0.5 else bytes(rng.choices(alphabet, k=rng.randint(1, 100))))
        if len(text := b"".join(parts)) >= length:
            yield text


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd", bytes(range(248))])
def test_starts_equal_brute_force(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(150):
        length = rng.choice([20, 25, 40, 90])
        texts = list(_texts(rng, alphabet, length))
        if not texts:
            continue
        starts = [rng.randint(1, len(t) - length + 1) for t in texts]
        n = Counter(t[i : i + length] for t, k in zip(texts, starts) for i in range(k))
        want = [[n[t[i : i + length]] > 1 for i in range(k)] for t, k in zip(texts, starts)]
        assert [x.tolist() for x in sd.repeated_starts(texts, starts, length)] == want


def test_phrases_are_no_beginnings_of_each_other():
    """Phrases, and the rests of phrases that are longer than a trigger: a rest begins no other."""
    rng = random.Random(1)
    data = bytes(rng.choices(b"abcdefgh", k=5000))
    at = sd.triggers(sd.run_hashes(sd._symbols(data), sd.TRIGGER)).tolist()
    phrases = {data[a : b + sd.TRIGGER] for a, b in zip([0, *at], at)}
    rests = sorted({p[k:] for p in phrases for k in range(len(p) - sd.TRIGGER)})
    assert len(at) > 50 and not any(b.startswith(a) for a, b in zip(rests, rests[1:]))


def test_smallest_in():
    rng = random.Random(2)
    for _ in range(200):
        values = np.array(rng.choices(range(1000), k=rng.randint(5, 60)), np.uint64)
        width = rng.randint(1, 5)
        assert sd.smallest_in(values, width).tolist() == [int(min(values[i : i + width])) for i in range(len(values) - width + 1)]


def test_periodic_text_takes_seconds():
    start = time.perf_counter()
    assert sd.repeated_starts([b"x" * 1_000_000], [999_601])[0].all()
    assert time.perf_counter() - start < 20


def _brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for row, t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = [[a, b] for a, b in sd._runs(np.array(gone, bool))]
        out.append((row[0], len(t), sum(gone), hashlib.sha256(kept).hexdigest(), spans))
    return _sorted(out)


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r[:3]) + r[3:])


def _found(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "kept_sha256", "spans"]
    return _sorted([(*r[:4], [[s["start"], s["end"]] for s in r[4]]) for r in df.collect()])


def _mixed_rows(seed, n=60):
    rng = random.Random(seed)
    passages = [prose(rng, 60) for _ in range(4)] + ["ab" * 300, "é" * 500]
    rows = []
    for k in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 80) :] if rng.random() < 0.5 else prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 5))]
        rows.append((k, " ".join(parts), "en", "s", 1))
    return rows + [rows[3], (None, rows[4][1], "en", "s", 1), (3, rows[5][1], "en", "s", 1)]


@pytest.mark.parametrize("length, shard_bytes", [(400, 1_000_000), (60, 2_000), (400, 100)])
def test_equals_brute_force(spark, length, shard_bytes):
    """The last: every anchor is held to be crowded, so strings are told by digest."""
    rows = _mixed_rows(length)
    assert _found(sd.repeated_bytes(awkward(spark, rows), length=length, shard_bytes=shard_bytes)) == _brute(rows, length)


def test_awkward_rows(spark):
    assert _found(sd.repeated_bytes(awkward(spark))) == _brute(awkward_rows(), 400)


def test_a_repeat_within_one_text(spark):
    rng = random.Random(9)
    passage = prose(rng, 90)
    rows = [(1, f"{prose(rng, 40)} {passage} {prose(rng, 30)} {passage}", "en", "s", 1), (2, prose(rng, 200), "en", "s", 1)]
    found = _found(sd.repeated_bytes(awkward(spark, rows)))
    assert found == _brute(rows, 400) and found[0][2] >= 2 * len(passage.encode()) and found[1][2] == 0


def test_empty_table_and_length(spark):
    assert _found(sd.repeated_bytes(empty(spark))) == []
    with pytest.raises(ValueError):
        sd.repeated_bytes(empty(spark), length=5)


def test_sql(spark):
    rows = _mixed_rows(5, 25)
    con = duckdb.connect()
    con.register("documents", awkward(spark, rows).toPandas())
    found = con.sql(ORACLES["op12_suffix_dedup"])
    order = [found.columns.index(c) for c in ("doc_id", "n_bytes", "n_removed", "kept_sha256", "n_spans")]
    want = [(*r[:4], len(r[4])) for r in _brute(rows, 400)]
    assert _sorted([tuple(r[k] for k in order) for r in found.fetchall()]) == _sorted(want)


def test_runs_without_a_gap_are_joined(spark):
    """The starts of a crowded piece come one by one and go on as runs."""
    rows = [(1, k, k + 1) for k in (7, 3, 4, 5, 9, 8)] + [(2, 0, 4), (2, 6, 9)]
    df = spark.createDataFrame(rows, "piece int, start int, end int")
    found = df.groupBy("piece").agg(sd._joined(F.collect_list(F.struct("start", "end"))).alias("runs")).collect()
    assert {r.piece: [tuple(x) for x in r.runs] for r in found} == {1: [(3, 6), (7, 10)], 2: [(0, 4), (6, 9)]}
