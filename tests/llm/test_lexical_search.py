"""Ranked search against a one-by-one version."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from fixtures_llm import awkward, awkward_rows, empty, prose

from labeltrail.llm import lexical_search as ls
from labeltrail.llm.queries import ORACLES

_TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_ITEMS = "item_id long, text string"


def _terms(text):
    return _TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def _brute(rows, items, top):
    docs = [(r[0], Counter(_terms(r[1]))) for r in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in docs:
            m = 75 + (25 * c.total() * n_docs) // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in _terms(text) if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda s: s[:3])
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(scored[:top])]
    return _sorted(out)


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def _found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return _sorted([tuple(r) for r in df.collect()])


def _zipf(rng, n):
    return " ".join(f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(n))


@pytest.mark.parametrize("top, bundle, owners, block_docs", [(20, 256, (256, 32, 4), 4096), (3, 4, (30, 8, 3), 16), (2, 1, (5,), 7)])
def test_equals_one_by_one(spark, top, bundle, owners, block_docs):
    rng = random.Random(top)
    rows = [(k, _zipf(rng, rng.randint(0, 40)), "en", "s", 1) for k in range(150)]
    rows += [(200 + k, rows[5][1], "en", "s", 1) for k in range(9)]  # equal scores
    items = [(k, _zipf(rng, rng.randint(1, 12))) for k in range(9)] + [(50, "none of these"), (51, rows[5][1])]
    index = ls.build_index(awkward(spark, rows), block_docs=block_docs)
    found = ls.search(index, spark.createDataFrame(items, _ITEMS), top=top, bundle=bundle, owners=owners)
    assert _found(found) == _brute(rows, items, top)


def test_awkward_rows(spark):
    rows = awkward_rows()
    items = [(1, rows[0][1]), (1, rows[0][1]), (1, "two words"), (None, "Password: HUNTER2XYZ"), (3, None), (4, ""), (5, "ß ö 34"), (6, rows[12][1])]
    asked = spark.createDataFrame(items, _ITEMS).selectExpr("*", "1 AS at", "'x' AS score", "2 AS bundle")
    found = ls.search(ls.build_index(awkward(spark), block_bytes=5_000), asked, top=4, bundle=3)
    assert _found(found) == _brute(rows, items, 4)


def test_accumulators_are_dropped_and_nothing_is_lost(spark, monkeypatch):
    """With a floor from the rare terms, owners of common terms carry few documents on."""
    rng = random.Random(2)
    rows = [(k, _zipf(rng, 30) + (" rare words here" if k < 5 else ""), "en", "s", 1) for k in range(300)]
    items = [(1, "rare words here t1 t2")]
    written = []
    keep = ls.cut
    monkeypatch.setattr(ls, "cut", lambda df, name="": written.append((name, keep(df, name))) or written[-1][1])
    found = ls.search(ls.build_index(awkward(spark, rows), block_docs=64), spark.createDataFrame(items, _ITEMS), top=3, owners=(20, 2))
    assert _found(found) == _brute(rows, items, 3)
    carried = [df.selectExpr("sum(size(items))").first()[0] for name, df in written if name == "carried"]
    assert carried == [5, 5]


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "two words")], _ITEMS)
    assert _found(ls.search(ls.build_index(empty(spark)), items)) == []
    assert _found(ls.search(ls.build_index(awkward(spark)), items.limit(0))) == []


def test_sql(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randint(0, 30)) + " Éa 12", "en", "s", 1) for k in range(80)] + [(90, None, "en", "s", 1)]
    items = [(k, prose(rng, 9) + " ÉA éa") for k in range(5)] + [(3, "the 12"), (2, None)]
    con = duckdb.connect()
    con.register("documents", awkward(spark, rows).toPandas())
    con.register("benchmark", spark.createDataFrame(items, _ITEMS).toPandas())
    found = con.sql(ORACLES["op13_lexical_search"])
    order = [found.columns.index(c) for c in ("item_id", "rank", "doc_id", "score")]
    assert _sorted([tuple(r[k] for k in order) for r in found.fetchall()]) == _brute(rows, items, 20)
