"""Source audit against a one-by-one version."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from fixtures_llm import awkward, awkward_rows, empty, prose

from labeltrail.llm import source_audit
from labeltrail.llm.queries import ORACLES

_TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def _terms(text):
    return _TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def _brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(_terms(text))
        docs[lang].update(set(_terms(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(total), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def _found(df):
    return sorted(tuple(r[c] for c in _COLUMNS) for r in df.select(*_COLUMNS).collect())


@pytest.mark.parametrize("strip, slice_terms, top", [(256, 512, 50), (2, 3, 4), (1, 1, 1)])
def test_equals_one_by_one(spark, strip, slice_terms, top):
    rng = random.Random(3)
    words = ["aé", "B", "b", "c", "ddd", "Éa", "e", "ﬀ", "zz", "x1y"]
    rows = [
        (k, " ".join(rng.choices(words, weights=[1 + (i * k) % 7 for i in range(10)], k=rng.randint(0, 9))),
         rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", "ß", None]), 1)
        for k in range(60)
    ]
    rows += [(99, "only here", "xx", "alone", 1), (100, None, "yy", "none", 1), (101, "", "yy", None, 1)]
    found = source_audit.audit(awkward(spark, rows), least_docs=3, top=top, strip=strip, slice_terms=slice_terms)
    assert _found(found) == _brute(rows, 3, top)


def test_awkward_rows(spark):
    rows = awkward_rows()
    assert _found(source_audit.audit(awkward(spark), least_docs=1, top=7)) == _brute(rows, 1, 7)


def test_ties_at_the_last_rank(spark):
    texts = [f"{a}{b}" for a in "zyxa" for b in "kbc"]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(50, " ".join(texts * 2), "en", "other", 1)]
    found = _found(source_audit.audit(awkward(spark, rows), least_docs=2, top=5))
    assert found == _brute(rows, 2, 5)


def test_memory_bound_gives_the_same_counts(spark, monkeypatch):
    rng = random.Random(4)
    batch = spark.createDataFrame([("en", "s", prose(rng, 50).encode()) for _ in range(20)], "lang string, source string, text binary").toArrow()
    whole = Counter()
    for part in source_audit._count_part(iter(batch.to_batches())):
        whole.update({r["term"]: r["n"] for r in part.to_pylist()})
    monkeypatch.setattr(source_audit, "HELD_TERMS", 10)
    parts = list(source_audit._count_part(iter(b.slice(k, 1) for b in batch.to_batches() for k in range(b.num_rows))))
    again = Counter()
    for part in parts:
        for r in part.to_pylist():
            again[r["term"]] += r["n"]
    assert len(parts) > 1 and again == whole


def test_counts_past_64_bits_stay_exact(spark):
    df = spark.createDataFrame([(10**10, 3 * 10**10, 7)], "n long, total long, terms long")
    assert df.select(source_audit._share("n", "total", "terms")).first()[0] == 1 + 10**9 * (10**10 + 5) // (3 * 10**10 + 35)


def test_empty_table(spark):
    found = source_audit.audit(empty(spark))
    assert found.columns == list(_COLUMNS) and found.count() == 0


def test_sql(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, 40) + " Éa éa ﬀ", rng.choice(["en", "de"]), rng.choice(["s1", "s2", "ß"]), 1) for k in range(120)]
    con = duckdb.connect()
    documents = awkward(spark, rows).toPandas()  # noqa: F841
    con.register("documents", documents)
    found = con.sql(ORACLES["op11_source_audit"])
    order = [found.columns.index(c) for c in _COLUMNS]
    assert sorted(tuple(r[k] for k in order) for r in found.fetchall()) == _brute(rows, 30, 50)
