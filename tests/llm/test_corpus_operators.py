"""Operators that compare documents or vectors with each other, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from fixtures_llm import awkward, awkward_rows, empty, prose, rows_of

import corpus_pipeline
from labeltrail.llm import decontaminate, embedding_dedup, simhash, substring_dedup, word_windows
from labeltrail.llm.queries import ORACLES, QUERIES

_WORD = re.compile("[^\x20\x09-\x0D]+")
_nulls_first = lambda r: tuple((x is not None, x) for x in r)


def _roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _smallest(ids, roots):
    """Smallest id of each row's group, null if there is none."""
    return [min((ids[k] for k, q in enumerate(roots) if q == r and ids[k] is not None), default=None) for r in roots]


# --- words ---


def test_word_hashes_follow_words_only():
    a = word_windows.word_hashes("one two\tthree one".encode())
    b = word_windows.word_hashes(" \n three  one\x0btwo ".encode())
    assert len(a) == 4 and a[0] == a[3] and (a[[2, 3, 1]] == b).all()
    assert len(word_windows.word_hashes(b"")) == 0 and len(word_windows.word_hashes("é\xa0x".encode())) == 1
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    for which in (0, 1):
        runs = word_windows.run_hashes(words, 4, which)
        by_words = {tuple(words[i : i + 4].tolist()): set() for i in range(397)}
        for i, r in enumerate(runs.tolist()):
            by_words[tuple(words[i : i + 4].tolist())].add(r)
        assert all(len(s) == 1 for s in by_words.values()) and len(set(runs.tolist())) == len(by_words)
    runs = rng.integers(0, 50, 100).astype(np.uint64)
    assert word_windows.minimizers(runs, 7).tolist() == sorted({i + int(runs[i : i + 7].argmin()) for i in range(94)})


# --- SimHash ---


def _fingerprint(text):
    words = _WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _close_pairs(prints):
    return [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]


def test_simhash_rows(spark):
    rows = awkward_rows()
    prints = [_fingerprint(t) for _, t, *_ in rows]
    ids = [r[0] for r in rows]
    want = _smallest(ids, _roots(len(rows), _close_pairs(prints)))
    got = rows_of(simhash.near_duplicates(awkward(spark)), "doc_id", "fp", "component_id")
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert got == sorted(zip(ids, signed, want), key=_nulls_first)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [10_000, 40, 8])
def test_simhash_groups_of_any_size(spark, limit):
    """Random prints, dense clusters and chains; small limits split groups up to the last level."""
    rng = random.Random(limit)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(40):
            prints.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
    centre = rng.getrandbits(64)
    prints |= {centre ^ 1 << b for b in range(64)} | {centre}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fp long"), limit).collect()
    at = {p: i for i, p in enumerate(signed)}
    assert _roots(len(prints), [(at[r["a"]], at[r["b"]]) for r in links]) == _roots(len(prints), _close_pairs(prints))
    assert len(links) <= 4 * len(prints) * 2


def test_one_document_of_each_group_stays(spark):
    rows = awkward_rows()
    roots = _roots(len(rows), _close_pairs([_fingerprint(t) for _, t, *_ in rows]))
    kept = simhash.keep_one(awkward(spark))
    got = [r["doc_id"] for r in kept.collect()]
    firsts = set(_smallest([r[0] for r in rows], roots))
    assert sorted(d for d in got if d is not None) == sorted(d for d in firsts if d is not None)
    assert got.count(None) == len({r for r, s in zip(roots, _smallest([r[0] for r in rows], roots)) if s is None})
    assert kept.columns == awkward(spark).columns
    assert simhash.keep_one(empty(spark)).count() == 0


# --- repeated passages ---


def _left_over(rows, window=50):
    words = [_WORD.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (doc, *_), w in zip(rows, words):
        if doc is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    found = []
    for (doc, *_), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        found.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=_nulls_first)


@pytest.mark.parametrize(("shard", "task"), [(20_000, 200_000), (16, 30)])
def test_repeated_passages(spark, shard, task):
    rng = random.Random(11)
    rows = awkward_rows()
    passages = [prose(rng, n) for n in (49, 50, 51, 120, 400)] + ["again and again " * 40]
    for k in range(60):
        text = " ".join(rng.choice([prose(rng, rng.randint(1, 30)), rng.choice(passages), "\n".join(rng.choice(passages).split()[5:70])]) for _ in range(5))
        rows.append((1000 + k, text, None, None, None))
    found = substring_dedup.repeated_spans(awkward(spark, rows), shard_windows=shard, task_windows=task)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == _left_over(rows)
    for r in found.collect():
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_repeated_passages_of_nothing(spark):
    assert substring_dedup.repeated_spans(empty(spark)).count() == 0
    rows = [(1, "a b c", None, None, None), (2, None, None, None, None)]
    assert rows_of(substring_dedup.repeated_spans(awkward(spark, rows)), "doc_id", "n_removed") == [(1, 0), (2, 0)]


def test_automaton_gives_longest_matches():
    rng = random.Random(2)
    for _ in range(40):
        reference = [rng.choice("abc") for _ in range(30)]
        stream = [rng.choice("abcd") for _ in range(40)]
        automaton = substring_dedup.SuffixAutomaton()
        automaton.extend(reference)
        parts = {tuple(reference[i:j]) for i in range(30) for j in range(i, 31)}
        want = [max(n for n in range(k + 2) if tuple(stream[k + 1 - n : k + 1]) in parts) for k in range(40)]
        assert list(automaton.statistics(stream)) == want
    assert substring_dedup.spans_above([1, 2, 3, 1, 2, 3, 1], 3) == [(0, 6)]
    assert substring_dedup.spans_above([1, 2, 3, 1, 1, 2, 3], 3) == [(0, 3), (4, 7)]


# --- decontamination ---


def _shingles(text):
    words = [w.decode() for w in (text or "").lower().encode().split()]
    size = min(5, len(words))
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def test_contained_items(spark, monkeypatch):
    rng = random.Random(12)
    items = [(k, prose(rng, rng.choice([1, 3, 5, 6, 14, 30, 57])), "x") for k in range(40)] + [(90, None, "x"), (91, " \n", "x"), (None, prose(rng, 20), "x"), (5, prose(rng, 15), "x")]
    items.append(items[0])
    rows = awkward_rows()
    for k in range(120):
        words = (rng.choice(items)[1] or "").split()
        if words and rng.random() < 0.7:
            words[rng.randrange(len(words))] = "changed"
        rows.append((2000 + k, f"{prose(rng, rng.randint(0, 300))} {' '.join(words).upper()}\n{prose(rng, 20)}", None, None, None))
    want = set()
    for doc, text, *_ in rows:
        for item, own, _ in items:
            q, words = _shingles(own), (text or "").lower().split()
            size = min(5, len((own or "").split())) if q else 0
            have = {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()
            if q and len(q & have) >= math.ceil(0.8 * len(q) - 1e-9):
                want.add((doc, item, len(q & have), len(q)))
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    found = decontaminate.find_items(awkward(spark, rows), bench)
    assert set(rows_of(found, "doc_id", "item_id", "n_shared", "n_shingles")) == want
    clean = decontaminate.remove_contaminated(awkward(spark, rows), bench)
    leaks = {d for d, *_ in want}
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == sorted(d or 0 for d, *_ in rows if d not in leaks)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)  # many blocks of items
    blocks = decontaminate.find_items(awkward(spark, rows), bench)
    assert set(rows_of(blocks, "doc_id", "item_id", "n_shared", "n_shingles")) == want
    assert decontaminate.find_items(empty(spark), bench).count() == 0
    assert decontaminate.find_items(awkward(spark), bench.limit(0)).count() == 0


# --- vectors ---


def _linked(rows):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    pairs = []
    for i, (_, v, a, _) in enumerate(rows):
        for j in range(i):
            w, b = rows[j][1], rows[j][2]
            if a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    pairs.append((i, j))
    links = [sum(i in p for p in pairs) for i in range(len(rows))]
    return links, _smallest([r[0] for r in rows], _roots(len(rows), pairs))


@pytest.mark.parametrize(("block", "passes"), [(1024, None), (8, 6)])
def test_near_vectors(spark, block, passes):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=12).tolist(), int(rng.integers(3)), "x") for k in range(60)]
    for k in range(5):
        centre = rng.normal(size=12)
        rows += [(100 + 20 * k + i, (centre + rng.normal(0, 0.05, 12)).tolist(), k % 3, "x") for i in range(12)]
    dense = rng.normal(size=12)  # longer than many small blocks
    rows += [(300 + i, (dense + rng.normal(0, 0.02, 12)).tolist(), 1, "x") for i in range(50)]
    rows += [rows[0], (400, rows[0][1], rows[0][2], "x"), (401, None, 1, "x"), (402, [], 1, "x"), (403, [0.0] * 12, 1, "x"), (404, [1.0, None], 1, "x")]
    rows += [(405, [float("nan")] * 12, 1, "x"), (406, [1e300] * 12, 1, "x"), (407, [1e300] * 12, 1, "x"), (408, rows[0][1], None, "x"), (409, [1.0, 2.0], 1, "x"), (None, rows[1][1], rows[1][2], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string").repartition(4)
    links, component = _linked([r if r[1] != [1e300] * 12 else (r[0], [1.0] * 12, r[2], r[3]) for r in rows])
    got = rows_of(embedding_dedup.near_vectors(df, block=block, passes=passes), "vec_id", "n_links", "component_id", "kept")
    want = sorted(((r[0], n, c, r[0] is not None and r[0] == c) for r, n, c in zip(rows, links, component)), key=_nulls_first)
    met = sum(g[1] for g in got) / sum(links)
    assert 0.9 <= met <= 1 and all(g[1] <= w[1] for g, w in zip(got, want))
    if block == 1024:
        assert got == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("shared, share", [(0.0, 1.0), (0.8, 1.0), (0.9, 0.4)])
def test_near_vectors_that_share_a_direction(spark, shared, share):
    """Planted pairs just above the threshold, where the first ``share`` of a label has the mean cosine ``shared``."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = unit(rng.normal(size=64))
    x = rng.normal(size=(3_000, 64))
    x = unit(x - np.outer(x @ axis, axis))
    x[: int(share * 3_000)] = np.sqrt(shared) * axis + np.sqrt(1 - shared) * x[: int(share * 3_000)]
    x = unit(x)
    away = rng.normal(size=(400, 64))
    away = unit(away - (away * x[:400]).sum(axis=1, keepdims=True) * x[:400])
    x = np.concatenate([x, 0.935 * x[:400] + math.sqrt(1 - 0.935**2) * away])
    wanted = (x @ x.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(df, block=32).select("vec_id", "n_links").collect()}
    assert all(got[k] <= n for k, n in enumerate(wanted.tolist()))
    assert sum(got.values()) >= embedding_dedup.RECALL * wanted.sum()


def test_passes_grow_slowly():
    assert [embedding_dedup.passes_for(n) for n in (1, 5_000, 10**6, 10**9)] == sorted(embedding_dedup.passes_for(n) for n in (1, 5_000, 10**6, 10**9))
    assert embedding_dedup.passes_for(10**9) < 80


# --- pipeline and registry ---


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    item = prose(rng, 30)
    rows = [(k, prose(rng, 60, lang), lang, f"s{k % 3}", 1) for k in range(80) for lang in [("en", "de")[k % 2]]]
    rows += [(200, rows[0][1], "en", "s", 1), (201, "12 34", "en", "s", 1), (202, None, "en", "s", 1), (203, f"{prose(rng, 40)} {item} {prose(rng, 40)}", "en", "s", 1)]
    rows += [(204, f"{prose(rng, 60)} password=hunter2xyz {prose(rng, 20)}", "en", "s", 1), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "tokens"]
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {*range(80), 204}
    assert "hunter" not in found[204]["decoded"].replace("</w>", "").replace(" ", "") and found[204]["n_tokens"] == len(found[204]["ids"])
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        none = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def test_registry():
    import __spark_entry__ as entry

    assert sorted(k for k in entry.queries() if re.match(r"op\d+_", k)) == sorted(QUERIES)
    assert {re.match(r"op(\d+)_", k)[1] for k in QUERIES} == {str(n) for n in range(1, 11)}
    assert "pipeline" in entry.queries() and set(ORACLES) <= set(QUERIES)
