"""Operators that work row by row, against one-by-one versions."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures_llm import awkward, awkward_rows, empty, prose, rows_of
from tokenizers import Tokenizer, models, normalizers

from labeltrail.llm import bpe_codec, html_text, language_id, secret_scan, token_counts, token_files
from labeltrail.scratch import new_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _strange(rng: random.Random) -> str:
    return "".join(rng.choice("ab the éЖ漢😀́'s're12 \n\t\x1c\x85\xa0İΣς<|endofTEXT|>▁,.") for _ in range(rng.randint(0, 90)))


# --- BPE ---


def test_bpe_equals_the_library():
    rng = random.Random(1)
    library, own = Tokenizer.from_file(WORD_BPE), bpe_codec.BpeCodec(WORD_BPE)
    texts = [_strange(rng) for _ in range(300)] + [t or "" for _, t, *_ in awkward_rows()] + ["aaaa" * 300, "a<|endoftext|>B", "ΑΣ ΟΔΟΣ"]
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<i4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
    packed = [own.encode(t) for t in texts]
    decoded = own.decode(bpe_codec.list_array(packed)).to_pylist()
    assert decoded == [library.decode(np.frombuffer(p, "<i4").tolist(), skip_special_tokens=False) for p in packed]


def test_bpe_random_merges_equal_the_procedure():
    rng = random.Random(4)
    for _ in range(30):
        names, merges = list("abc"), []
        while len(merges) < 12:
            a, b = rng.choice(names), rng.choice(names)
            if a + b not in names and len(a + b) < 7:
                merges.append((a, b))
                names.append(a + b)
        # only tokens that the merges give for their own string can be found by looking tokens up
        ranks = {m: i for i, m in enumerate(merges)}

        def merged(word):
            parts = list(word)
            while True:
                ranked = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
                if not ranked:
                    return parts
                rank, _ = min(ranked)
                out, i = [], 0
                while i < len(parts):
                    if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == rank:
                        out.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out

        if any(merged(n) != [n] for n in names):
            continue
        codec = bpe_codec.BacktrackingBpe({n: i for i, n in enumerate(names)}, merges)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
            assert [names[i] for i in np.frombuffer(codec(word), "<i4")] == merged(word)


def test_bpe_columns(spark):
    library = Tokenizer.from_file(WORD_BPE)
    want = []
    for doc, text, *_ in awkward_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    got = rows_of(bpe_codec.digest(awkward(spark), WORD_BPE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert bpe_codec.digest(empty(spark), WORD_BPE).count() == 0
    with pytest.raises(ValueError):
        bpe_codec.encode(awkward(spark), WORD_BPE)  # there is a column ids already
    ids = spark.createDataFrame([(1, [320, None, 10**6, -5]), (2, None), (3, [])], "k int, ids array<int>")
    assert rows_of(bpe_codec.decode(ids, WORD_BPE), "k", "decoded") == [(1, library.id_to_token(320)), (2, ""), (3, "")]


# --- token files ---


def test_packing_gives_back_what_was_packed():
    rng = np.random.default_rng(3)
    blocks = [
        np.full(128, 7), np.arange(128), rng.integers(0, 2**32, 128), np.append(np.zeros(127), 2**32 - 1), rng.integers(5, 9, 128),
        np.where(rng.random(128) < 0.05, 50_000, rng.integers(100, 130, 128)),
    ]
    ids = np.concatenate(blocks).astype(np.uint32)
    body, sizes = token_files.pack(ids)
    assert sizes.sum() == len(body)
    starts = np.cumsum(sizes) - sizes
    assert (token_files.unpack(body, starts) == ids).all()
    assert (token_files.unpack(body, starts[2:4]) == ids[256:512]).all()


def test_file_reads_any_document(tmp_path):
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 5, 128, 1, 3000, 0, 127)]
    writer = token_files.FileWriter(str(tmp_path / "x.ids"))
    writer.add([1, None, 3], [d.tobytes() for d in docs[:3]])
    writer.add([4, 5, 6, 7], [d.tobytes() for d in docs[3:]])
    writer.close()
    reader = token_files.FileReader(str(tmp_path / "x.ids"))
    assert reader.docs == [1, None, 3, 4, 5, 6, 7]
    for k, d in enumerate(docs):
        assert (reader.document(k) == d).all()
    assert [(a, i.tolist()) for _, a, i in reader] == [(int(a), d.tolist()) for a, d in zip(np.cumsum([0, *map(len, docs[:-1])]), docs)]


def test_token_files(spark):
    library, want, start = Tokenizer.from_file(BYTE_BPE), [], 0
    rng = random.Random(2)
    rows = awkward_rows() + [(100 + i, _strange(rng), None, None, None) for i in range(200)] + [(400, "a  b   c \n\n d,'s it's 12.5e", None, None, None)]
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = token_files.write_tokens(awkward(spark, rows), new_path(spark, "t"), BYTE_BPE, 2)
    got = sorted((tuple(r) for r in token_files.token_digest(manifest).collect()), key=lambda r: r[1])
    assert got == want
    read = sorted((tuple(r) for r in token_files.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert [(d, a, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, a, i in read] == want
    none = token_files.write_tokens(empty(spark), new_path(spark, "t"), BYTE_BPE, 2)
    assert token_files.token_digest(none).count() == 0


# --- token counts ---


def test_counts_equal_the_library_with_ties():
    rng = random.Random(9)
    for _ in range(150):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))): rng.choice([-1.0, -2.0, -3.0, -1.5]) for _ in range(12)}
        library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False))
        library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        text = "".join(rng.choice("abc dd") for _ in range(40))
        assert token_counts.UnigramCounter(pieces, False).count(text)[0] == len(library.encode(text).ids)


def test_counts_of_a_public_vocabulary(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    library = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    rows = [r for r in awkward_rows() if len(r[1] or "") < 30_000]
    rng = random.Random(3)
    rows += [(500 + i, re.sub("[<>]", "", _strange(rng)), None, None, None) for i in range(100)]
    want = [(d, len(library.encode(t).ids) if t else 0) for d, t, *_ in rows]
    got = rows_of(token_counts.count_tokens(awkward(spark, rows), path), "doc_id", "n_tokens")
    assert got == sorted(want, key=lambda r: (r[0] is not None, r))
    assert token_counts.count_tokens(empty(spark), path).count() == 0


# --- language ---


def test_language_is_learnt_and_told(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 80, lang), lang, None, None) for i in range(160) for lang in [("en", "de")[i % 2]]]
    net = language_id.fit(awkward(spark, rows[:100]), docs_per_language=40)
    assert net.languages == ["de", "en"]
    test = awkward(spark, rows[100:] + [(900, None, "en", None, None), (901, "", "en", None, None), (902, "12 !?", "en", None, None), (None, rows[0][1], None, None, None)])
    got = {r["doc_id"]: r for r in language_id.predict(test, net, ["doc_id", "lang", "key"]).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in rows[100:])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[None]["lang_pred"] == "en"
    assert language_id.predict(empty(spark), net, ["doc_id"]).count() == 0


def test_language_without_labels_or_with_one(spark):
    none = language_id.fit(awkward(spark, [(1, "some text", None, None, None)]))
    assert rows_of(language_id.predict(awkward(spark), none, []), "lang_pred") == [("und",)] * len(awkward_rows())
    one = language_id.fit(awkward(spark, [(1, "some text", "en", None, None)]))
    assert rows_of(language_id.predict(awkward(spark, [(1, "text", None, None, None)]), one, []), "lang_pred", "score") == [("en", 1.0)]


def test_texts_with_letters_stay_if_nothing_was_learnt(spark):
    docs = awkward(spark, [(1, "some text", None, None, None), (2, "12 34", None, None, None), (3, None, None, None, None), (None, "é", None, None, None)])
    none = language_id.fit(docs)
    kept = language_id.keep_known(docs, none)
    assert none.languages == [] and kept.columns == docs.columns and rows_of(kept, "doc_id") == [(None,), (1,)]


def test_the_answer_fills_and_rejects(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, 60, lang), lang if k % 4 else None, "s", 1) for k, lang in enumerate(["en", "de"] * 40)]
    docs = awkward(spark, rows + [(200, "12 34", None, "s", 1), (201, None, "en", "s", 1)])
    net = language_id.fit(docs)
    kept = language_id.keep_known(docs, net)
    assert kept.columns == docs.columns and kept.count() == 80
    told = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert all(told[k] == lang for k, lang in enumerate(["en", "de"] * 40))
    assert {r["lang"] for r in language_id.keep_known(docs, net, languages=("de",)).collect()} == {"de"}
    assert language_id.keep_known(docs, net, least_score=1.01).count() == 0


def test_the_most_frequent_languages_are_learnt(spark):
    rows = [(k, f"text of {'abc'[k % 3] * 9}", ["x", "y", "z"][min(2, k // 8)], "s", 1) for k in range(20)]
    assert language_id.fit(awkward(spark, rows), most_languages=2).languages == ["x", "y"]


def test_held_out_accuracy_of_each_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(docs.filter(~language_id.is_held_out()))
    found = language_id.predict(docs.filter(language_id.is_held_out()), net, ["lang"]).filter("lang is not null and lang_pred <> 'und'")
    right = {r["lang"]: (r["n"], r["ok"]) for r in found.selectExpr("lang", "lang = lang_pred AS ok").groupBy("lang").agg({"*": "count", "ok": "count_if"}).toDF("lang", "n", "ok").collect()}
    assert len(right) == 4 and all(ok >= 0.95 * n for n, ok in right.values()), right


def test_held_out_is_by_crc(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").withColumn("h", language_id.is_held_out())
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in df.collect())


def test_network_answers_equal_plain_convolution():
    rng = np.random.default_rng(0)
    net = language_id.train([bytes(rng.integers(97, 110, 200).tolist()) for _ in range(40)], ["a", "b"] * 20, epochs=1)
    data = np.frombuffer(b"some Text 12", np.uint8)
    codes = language_id.window_codes(data, np.array([0]), np.array([len(data)]))
    for width, got in zip(language_id.WIDTHS, net.answers(codes, net.tables())):
        for at in range(5):
            plain = sum(net.filters[width][i][codes[0, at + i]] for i in range(width))
            assert np.allclose(got[0, at], plain, atol=1e-5)


# --- secrets ---

_BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]+"), 24),
)


def _base(text):
    found = []
    for order, (kind, pattern, least) in enumerate(_BASE):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if len(m[m.lastindex or 0]) >= least]
    return sorted(found)


def test_secret_base_equals_the_patterns(spark):
    texts = ["secret=token=abcdefgh", "Api_Key: 'abc-def' deadbeef" * 4, "AKIA" * 9 + " AKIAx", "é password = \"abcdef\"", "toKen=ab"]
    rows = awkward_rows() + [(700 + i, t, None, None, None) for i, t in enumerate(texts)]
    want = []
    for doc, text, *_ in rows:
        base = _base(text or "")
        kinds = [k for _, _, k, _ in base]
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base).encode()).hexdigest()
        want.append((doc, *(kinds.count(k) for k, _, _ in _BASE), digest))
    found = secret_scan.scan(awkward(spark, rows))
    got = rows_of(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert secret_scan.scan(empty(spark)).count() == 0


@pytest.mark.parametrize(("text", "values"), [
    ('K = "hT9xkQ2mfe81"\ndb_password = K\n', ["hT9xkQ2mfe81"]),
    ('auth.password: str = "a8Kd02kfj1"', ["a8Kd02kfj1"]),
    ('cfg["api_key"] = "Zk29xx" + "fj20Kdj"', ["Zk29xx", "fj20Kdj"]),
    ('connect(user="bob77x", pwd="s3cr3tP4ss!")', ["s3cr3tP4ss!"]),
    ("export DB_PASS=Xy12!kkq9\n", ["Xy12!kkq9"]),
    ("a = b\nb = a\npassword = a", []),
    ('token_count = 1234567', []), ('password = "changeme"', []), ("The secret: the words of it.", []), ('name = "hT9xkQ2mfe81"', []),
])
def test_secret_assignments(text, values):
    assert [text[s:e] for s, _, e, _ in secret_scan.lexed_spans(text)] == values


@pytest.mark.parametrize(("text", "values"), [
    ('{"client_secret":\n  "Xy7kQ92mZ",\n "user": "bob77x"}', ["Xy7kQ92mZ"]), ('pwd =\n  "Xy7kQ92mZ"', ["Xy7kQ92mZ"]),
    ('pwd = """Xy7kQ92mZ"""', ["Xy7kQ92mZ"]),
    ("pwd = \'\'\'\nXy7kQ92mZ\n\'\'\'\nname = 1", ["Xy7kQ92mZ"]), ("pwd: |\n  Xy7kQ92mZ\nname: x", ["Xy7kQ92mZ"]), ("a:\n  pwd: >-\n    Xy7kQ92mZ\n  b: c", ["Xy7kQ92mZ"]),
    ("pwd:\n  Xy7kQ92mZ\n", ["Xy7kQ92mZ"]), ("pwds:\n  pwd:\n  - Xy7kQ92mZ\n  - 'Zz81kQ92mZ'\n", ["Xy7kQ92mZ", "Zz81kQ92mZ"]),
    *[(f'pwd = {p}"Xy7kQ92mZ"', ["Xy7kQ92mZ"]) for p in ("b", "f", "r", "u", "Rb")], ('pwd = b"Xy7kQ" + b"92mZa"', ["Xy7kQ", "92mZa"]),
    ('pwd = ("Xy7kQ92mZ")', ["Xy7kQ92mZ"]), ('pwd = (\n  "Xy7kQ"\n  b"92mZ"\n)', ["Xy7kQ", "92mZ"]), ('passphrase = ["Xy7kQ92mZ", "Zz81kQ92mZ"]', ["Xy7kQ92mZ", "Zz81kQ92mZ"]),
    ('pwd = "Xy7kQ" +\n  "92mZ"', ["Xy7kQ", "92mZ"]), ("pwd = `\nXy7kQ92mZ\n`", ["Xy7kQ92mZ"]),
    ('pwds = ["Xy7kQ92mZ"]', ["Xy7kQ92mZ"]),
    ('credentials = {"name": "bob77xQ9"}', []), ("PWD=\nDB_HOST=foo12Qx\n", []), ("pwd:\nuser: bob77xQ9\n", []), ('pwd = f"{VAULT_2}"', []),
])
def test_secret_values_of_other_forms(text, values):
    assert [text[s:e] for s, _, e, _ in secret_scan.lexed_spans(text)] == values


@pytest.mark.parametrize("text, values", [
    ('pwd = x or "Xy7kQ92mZ"', ["Xy7kQ92mZ"]), ('pwd = process.env.DB || "Xy7kQ92mZ"', ["Xy7kQ92mZ"]), ('pwd = a if b else "Xy7kQ92mZ"', ["Xy7kQ92mZ"]),
    ('pwd = b ? "Xy7kQ92mZ" : c', ["Xy7kQ92mZ"]), ('pwd = getenv("DB_PASSWORD", "Xy7kQ92mZ")', ["Xy7kQ92mZ"]), ('conf.set("pwd", "Xy7kQ92mZ")', ["Xy7kQ92mZ"]),
    ('pwd = new String("Xy7kQ92mZ")', ["Xy7kQ92mZ"]), ('pwd += "Xy7kQ92mZ"', ["Xy7kQ92mZ"]), ('pwd ||= "Xy7kQ92mZ"', ["Xy7kQ92mZ"]), ("pwd ?= Xy7kQ92mZ", ["Xy7kQ92mZ"]),
    ('pwd = "Xy7k" "Q92mZ1"', ["Xy7k", "Q92mZ1"]), ("<password>Xy7kQ92mZ</password>", ["Xy7kQ92mZ"]), ('pwd = getenv("DB_PASSWORD")', []),
    ('pwd = os.environ["DB_PASSWORD"]', []), ('pwd = a == "hT9xkQ2mfe81" or b', []), ('conf.set("name", "Xy7kQ92mZ")', []),
    ('- token:\n- other: "Xy7kQ92mZ"', []), ('a = b + "Xy7k"\nb = a + "Q92mZ1"\npwd = b', ["Xy7k", "Q92mZ1"]),
])
def test_secret_values_of_expressions(text, values):
    assert [text[s:e] for s, _, e, _ in secret_scan.lexed_spans(text)] == values


def test_secret_values_of_very_many_literals():
    """More literals than are joined: each one behind a name counts, at its own place and through other names."""
    listed = "pwds = [" + ", ".join(f'"Xy7kQ{k:03d}mZ"' for k in range(100)) + "]\n"
    assert len(secret_scan.lexed_spans(listed)) == 100
    words = "".join(f'p{k} = "word {k}"\n' for k in range(70))
    joined = words + 'last = "Xy7kQ92mZ"\nall = ' + " + ".join(f"p{k}" for k in range(70)) + " + last\nalias = all\npwd = alias\n"
    assert [joined[s:e] for s, _, e, _ in secret_scan.lexed_spans(joined)] == ["Xy7kQ92mZ"]
    assert secret_scan.lexed_spans(joined.replace("pwd = ", "name = ")) == []


def test_secrets_of_many_names_for_one_list_take_linear_time():
    text = "a = [" + ", ".join(f'"Xy7k{k}"' for k in range(20_000)) + "]\n" + "".join(f"token{k} = a\n" for k in range(100_000))
    start = time.perf_counter()
    assert len(secret_scan.lexed_spans(text)) == 20_000
    assert time.perf_counter() - start < 30


@pytest.mark.parametrize("lines", [
    "token = token\n", "token = name\nname = token\n", 'token = token + "Xy7k1"\n', '"token": "Xy7kQ92mZ", ', "a = [", "- token:\n", 'token = "\n',
    "token = '''\n", "token = f(", '{"token": ', "token = (x = (", "token = x or ", 'set("token", ', "<token>", "token:\n  - a\n",
])
def test_secret_scan_is_linear(lines):
    """2 MB of lines that refer to each other, stay open or nest."""
    start = time.perf_counter()
    secret_scan.spans_of(lines * (2_000_000 // len(lines)))
    assert time.perf_counter() - start < 30


def test_redaction_keeps_rows_and_columns(spark):
    df = awkward(spark)
    found = secret_scan.redact(df)
    assert found.columns == df.columns and found.count() == df.count()
    row = found.filter("doc_id = 15").first()
    assert row["text"] == "Password: [secret] and [secret]" and row["n_chars"] == len(row["text"])
    assert found.filter("text is null").count() == 1
    assert rows_of(found.filter("doc_id <> 15"), "doc_id", "text") == rows_of(df.filter("doc_id <> 15"), "doc_id", "text")


# --- pages ---

_PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav>'
    '<div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p><b>Open bold<br>\n next  words.<p>Second.</p>'
    '<aside>Side</aside><form>Mail <input></form><ul><li>one</li><li>t&auml;</li></ul><div class="comments"><p>First!</p></div></article><footer>&copy; x</footer></body></html>'
)


@pytest.mark.parametrize(("html", "text"), [
    (_PAGE, "Head & line\nOpen bold next words.\nSecond.\none\ntä"),
    ("", ""), ("<p>only", "only"), ("plain &amp text", "plain & text"), ("<nav>x</nav>", ""), ("<script>x", ""),
    ("<div><h1>A</h1><div><p>" + "long text " * 30 + "</p><p>short</p></div></div><div class='cookie-notice'>We use cookies</div>", "A\n" + ("long text " * 30).strip() + "\nshort"),
    ("</div></p>stray<p>x", "stray\nx"),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


_BODY = " ".join(["Plain words of the article."] * 20)


@pytest.mark.parametrize(("html", "text"), [
    *[(f"<body><nav>Home</nav><div class='{c}'><article><p>{_BODY}</p></article></div></body>", _BODY)
      for c in ("layout has-sidebar", "no-sidebar", "with-comments", "ad-free")],
    (f"<form id='aspnetForm'><div><p>{_BODY}</p></div></form>", _BODY),
    (f"<form id='aspnetForm'><main><p>{_BODY}</p><form><p>Mail</p></form></main></form>", f"{_BODY}"),
    (f"<article><h2 id='related-work'>Related</h2><p>{_BODY}</p><h3 id='search'>Search</h3><p>{_BODY}</p></article>", f"Related\n{_BODY}\nSearch\n{_BODY}"),
    (f"<div class='notice'><p>{_BODY}</p><p>{_BODY}</p></div>", f"{_BODY}\n{_BODY}"),
    (f"<article><p>{_BODY}</p><p class='notice-period'>Three months.</p><p class='notice'>Cookies</p></article>", f"{_BODY}\nThree months."),
    (f"<article><p>{_BODY}</p><div class='share'>Share it</div></article><div class='sidebar'><p>Other</p></div>", _BODY),
])
def test_names_of_boilerplate_spare_content(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(("html", "text"), [
    (f"<body><nav>Home</nav><main><h1>Headline</h1><p>Lead</p><article><p>{_BODY}</p></article></main><p>Imprint</p></body>", f"Headline\nLead\n{_BODY}"),
    (f"<main><article><p>{_BODY} {_BODY}</p></article><article><p>Second. {_BODY}</p></article></main>", f"{_BODY} {_BODY}\nSecond. {_BODY}"),
    (f"<body><div><article><p>{_BODY} {_BODY}</p></article><article><p>Second. {_BODY}</p></article></div><div>Imprint</div></body>", f"{_BODY} {_BODY}\nSecond. {_BODY}"),
])
def test_articles_keep_headings_and_siblings(html, text):
    assert html_text.main_text(html) == text


def test_pages(spark):
    ddl = "page_id long, url string, html string, text string"
    rows = [(1, "u", _PAGE, "x"), (1, "u", _PAGE, "x"), (2, None, None, "y"), (None, "v", "<p>" + "w " * 40_000, "z")]
    found = html_text.extract(spark.createDataFrame(rows, ddl))
    want = [(p, u, html_text.main_text(h or ""), len(html_text.main_text(h or ""))) for p, u, h, _ in rows]
    assert rows_of(found, "page_id", "url", "text", "n_chars") == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert html_text.extract(spark.createDataFrame([], ddl)).count() == 0


def test_ratio_threshold():
    ratios = np.array([1, 2, 1, 90, 120, 3, 80, 95, 1, 1.0])
    assert html_text.content_lines(ratios)[3:8].all() and not html_text.content_lines(ratios)[[0, 9]].any()
    assert html_text.content_lines(np.array([5.0, 5.0])).all() and html_text.content_lines(np.array([])).shape == (0,)
