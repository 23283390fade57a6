"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives the longest token at each place of
a word. The encoder takes it if it may stand after the token before, otherwise the
next shorter one; if none fits, it goes back one token and marks the place as a
dead end, so each place is left at most once. Two tokens may stand together if the
merges, in their order, would not join anything across the cut between them. That
gives the tokens of the merge procedure in time linear in the word. Every token of the
vocabulary has one merge that makes it, which is checked on loading.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, Cache, ddl, list_array, map_arrow, numbered, place, slices, table, whole_text

CACHE_WORDS = 200_000
_DECODED_ROWS = 500
#: Strings that stand for bytes in byte-level vocabularies: printable Latin-1 is kept, the others follow from 256 on.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _KEPT)}
_END = "￿"  # marks the end of a word inside token strings; it is no byte's character
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split(), but not to the tokenizer
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")


class BacktrackingBpe:
    """Tokens of single words, as the merge list gives them.

    Inside, a token is its place in merge order: base symbols first, then each merge's result.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        import ahocorasick

        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        # a merged token drops the left part's suffix; only a right part can carry one
        made = [a + b for a, b in pairs]
        if len(set(made)) != len(made):
            raise ValueError("a token has two merges; backtracking needs one")
        base = sorted(set(vocab) - set(made), key=vocab.__getitem__)
        names = base + made
        order = {n: i for i, n in enumerate(names)}
        self.ids = [np.int32(vocab[n]).tobytes() for n in names]
        self.first_merge = len(base)
        parts = [(order[a], order[b]) for a, b in pairs]
        self.left = [*range(len(base)), *[a for a, _ in parts]]
        self.right = [*range(len(base)), *[b for _, b in parts]]
        self.joined = {p: len(base) + r for r, p in enumerate(parts)}
        self.suffix = suffix
        inner = [n[: -len(suffix)] + _END if suffix and n.endswith(suffix) else n for n in names]
        self.length = [len(n) for n in inner]
        self.matches = ahocorasick.Automaton()
        for i, n in enumerate(inner):
            self.matches.add_word(n, (i, len(n) - 1))
        self.matches.make_automaton()
        at = {n: i for i, n in enumerate(inner)}
        self.shorter = [next((at[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in at), -1) for n in inner]
        self.fits = Cache(self._fits, 500_000)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether no merge joins the two tokens, or parts of them at the cut, before both are made.

        Both are taken apart again, last merge first; ``before`` is the merge that took
        place next on the way to the tokens, and a merge across the cut wins if it comes earlier.
        """
        a, b = pair
        before = len(self.left)
        while True:
            if self.joined.get((a, b), before) < before:
                return False
            whole_a, whole_b = a < self.first_merge, b < self.first_merge
            if whole_a and whole_b:
                return True
            if whole_b or (not whole_a and a > b):
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]  # equal merges: the one further left goes first

    def __call__(self, word: str) -> bytes:
        """Packed vocabulary ids of a word of byte characters."""
        if self.suffix:
            word += _END
        n = len(word)
        longest = [-1] * (n + 1)
        length, shorter, fits = self.length, self.shorter, self.fits
        for end, (token, back) in self.matches.iter(word):  # by rising end: the last of a start is the longest
            longest[end - back] = token
        token = longest[0]
        if token >= 0 and length[token] == n:
            return self.ids[token]
        open_at = [True] * (n + 1)
        found: list[int] = []
        at = 0
        while at < n:
            while token >= 0:
                end = at + length[token]
                if open_at[end] and (not found or fits[found[-1], token]):
                    break
                token = shorter[token]
            if token >= 0:
                found.append(token)
                at = end
                token = longest[at]
            elif found:
                open_at[at] = False
                token = found.pop()
                at -= length[token]
            else:
                raise ValueError(f"{word!r} has a symbol that is not in the vocabulary")
        return b"".join([self.ids[t] for t in found])


class BpeCodec:
    """Encoder and decoder of a tokenizers file: clean-up, split into words, byte-level BPE.

    Takes files with these parts, all others raise: a normalizer of NFC, white space to one
    space and lower case; a pre-tokenizer of one pattern whose matches stay, then byte level;
    BPE without dropout; no post-processor, no decoder. Truncation and padding are not used.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split, level = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        model = spec["model"]
        fine = (
            steps == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
            and spec["normalizer"]["normalizers"][1]["content"] == " " and split["behavior"] == "Removed" and split["invert"]
            and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
            and model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"]
            and not model["byte_fallback"] and not model["ignore_merges"] and spec["decoder"] is None
            and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        )
        if not fine:
            raise ValueError(f"{path}: a kind of tokenizer that is not read here")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {c: np.int32(i).tobytes() for c, i in added.items()}
        # all added tokens have a length of their own order: the leftmost, then longest, is taken
        self.cuts = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.bpe = BacktrackingBpe(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.words = Cache(self._word, CACHE_WORDS)
        names = model["vocab"] | added
        by_id = {i: n for n, i in names.items()}
        self.known = np.array([i in by_id for i in range(max(by_id) + 1)])
        #: The offset table: all token strings in one buffer, and where each id's begins.
        self.strings = pa.array([by_id.get(i, "") for i in range(max(by_id) + 1)], pa.string())

    def _word(self, chunk: str) -> bytes:
        chars = _BYTE_CHARS
        return b"".join([self.bpe("".join([chars[b] for b in p.encode("utf-8")])) for p in self.pieces(chunk)])

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case goes by single characters
        text = text.lower()
        chunks = [c for c in _SPACES.split(text) if c] if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if not self.added or not self.cuts.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.cuts.finditer(text):
            out += [self._plain(text[at : found.start()]), self.added[found[0]]]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token strings of each list joined by one space; ids outside the table and nulls are left out."""
        offsets = np.asarray(ids.offsets).astype(np.int64)
        flat = ids.values.slice(offsets[0], offsets[-1] - offsets[0])
        valid = np.asarray(pc.is_valid(flat))
        values = np.asarray(pc.fill_null(flat, -1)).astype(np.int64)
        fine = valid & (values >= 0) & (values < len(self.known))
        fine[fine] = self.known[values[fine]]
        places = np.append(0, np.cumsum(fine))[offsets - offsets[0]]
        strings = self.strings.take(pa.array(values[fine]))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), strings), " ")


_codecs: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """The codec of a file, loaded once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = BpeCodec(path)
    return _codecs[path]


def _with_columns(batch: pa.RecordBatch, *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "out", "text_out"][: len(columns) + len(batch.columns) - 1])


def _encode_part(batches: Batches, path: str) -> Iterator[pa.RecordBatch]:
    encode = codec(path).encode
    for batch in slices(batches):
        yield _with_columns(batch, list_array(list(map(encode, batch.column(0).to_pylist()))))


def _encode_decode_part(batches: Batches, path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches):
        ids = list_array(list(map(own.encode, batch.column(0).to_pylist())))
        yield _with_columns(batch, ids, own.decode(ids))


def _decode_part(batches: Batches, path: str) -> Iterator[pa.RecordBatch]:
    decode = codec(path).decode
    for batch in batches:
        for first in range(0, batch.num_rows, _DECODED_ROWS):
            part = batch.slice(first, _DECODED_ROWS)
            ids = pc.fill_null(part.column(0), pa.scalar([], part.column(0).type))
            yield _with_columns(part, decode(ids))


def _mapped(df: DataFrame, task, source: Callable[[str], Column], column: str, kind: str, path: str, *out: str) -> DataFrame:
    if set(out) & set(df.columns):
        raise ValueError(f"there is a column {' or '.join(out)} already; name the new one with out=")
    own = numbered(df)
    found = map_arrow(own.select(source(place(df, column)).alias("in"), *own.columns), task, f"{ddl(own)}, out {kind}", path)
    return found.toDF(*df.columns, *out)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text in ``out``; a null or empty text has none.

    Other columns stay, whatever their names; a column named ``out`` already raises.
    Rows stay rows: copies and empty tables need nothing special.
    """
    return _mapped(df, _encode_part, whole_text, text, "array<int>", path, out)


def encode_decode(df: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one Python worker, which holds the vocabulary once."""
    return _mapped(df, _encode_decode_part, whole_text, text, "array<int>, text_out string", path, out, decoded)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list in ``out``: token strings joined by one space, special ones too.

    A null or empty list gives the empty text; null and unknown ids in a list are left out.
    """
    return _mapped(df, _decode_part, lambda c: F.col(c).cast("array<int>"), ids, "string", path, out)


def digest(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and reduce both to ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return encode_decode(own, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with a word-end BPE vocabulary and decoded again."""
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
