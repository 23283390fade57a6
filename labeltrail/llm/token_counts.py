"""Token counts of a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists all pieces of the vocabulary that end at each
character; for each place the best score of a segmentation up to there is kept with its number of
tokens. A later candidate wins only with a higher score, and candidates come in order of their
start, so of equal ones the longest last piece stays, as in the tokenizers library's unigram model.
A character without a piece of its own is unknown at ten below the lowest score; unknown ones count
their bytes if the vocabulary has pieces for bytes, otherwise one for each run.

Spaces become ``▁`` and one is put before the text. If no piece goes on after a
``▁`` that follows something else, and all scores are whole numbers (so their sums are exact), the text
falls into parts that are counted alone, each distinct part once while it is in the cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, Cache, map_arrow, record_batch, slices, table, whole_text

SPACE = "▁"
_UNKNOWN_PENALTY = 10.0
CACHE_PARTS = 300_000
_PARTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class UnigramCounter:
    """``pieces`` to scores; ``byte_fallback`` if unknown characters are written as bytes."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool):
        import ahocorasick

        if not pieces:
            raise ValueError("a vocabulary needs a piece")
        self.matches = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.matches.add_word(p, (len(p), score))
        self.matches.make_automaton()
        self.single = frozenset(p for p in pieces if len(p) == 1)
        self.unknown = min(pieces.values()) - _UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.by_parts = not any(SPACE in p.lstrip(SPACE) for p in pieces) and all(float(s).is_integer() for s in pieces.values())
        self.parts = Cache(lambda part: self.best(SPACE + part), CACHE_PARTS)

    def best(self, text: str) -> tuple[int, float]:
        """Number of tokens and score of the best segmentation of an already marked text."""
        n = len(text)
        scores, counts, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = self.matches.iter(text)
        end, found = next(matches, (n, None))
        single, penalty, by_bytes = self.single, self.unknown, self.byte_fallback
        for at in range(1, n + 1):
            size = 0
            while end == at - 1:
                length, score = found
                score += scores[at - length]
                if size == 0 or score > top or (score == top and length > size):  # noqa: F821
                    top, size = score, length
                end, found = next(matches, (n, None))
            char = text[at - 1]
            if char not in single:
                score = scores[at - 1] + penalty
                if size == 0 or score > top:
                    scores[at], unknown[at] = score, True
                    counts[at] = counts[at - 1] + (len(char.encode("utf-8")) if by_bytes else 0 if unknown[at - 1] else 1)
                    continue
            scores[at], counts[at] = top, counts[at - size] + 1
        return counts[n], scores[n]

    def count(self, text: str) -> tuple[int, float]:
        """Number of tokens and score of a plain text; the empty text has none."""
        if not text:
            return 0, 0.0
        if not self.by_parts:
            return self.best(SPACE + text.replace(" ", SPACE))
        if SPACE in text or "  " in text or text[0] == " ":
            found = list(map(self.best, _PARTS.findall(SPACE + text.replace(" ", SPACE))))
        else:
            found = map(self.parts.__getitem__, text.split(" "))
        counts, scores = zip(*found)
        return sum(counts), float(sum(scores))


def load_pieces(path: str) -> tuple[dict[str, float], bool]:
    """Normal pieces of a sentencepiece model file with their scores, and whether it has pieces for bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in normal}, any(model.is_byte(i) for i in ids)


_counters: dict[str, UnigramCounter] = {}


def _counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter(*load_pieces(path))
    return _counters[path]


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


def _count_part(batches: Batches, path: str) -> Iterator[pa.RecordBatch]:
    count = _counter(path).count
    for batch in slices(batches, 1):
        found = list(map(count, batch.column(1).to_pylist()))
        yield record_batch(_COUNTS, [batch.column(0), [n for n, _ in found], [s for _, s in found]])


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, score`` of each whole text.

    A null or empty text has 0 tokens and score 0. Repeated rows give repeated rows, null ids stay, an empty
    table gives an empty one; other columns are not looked at.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return map_arrow(own, _count_part, "doc_id long, n_tokens long, score double", path)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, by the pieces and scores of a public vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
