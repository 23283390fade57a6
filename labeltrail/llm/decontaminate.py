"""Benchmark decontamination: test items inside documents of any length.

Containment of an item in a document is the share of the item's distinct five-word shingles that the
document has. The items' MinHash sketches are one-sided: an item keeps its k
smallest shingle hashes, with k one more than the number that may be missing at the threshold. So a
document that contains enough of an item has one of its k smallest hashes at least,
however long the document is, and no pair is lost to chance. Items are partitioned by the size of their
shingle sets, and a document is looked up only in the partitions whose items it is large enough to
contain. Candidates are verified on the shingles themselves.

Documents never move: each block of items, of bounded size, goes to all tasks, and the documents are read
once for a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, ddl, map_arrow, numbered, place, record_batch, slices, table, whole_text
from labeltrail.llm.word_windows import run_hashes, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 16_000_000  # of item text that one pass over the documents looks for
_FILTER_BITS = 20


def words_of(text: str) -> list[str]:
    """Lower-case words, parted by ASCII white space."""
    return [w.decode("utf-8") for w in text.lower().encode("utf-8").split()]


def shingles_of(words: list[str], size: int = SHINGLE) -> set[str]:
    """Distinct runs of ``size`` words; of fewer words the whole sequence."""
    if not words:
        return set()
    size = min(size, len(words))
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def needed(size: int, containment: float) -> int:
    """How many of ``size`` shingles a document needs."""
    return max(1, math.ceil(containment * size - 1e-9))


@dataclass
class Partition:
    """Items whose shingle sets have ``2**j`` to ``2**(j+1) - 1`` members, all of the same shingle length."""

    length: int
    least: int  # shingles a document needs for the smallest item
    hashes: np.ndarray  # all sketches, sorted
    items: np.ndarray  # the item of each hash
    filter: np.ndarray = field(repr=False)  # which low bits occur


class ItemIndex:
    """Sketches of a block of items, partitioned by size, and the items' shingles."""

    def __init__(self, items: list[tuple[int | None, str]], containment: float = CONTAINMENT, shingle: int = SHINGLE):
        self.ids = [i for i, _ in items]
        self.containment = containment
        self.shingles: list[set[str]] = []
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            own = shingles_of(words, shingle)
            self.shingles.append(own)
            if own:
                length = min(shingle, len(words))
                hashes = np.unique(run_hashes(word_hashes(" ".join(words).encode("utf-8")), length))
                sketch = hashes[: len(own) - needed(len(own), containment) + 1]
                groups.setdefault((length, len(own).bit_length()), []).append((k, sketch))
        self.partitions = []
        for (length, _), members in sorted(groups.items()):
            hashes = np.concatenate([h for _, h in members])
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[hashes & np.uint64((1 << _FILTER_BITS) - 1)] = True
            least = min(needed(len(self.shingles[k]), containment) for k, _ in members)
            which = np.repeat([k for k, _ in members], [len(h) for _, h in members])
            self.partitions.append(Partition(length, least, hashes[order], which[order], bits))

    def candidates(self, words: np.ndarray) -> list[int]:
        """Items of which the document, given by its word hashes, has a hash in their sketch."""
        found: set[int] = set()
        runs: dict[int, np.ndarray] = {}
        for p in self.partitions:
            if len(words) - p.length + 1 < p.least:
                continue  # too small for any item of the partition
            if p.length not in runs:
                runs[p.length] = run_hashes(words, p.length)
            own = runs[p.length]
            own = own[p.filter[own & np.uint64((1 << _FILTER_BITS) - 1)]]
            if len(own):
                first, last = np.searchsorted(p.hashes, own, "left"), np.searchsorted(p.hashes, own, "right")
                for a, b in {(a, b) for a, b in zip(first.tolist(), last.tolist()) if b > a}:
                    found.update(p.items[a:b].tolist())
        return sorted(found)

    def contained(self, text: str) -> list[tuple[int, int]]:
        """Items that the text contains, with the number of their shingles in it; exact."""
        lower = text.lower().encode("utf-8")
        near = self.candidates(word_hashes(lower))
        if not near:
            return []
        joined = f" {b' '.join(lower.split()).decode('utf-8')} "
        found = []
        for k in near:
            shared = sum(f" {s} " in joined for s in self.shingles[k])
            if shared >= needed(len(self.shingles[k]), self.containment):
                found.append((k, shared))
        return found


_PAIRS = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64()), ("containment", pa.float64()),
])
_PAIRS_DDL = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"


def _search_part(batches: Batches, items: list[tuple[int | None, str]], containment: float) -> Iterator[pa.RecordBatch]:
    index = ItemIndex(items, containment)
    for batch in slices(batches, 1):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k, shared in index.contained(text):
                size = len(index.shingles[k])
                rows.append((doc, index.ids[k], shared, size, shared / size))
        yield record_batch(_PAIRS, [list(c) for c in zip(*rows)] if rows else [[]] * 5)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """All items in blocks of bounded size; copies of an item once."""
    distinct = items.filter("length(trim(text)) > 0").distinct()
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):
        own = distinct.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _searched(docs: DataFrame, items: DataFrame, containment: float, item_id: str, item_text: str) -> DataFrame:
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), whole_text(item_text).alias("text"))
    found = None
    for block in _blocks(wanted):
        part = map_arrow(docs, _search_part, _PAIRS_DDL, block, containment)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], _PAIRS_DDL)


def find_items(
    docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment`` of each document and item that it contains.

    Null and blank texts and items contain and are contained in nothing; an item shorter than a shingle is one
    shingle. Rows with a null id are searched and reported with it. Repeated documents give repeated rows, repeated items one. Empty tables
    give an empty one; other columns are not looked at.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return _searched(own, items, containment, item_id, item_text)


def _clean_part(batches: Batches, items: list[tuple[int | None, str]], containment: float) -> Iterator[pa.RecordBatch]:
    index = ItemIndex(items, containment)
    for batch in slices(batches):
        clean = [not index.contained(t) for t in batch.column(0).to_pylist()]
        kept = batch.filter(pa.array(clean, pa.bool_()))
        if kept.num_rows:
            yield kept


def remove_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; rows without a text stay."""
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text("text").alias("text"))
    own = numbered(docs)
    found = own.select(whole_text(place(docs, text)).alias("text"), *own.columns)
    for block in _blocks(wanted):
        found = map_arrow(found, _clean_part, ddl(found), block, containment)
    return found.select(*own.columns).toDF(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items that documents contain."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
