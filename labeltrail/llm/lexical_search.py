"""Ranked lexical search, with the index partitioned by term and the queries in a pipeline.

The index holds, per block of documents, the posting list of each term. Terms belong to four owners by how common
they are. Items (the queries) travel in bundles: for each block of documents a bundle carries sparse accumulators,
(item, document, score so far), and passes the owners one after the other, the one of the rarest terms first. At an
owner, bundle and posting lists meet by cogroup, and integer contributions are added. The last owner selects.

A bundle drops an accumulator only where its score and all that later owners could add stay below the score that
20 documents already have, so the result is exact.
"""

from __future__ import annotations

import importlib
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labeltrail.llm.common import _ROOT, Batches, list_array, map_arrow, record_batch, slices, table, whole_text
from labeltrail.operators.position import with_position
from labeltrail.scratch import cut

TOP = 20
BLOCK_BYTES = 8_000_000
BLOCK_DOCS = 4_096
BUNDLE = 256  # items
OWNERS = (256, 32, 4)  # the first owner has terms in at most 1/256 of the documents; a last one has the rest
SALTS = 64

# Digits and letters stay, A-Z lower-cased; all other ASCII characters part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(_FOLD).split()


# --- index ----------------------------------------------------------------------------

_INDEX = pa.schema([
    ("block", pa.int64()), ("term", pa.string()), ("slots", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())),
    ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
])
_INDEX_DDL = "block long, term string, slots array<int>, tf array<int>, ids array<long>, lengths array<long>"
_ROWS = 4_096  # posting lists in a batch


def _block(number: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """One row for the documents of a block, without a term, and one for each posting list."""
    vocabulary: dict[bytes, int] = {}
    terms, slots, freqs, lengths = [], [], [], []
    for slot, text in enumerate(batch.column(1).to_pylist()):
        words = terms_of(text)
        lengths.append(len(words))
        found = Counter(words)
        terms.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), np.int32, len(found)))
        freqs.append(np.fromiter(found.values(), np.int32, len(found)))
        slots.append(np.full(len(found), slot, np.int32))
    none = pa.array([None], pa.list_(pa.int32()))
    yield record_batch(_INDEX, [
        [number], [None], none, none, pa.ListArray.from_arrays([0, batch.num_rows], batch.column(0)), [lengths],
    ])
    term, slot, tf = (np.concatenate(x) for x in (terms, slots, freqs))
    order = np.argsort(term, kind="stable")
    slot, tf = slot[order], tf[order]
    offsets = np.append(0, np.cumsum(np.bincount(term, minlength=len(vocabulary)))).astype(np.int32)
    names = list(vocabulary)
    for a in range(0, len(names), _ROWS):
        b = min(len(names), a + _ROWS)
        lists = [pa.ListArray.from_arrays(pa.array(offsets[a : b + 1] - offsets[a]), pa.array(x[offsets[a] : offsets[b]])) for x in (slot, tf)]
        nulls = pa.nulls(b - a, pa.list_(pa.int64()))
        yield record_batch(_INDEX, [[number] * (b - a), pa.array(names[a:b], pa.binary()).cast(pa.string()), *lists, nulls, nulls])


def _index_part(batches: Batches, block_bytes: int, block_docs: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for part in slices(batches, 1, block_bytes):
        for at in range(0, part.num_rows, block_docs):
            yield from _block(number, part.slice(at, block_docs))
            number += 1


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Posting lists ``block, term, slots, tf``, and per block ``ids, lengths`` of its documents (no term).

    Writes a table: which documents share a block depends on how they were read.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    return cut(map_arrow(own, _index_part, _INDEX_DDL, block_bytes, block_docs), "index")


# --- items ----------------------------------------------------------------------------

_ASKED = pa.schema([("bundle", pa.int32()), ("slot", pa.int32()), ("term", pa.string()), ("qtf", pa.int64())])


def _asked_part(batches: Batches, bundle: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        rows = [
            (at // bundle, at % bundle, term, n)
            for at, text in zip(*(c.to_pylist() for c in batch.columns)) for term, n in Counter(terms_of(text)).items()
        ]
        bundles, slots, terms, counts = zip(*rows) if rows else [()] * 4
        yield record_batch(_ASKED, [list(bundles), list(slots), pa.array(terms, pa.binary()).cast(pa.string()), list(counts)])


# --- the pipeline -----------------------------------------------------------------------

_CARRIED = pa.schema([
    ("bundle", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("items", pa.list_(pa.int32())), ("slots", pa.list_(pa.int32())), ("scores", pa.list_(pa.int64())),
    ("top_items", pa.list_(pa.int32())), ("top_scores", pa.list_(pa.int64())),
])
_CARRIED_DDL = "bundle int, block long, ids array<long>, lengths array<long>, items array<int>, slots array<int>, scores array<long>, top_items array<int>, top_scores array<long>"
_HITS = pa.schema([("at", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_HITS_DDL = "at long, doc_id long, score long"


def _numbers(column: pa.ChunkedArray, row: int = 0) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _add(left: pa.Table, right: pa.Table, n_docs: int, n_terms: int) -> np.ndarray:
    """Scores of all items of a bundle (rows) for all documents of a block (columns), with the owner's part added."""
    lengths = _numbers(left["lengths"])
    m = 100 - 25 + (25 * lengths * n_docs) // max(1, n_terms)
    scores = np.zeros((len(_numbers(left["floors"])), len(lengths)), np.int64)
    scores[_numbers(left["items"]), _numbers(left["slots"])] = _numbers(left["scores"])
    for k in range(right.num_rows):
        slots, tf = _numbers(right["slots"], k), _numbers(right["tf"], k).astype(np.int64)
        users = right["users"][k].values
        each = right["w"][k].as_py() * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[slots]))
        scores[users.field("slot").to_numpy()[:, None], slots[None, :]] += users.field("qtf").to_numpy()[:, None] * each[None, :]
    return scores


def _leading(scores: np.ndarray, top: int) -> np.ndarray:
    """Which scores above 0 are among the ``top`` of their row, ties at the end included."""
    if scores.shape[1] > top:
        least = np.partition(scores, -top, axis=1)[:, -top]
        return (scores >= least[:, None]) & (scores > 0)
    return scores > 0


def _carry(left: pa.Table, right: pa.Table, n_docs: int, n_terms: int, top: int) -> pa.Table:
    scores = _add(left, right, n_docs, n_terms)
    leading = _leading(scores, top)
    floors = np.maximum(_numbers(left["floors"]), np.where((scores > 0).sum(axis=1) >= top, np.where(leading, scores, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max), 0))
    items, slots = np.nonzero((scores > 0) & (scores + _numbers(left["rest"])[:, None] >= floors[:, None]))
    top_items, top_slots = np.nonzero(leading)
    lists = [items.astype(np.int32), slots.astype(np.int32), scores[items, slots], top_items.astype(np.int32), scores[top_items, top_slots]]
    arrays = [pa.array([x.tolist()] if not len(x) else [x], f.type) for x, f in zip(lists, list(_CARRIED)[4:])]
    kept = [left[c].combine_chunks() for c in ("bundle", "block", "ids", "lengths")]
    return pa.table([*kept, *arrays], schema=_CARRIED)


def _select(left: pa.Table, right: pa.Table, n_docs: int, n_terms: int, top: int, bundle: int) -> pa.Table:
    """The best documents of a block for each item; equal scores by id, null ids last."""
    scores = _add(left, right, n_docs, n_terms)
    items, slots = np.nonzero(_leading(scores, top))
    ids = left["ids"][0].values.take(pa.array(slots))
    order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), -scores[items, slots], items))
    items, slots = items[order], slots[order]
    first = np.searchsorted(items, np.arange(len(scores)))
    keep = np.arange(len(items)) - first[items] < top
    items, slots = items[keep], slots[keep]
    at = left["bundle"][0].as_py() * bundle + items.astype(np.int64)
    return pa.table([pa.array(at), left["ids"][0].values.take(pa.array(slots)), pa.array(scores[items, slots])], schema=_HITS)


def _at_owner(bundles: DataFrame, postings: DataFrame, step: str, schema: str, *args) -> DataFrame:
    """Bundles and posting lists of an owner meet, one bundle and one block of documents at a time."""
    root = _ROOT

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module("labeltrail.llm.lexical_search"), step)(left, right, *args)

    return bundles.groupBy("bundle", "block").cogroup(postings.groupBy("for_bundle", "of_block")).applyInArrow(run, schema)


def _limits(items: DataFrame, asked: DataFrame, owner: int, carried: DataFrame | None, top: int) -> DataFrame:
    """Per bundle, for its items in order: the score that ``top`` documents have, and the most later owners can add.

    Each bundle's row comes ``SALTS`` times, so that a join does not bring all its blocks into one task.
    """
    rest = asked.filter(F.col("owner") > owner).groupBy("bundle", "slot").agg(F.sum(F.col("qtf") * F.col("w") * F.col("cap")).alias("rest"))
    own = items.join(rest, ["bundle", "slot"], "left")
    if carried is None:
        own = own.withColumn("floor", F.lit(0).cast("long"))
    else:
        leaders = carried.select("bundle", F.explode(F.arrays_zip("top_items", "top_scores")).alias("t")).select(
            "bundle", F.col("t.top_items").alias("slot"), F.col("t.top_scores").alias("floor")
        )
        place = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("floor")))
        floors = leaders.withColumn("place", place).filter(F.col("place") <= top).filter(F.col("place") == top)
        own = own.join(floors.drop("place"), ["bundle", "slot"], "left")
    entry = F.struct("slot", F.coalesce("floor", F.lit(0).cast("long")).alias("floor"), F.coalesce("rest", F.lit(0).cast("long")).alias("rest"))
    lists = own.groupBy("bundle").agg(F.sort_array(F.collect_list(entry)).alias("e"))  # at most BUNDLE entries
    return lists.select("bundle", F.col("e.floor").alias("floors"), F.col("e.rest").alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def search(
    index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP,
    bundle: int = BUNDLE, owners: tuple[int, ...] = OWNERS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of an index (see ``build_index``) for each item.

    Only documents with a score above 0 are ranked; equal scores come by ascending id, null ids last. Each row of the
    indexed table is a document, so repeated rows may take several ranks. Equal items (id and text) are asked once;
    items of one id with different texts each have their own ranks, also under a null id. Null and empty texts find
    and are found by nothing. An empty index or no items give an empty result; extra columns are not looked at.
    """
    blocks = index.filter("term is null").select("block", "ids", "lengths")
    own = items.select(F.col(item_id).alias("item_id"), whole_text(text).alias("text")).distinct()
    own = cut(with_position(own, ["item_id", "text"], "at"), "items")
    asked = cut(map_arrow(own.select("at", F.col("text").cast("binary")), _asked_part, "bundle int, slot int, term string, qtf long", bundle), "asked")
    of_length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    n_docs, n_terms, n_items = (x or 0 for x in blocks.select(
        F.sum(F.size(F.filter("lengths", lambda x: x > 0))), F.sum(of_length), F.lit(own.count())
    ).first())

    freq = index.filter("term is not null").join(asked.select("term").distinct(), "term").groupBy("term").agg(
        F.sum(F.size("slots")).alias("df"), F.max(F.array_max("tf")).cast("long").alias("most")
    )
    owner = F.lit(len(owners))
    for k, share in reversed(list(enumerate(owners))):
        owner = F.when(F.col("df") * share <= n_docs, k).otherwise(owner)
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1)))
    cap = F.expr("(1000000000 * most) div (1000 * most + 12 * 75)")  # no document has a smaller m
    asked = cut(asked.join(freq.select("term", weight.cast("long").alias("w"), cap.alias("cap"), owner.alias("owner")), "term"), "weighted")
    users = asked.groupBy("bundle", "term").agg(F.first("owner").alias("owner"), F.first("w").alias("w"), F.collect_list(F.struct("slot", "qtf")).alias("users"))
    places = own.select(F.floor(F.col("at") / bundle).cast("int").alias("bundle"), (F.col("at") % bundle).cast("int").alias("slot"))

    nothing = [F.array().cast(kind).alias(c) for c, kind in (("items", "array<int>"), ("slots", "array<int>"), ("scores", "array<long>"))]
    bundles = (n_items + bundle - 1) // bundle
    carried, start = None, blocks.select(F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)) if bundles else F.array().cast("array<int>")).alias("bundle"), "*", *nothing)
    for k in range(len(owners) + 1):
        now = (start if carried is None else carried.drop("top_items", "top_scores")).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
        now = now.join(_limits(places, asked, k, carried, top), ["bundle", "salt"]).drop("salt")
        postings = index.filter("term is not null").join(users.filter(F.col("owner") == k), "term").select(
            F.col("bundle").alias("for_bundle"), F.col("block").alias("of_block"), "w", "users", "slots", "tf"
        )
        if k < len(owners):
            carried = cut(_at_owner(now, postings, "_carry", _CARRIED_DDL, n_docs, n_terms, top), "carried")
        else:
            hits = _at_owner(now, postings, "_select", _HITS_DDL, n_docs, n_terms, top, bundle)
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = hits.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(own.select("at", "item_id"), "at").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that each item of ``benchmark`` finds best."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
