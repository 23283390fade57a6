"""Removal of repeated passages by suffix automata of reference shards.

A window of 50 words is removed from a document if it also stands in a document with a smaller id.

1. Each text gives anchors: of any 26 neighbouring runs of 25 words the one with the smallest hash. Equal windows
   have equal anchors, so only windows around anchors that two documents share can repeat. Copies of
   a whole text are settled by its hash before that.
2. Those windows are hashed (128 bits) and find the first document that has them; its passages are the reference.
3. The reference is cut into shards of at most 20,000 windows of one document. A task builds the suffix
   automaton of a shard and streams the passages that were dealt to it; the matching statistics say
   word for word where at least 50 words match, and those maximal spans are removed.

An automaton would have to be broadcast to all tasks for each shard, and the number of shards
grows with the corpus; so passages go to the shard that can match them, and a shard that is
asked by very many is copied to several tasks. Each step's rows grow with the repeated text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, list_array, map_arrow, record_batch, slices, table, whole_text
from labeltrail.llm.word_windows import minimizers, run_hashes, word_hashes
from labeltrail.scratch import cut

WINDOW = 50
SHARD_WINDOWS = 20_000
TASK_WINDOWS = 20_000  # windows streamed through a copy of a shard


class SuffixAutomaton:
    """All substrings of a sequence of words, to find how much of a stream matches."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def extend(self, words: Iterable) -> None:
        following, link, length = self.next, self.link, self.length
        for w in words:
            p, new = self.last, len(length)
            following.append({})
            length.append(length[p] + 1)
            link.append(0)
            while p >= 0 and w not in following[p]:
                following[p][w] = new
                p = link[p]
            if p >= 0:
                q = following[p][w]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(length)
                    following.append(dict(following[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and following[p].get(w) == q:
                        following[p][w] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            self.last = new

    def statistics(self, words: Iterable) -> Iterator[int]:
        """For each word of the stream, how many words up to it stand together in the reference."""
        following, link, length = self.next, self.link, self.length
        state = size = 0
        for w in words:
            while state and w not in following[state]:
                state = link[state]
                size = length[state]
            if w in following[state]:
                state = following[state][w]
                size += 1
            yield size


def spans_above(statistics: Iterable[int], least: int) -> list[tuple[int, int]]:
    """Maximal spans covered by matches of at least ``least`` words."""
    found: list[list[int]] = []
    for at, size in enumerate(statistics):
        if size >= least:
            if found and found[-1][1] >= at + 1 - size:
                found[-1] = [min(found[-1][0], at + 1 - size), at + 1]
            else:
                found.append([at + 1 - size, at + 1])
    return [(a, b) for a, b in found]


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers, which come sorted."""
    if not len(places):
        return []
    gap = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.append(0, gap + 1)].tolist(), places[np.append(gap, len(places) - 1)].tolist()))


# --- anchors and windows --------------------------------------------------------------

_SIGNS = pa.schema([
    ("doc_id", pa.int64()), ("words_sha256", pa.string()), ("n_words", pa.int64()), ("anchors", pa.list_(pa.int64())),
])


def _anchor_places(hashed: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    runs = run_hashes(hashed, window // 2)
    return runs, minimizers(runs, window - window // 2 + 1) if len(hashed) >= window else np.zeros(0, np.int64)


def _sign_part(batches: Batches, window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        digests, sizes, anchors = [], [], []
        for text in batch.column(1).to_pylist():
            raw = text.encode("utf-8")
            words = raw.split()
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            sizes.append(len(words))
            runs, places = _anchor_places(word_hashes(raw), window) if len(words) >= window else (None, [])
            anchors.append(np.unique(runs[places]).tobytes() if len(places) else b"")
        yield record_batch(_SIGNS, [batch.column(0), digests, sizes, list_array(anchors, "<i8")])


_SUSPECTS = pa.schema([
    ("doc_id", pa.int64()), ("alt", pa.int32()), ("words_sha256", pa.string()), ("text", pa.string()),
    ("places", pa.list_(pa.int32())), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())),
])


def _suspect_part(batches: Batches, window: int) -> Iterator[pa.RecordBatch]:
    """Places and hashes of the distinct windows around shared anchors."""
    for batch in slices(batches, 3):
        rows: list[tuple] = []
        for doc, alt, digest, text, shared in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode("utf-8")
            if hashlib.sha256(b" ".join(raw.split())).hexdigest() != digest:
                continue  # another text under the same id
            hashed = word_hashes(raw)
            runs, places = _anchor_places(hashed, window)
            own = places[np.isin(runs[places], np.array(shared, np.int64).view(np.uint64))]
            near = np.zeros(len(hashed) - window + 1, bool)
            for p in own.tolist():
                near[max(0, p - window + window // 2) : p + 1] = True
            h1, h2 = run_hashes(hashed, window, 0), run_hashes(hashed, window, 1)
            at = np.flatnonzero(near)
            at = at[np.unique(h1[at], return_index=True)[1]]
            rows.append((doc, alt, digest, text, at.astype("<i4").tobytes(), h1[at].tobytes(), h2[at].tobytes()))
        cols = list(zip(*rows)) if rows else [()] * 7
        yield record_batch(_SUSPECTS, [
            *map(list, cols[:4]), list_array(list(cols[4])), list_array(list(cols[5]), "<i8"), list_array(list(cols[6]), "<i8"),
        ])


# --- matching -------------------------------------------------------------------------

_PASSAGES = pa.schema([
    ("ref_doc", pa.int64()), ("ref_alt", pa.int32()), ("shard", pa.int32()), ("copies", pa.int32()), ("streamed", pa.bool_()),
    ("doc_id", pa.int64()), ("alt", pa.int32()), ("at", pa.int32()), ("words", pa.string()),
])
_PASSAGES_DDL = "ref_doc long, ref_alt int, shard int, copies int, streamed boolean, doc_id long, alt int, at int, words string"


def _reference_part(batches: Batches, window: int, shard_windows: int) -> Iterator[pa.RecordBatch]:
    """Passages of the reference: ``doc_id, alt, text, places of its windows, copies of its shards``."""
    for batch in slices(batches, 2, 500_000):
        rows = []
        for doc, alt, text, places, shards in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.encode("utf-8").split()
            places = np.unique(np.array(places))
            copies = {x["shard"]: x["copies"] for x in shards}
            for shard in np.unique(places // shard_windows).tolist():
                for a, b in _runs(places[places // shard_windows == shard]):
                    rows.append((doc, alt, shard, copies.get(shard, 1), False, doc, alt, a, b" ".join(words[a : b + window]).decode()))
        yield record_batch(_PASSAGES, [list(c) for c in zip(*rows)] if rows else [[]] * 9)


def _stream_part(batches: Batches, window: int) -> Iterator[pa.RecordBatch]:
    """Passages to be streamed: ``doc_id, alt, text, asks`` with the first places of the windows a shard may have."""
    for batch in slices(batches, 2, 500_000):
        rows = []
        for doc, alt, text, asks in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode("utf-8")
            words = raw.split()
            h1 = run_hashes(word_hashes(raw), window, 0)
            _, group, size = np.unique(h1, return_inverse=True, return_counts=True)
            order, begin = np.argsort(group, kind="stable"), np.cumsum(size) - size
            for ask in asks:
                own = np.unique(group[np.array(ask["places"])])  # all places of equal windows
                places = np.sort(np.concatenate([order[begin[g] : begin[g] + size[g]] for g in own.tolist()]))
                for a, b in _runs(places):
                    rows.append((ask["ref_doc"], ask["ref_alt"], ask["shard"], ask["copies"], True, doc, alt, a, b" ".join(words[a : b + window]).decode()))
        yield record_batch(_PASSAGES, [list(c) for c in zip(*rows)] if rows else [[]] * 9)


_MATCHED = pa.schema([("doc_id", pa.int64()), ("alt", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _match_part(batches: Batches, window: int) -> Iterator[pa.RecordBatch]:
    """Sorted by shard, each shard's reference before what is streamed through it."""
    current, automaton, parts = None, None, 0
    for batch in slices(batches, 8, 500_000):
        rows = []
        for ref_doc, ref_alt, shard, salt, streamed, doc, alt, at, words in zip(*(c.to_pylist() for c in batch.columns)):
            if current != (ref_doc, ref_alt, shard, salt):
                current, automaton, parts = (ref_doc, ref_alt, shard, salt), SuffixAutomaton(), 0
            if not streamed:
                if parts:
                    automaton.extend([parts])  # a number is no word: passages don't run together
                automaton.extend(words.split(" "))
                parts += 1
            else:
                rows += [(doc, alt, at + a, at + b) for a, b in spans_above(automaton.statistics(words.split(" ")), window)]
        yield record_batch(_MATCHED, [list(c) for c in zip(*rows)] if rows else [[]] * 4)


_KEPT = pa.schema([
    ("doc_id", pa.int64()), ("words_sha256", pa.string()), ("kept_sha256", pa.string()), ("n_removed", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def _keep_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        rows = []
        for doc, digest, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.encode("utf-8").split()
            removed = united((s["start"], s["end"]) for s in spans)
            kept, at = [], 0
            for a, b in removed:
                kept += words[at:a]
                at = b
            kept += words[at:]
            own = [{"start": a, "end": b} for a, b in removed]
            rows.append((doc, digest, hashlib.sha256(b" ".join(kept)).hexdigest(), len(words) - len(kept), own))
        yield record_batch(_KEPT, [list(c) for c in zip(*rows)] if rows else [[]] * 5)


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    shard_windows: int = SHARD_WINDOWS, task_windows: int = TASK_WINDOWS,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` of every row.

    ``spans`` has the word ranges to remove (start, end exclusive), apart from each other and in order. Words
    are parted by ASCII white space. A null or empty text has no word. Rows with a null id keep all and are
    no reference; rows of one id never remove from each other, also with different texts. Repeated rows
    give repeated rows, an empty table an empty one; other columns are not looked at.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    signs = cut(map_arrow(own, _sign_part, "doc_id long, words_sha256 string, n_words long, anchors array<long>", window), "signs")
    firsts = signs.filter(f"doc_id is not null and n_words >= {window}").groupBy("words_sha256").agg(F.min("doc_id").alias("first_doc"))
    by_doc = Window.partitionBy("first_doc").orderBy("words_sha256")  # one row, but for ids with several texts
    firsts = cut(firsts.withColumn("alt", (F.row_number().over(by_doc) - 1).cast("int")), "firsts")

    anchors = (
        signs.join(firsts, "words_sha256").filter("doc_id = first_doc")
        .select("doc_id", "alt", F.explode("anchors").alias("anchor"))
    )
    shared = cut(
        anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"), "shared"
    )
    asked = anchors.join(shared, "anchor").groupBy("doc_id", "alt").agg(F.collect_set("anchor").alias("anchors"))
    asked = asked.join(firsts.withColumnRenamed("first_doc", "doc_id"), ["doc_id", "alt"])
    found = own.join(asked, "doc_id").select("doc_id", "alt", "words_sha256", "text", "anchors")
    suspects = cut(map_arrow(
        found, _suspect_part,
        "doc_id long, alt int, words_sha256 string, text string, places array<int>, h1 array<long>, h2 array<long>", window,
    ), "suspects")

    windows = suspects.select("doc_id", "alt", F.explode(F.arrays_zip("places", "h1", "h2")).alias("w")).select(
        "doc_id", "alt", F.col("w.places").alias("place"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2")
    )
    references = cut(
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "alt", "place")).alias("first"), F.max("doc_id").alias("last"))
        .filter("first.doc_id < last")
        .select("h1", "h2", F.col("first.doc_id").alias("ref_doc"), F.col("first.alt").alias("ref_alt"), F.col("first.place").alias("ref_place")),
        "references",
    )
    shard = (F.col("ref_place") / shard_windows).cast("int").alias("shard")
    asks = cut(
        windows.join(references, ["h1", "h2"]).filter("doc_id > ref_doc")
        .groupBy("doc_id", "alt", "ref_doc", "ref_alt", shard).agg(F.collect_set("place").alias("places")),
        "asks",
    )
    # A shard is copied to one task for every task_windows windows that are asked of it. The rows here hold no text.
    shards = cut(
        asks.groupBy("ref_doc", "ref_alt", "shard").agg(F.ceil(F.sum(F.size("places")) / task_windows).cast("int").alias("copies")), "shards"
    )
    texts = suspects.select("doc_id", "alt", "text")
    places = references.groupBy("ref_doc", "ref_alt").agg(F.collect_list("ref_place").alias("places"))
    of_text = shards.groupBy("ref_doc", "ref_alt").agg(F.collect_list(F.struct("shard", "copies")).alias("shards"))
    wanted = places.join(of_text, ["ref_doc", "ref_alt"]).withColumnsRenamed({"ref_doc": "doc_id", "ref_alt": "alt"})
    reference = map_arrow(
        texts.join(wanted, ["doc_id", "alt"]).select("doc_id", "alt", "text", "places", "shards"), _reference_part, _PASSAGES_DDL, window, shard_windows
    )
    asked_of = asks.join(shards, ["ref_doc", "ref_alt", "shard"])
    by_text = asked_of.groupBy("doc_id", "alt").agg(F.collect_list(F.struct("ref_doc", "ref_alt", "shard", "copies", "places")).alias("asks"))
    streamed = map_arrow(
        texts.join(by_text, ["doc_id", "alt"]).select("doc_id", "alt", "text", "asks"), _stream_part, _PASSAGES_DDL, window
    )
    one = F.array(F.pmod(F.xxhash64("doc_id", "alt", "at"), F.col("copies")).cast("int"))
    dealt = (
        reference.unionByName(streamed)
        .withColumn("salt", F.explode(F.when(F.col("streamed"), one).otherwise(F.sequence(F.lit(0), F.col("copies") - 1))))
        .select("ref_doc", "ref_alt", "shard", "salt", "streamed", "doc_id", "alt", "at", "words")
        .repartition("ref_doc", "ref_alt", "shard", "salt")
        .sortWithinPartitions("ref_doc", "ref_alt", "shard", "salt", "streamed")
    )
    matched = map_arrow(dealt, _match_part, "doc_id long, alt int, start int, end int", window)
    spans = matched.groupBy("doc_id", "alt").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    changed = cut(map_arrow(
        suspects.join(spans, ["doc_id", "alt"]).select("doc_id", "words_sha256", "text", "spans"), _keep_part,
        "doc_id long, words_sha256 string, kept_sha256 string, n_removed long, spans array<struct<start:int,end:int>>",
    ).distinct(), "changed")

    copy = F.col("doc_id") > F.col("first_doc")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return (
        signs.drop("anchors").join(firsts.drop("alt"), "words_sha256", "left").join(changed, ["doc_id", "words_sha256"], "left")
        .select(
            "doc_id", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
            F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"),
        )
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without passages of 50 words that an earlier document has."""
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
