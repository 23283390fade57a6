"""Removal of repeated byte strings, found in suffix order by prefix-free parsing.

A byte is removed if a string of 400 bytes covers it that also starts anywhere else.

1. Texts are cut into phrases wherever a rolling hash of 10 bytes is 0 modulo 48. A phrase reaches to the end of the
   trigger that ends it, so neighbours overlap by 10 bytes and no phrase is the beginning of another. A string can only
   repeat where all phrases inside it do, which one sort of all phrases tells.
2. What is left, strings of repeated phrases with the bytes around them, is dealt to shards by the smallest rolling
   hash in each 400 bytes: equal strings meet in one shard. Equal pieces are kept once, with their number.
3. A shard is parsed again, exactly: the suffix array of its dictionary of phrases orders the rests of phrases, that
   of the parse orders what follows them, and both give the order of all its suffixes. Strings that repeat are
   neighbours in it. As dictionary and parse hold what differs only, this is fast on very repetitive text.

Texts that are equal as a whole have equal parses, so one of them is parsed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, list_array, map_arrow, record_batch, slices, table, whole_text
from labeltrail.llm.word_windows import Powers, mixed, run_hashes
from labeltrail.scratch import cut

LENGTH = 400
TRIGGER = 10  # bytes of the rolling hash
MODULUS = 48
SHARD_BYTES = 1_000_000

_SPANS = Powers(0xA0761D6478BD642F)


def _symbols(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)


def triggers(rolling: np.ndarray) -> np.ndarray:
    return np.flatnonzero(rolling % np.uint64(MODULUS) == 0)


def _phrase_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _SPANS.upto(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _inner_phrases(symbols: np.ndarray, rolling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each phrase between two triggers."""
    at = triggers(rolling)
    start, end = at[:-1], at[1:] + TRIGGER
    return start, end, _phrase_hashes(symbols, start, end)


def _windows_left(n: int, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Which of the first ``n`` windows of ``length`` bytes hold none of the phrases."""
    first, last = np.maximum(end - length, 0), np.minimum(start, n - 1)
    some = first <= last
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first[some], 1)
    np.add.at(step, last[some] + 1, -1)
    return np.cumsum(step[:-1]) == 0


def smallest_in(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, from the running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


# --- prefix-free parsing ----------------------------------------------------------------


def _ranks(keys: np.ndarray, end: np.ndarray, known: int, least: int) -> np.ndarray:
    """Order of the strings from each place on, of which ``keys`` orders the first ``known`` symbols, by doubling.

    Strings end at ``end``; they are told apart in their first ``least`` symbols at least.
    """
    places = np.arange(len(keys))
    distinct, rank = np.unique(keys, return_inverse=True)
    while known < least and len(distinct) < len(keys):
        later = places + known
        following = np.where(later < end, rank[np.minimum(later, len(keys) - 1)] + 1, 0)
        distinct, rank = np.unique(rank * np.int64(len(keys) + 1) + following, return_inverse=True)
        known *= 2
    return rank


def _dictionary_ranks(phrases: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the dictionary: a rank for each place of the phrases one after the other, and where each begins."""
    sizes = np.array([len(p) for p in phrases], np.int64)
    begin = np.cumsum(sizes) - sizes
    end = np.repeat(begin + sizes, sizes)
    data = np.frombuffer(b"".join(phrases), np.uint8).astype(np.int64) + 1
    places = np.arange(len(data))
    keys = np.zeros(len(data), np.int64)
    for k in range(7):  # 7 digits of base 257 fit into 64 bits
        later = places + k
        keys = keys * 257 + np.where(later < end, data[np.minimum(later, len(data) - 1)], 0)
    return _ranks(keys, end, 7, min(length, int(sizes.max()))), begin


def repeated_starts(texts: list[bytes], starts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its first ``starts`` places begin a string of ``length`` bytes that begins elsewhere too.

    The texts together are parsed; each has ``length`` bytes from all of these places on.
    """
    close = b"\xff" * TRIGGER  # no byte of UTF-8, and a trigger by definition
    data = close.join(texts) + close
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + TRIGGER) - sizes - TRIGGER
    last = first + sizes
    rolling = run_hashes(_symbols(data), TRIGGER)
    at = triggers(rolling)
    owner = np.searchsorted(first, at, side="right") - 1
    at = at[at + TRIGGER <= last[owner]]  # not those that reach into the end
    cuts = np.unique(np.concatenate([first, at, last]))
    is_end = np.isin(cuts, last)
    begin = cuts[~is_end]
    until = cuts[1:][~is_end[:-1]] + TRIGGER
    numbers: dict[bytes, int] = {}
    parse = np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(begin.tolist(), until.tolist())], np.int64)
    rank, place = _dictionary_ranks(list(numbers), length)
    parse_rank = _ranks(rank[place[parse]], np.full(len(parse), len(parse)), 1, length)

    wanted = np.concatenate([np.arange(a, a + n) for a, n in zip(first.tolist(), starts)])
    phrase = np.searchsorted(begin, wanted, side="right") - 1
    rest = rank[place[parse[phrase]] + wanted - begin[phrase]]
    after = np.append(parse_rank, -1)[phrase + 1]
    order = np.lexsort((after, rest))
    # Rests of phrases that differ are no beginnings of each other; longer ones than a string may agree in all of it.
    long = (until[phrase] - wanted >= length)[order]
    near = np.flatnonzero((rest[order][1:] == rest[order][:-1]) | (long[1:] & long[:-1]))
    same = [data[i : i + length] == data[j : j + length] for i, j in zip(wanted[order[near]].tolist(), wanted[order[near + 1]].tolist())]
    near = near[np.array(same, bool)]
    found = np.zeros(len(wanted), bool)
    found[order[near]] = found[order[near + 1]] = True
    return np.split(found, np.cumsum(starts)[:-1])


# --- candidates -------------------------------------------------------------------------

_SIGNS = pa.schema([
    ("doc_id", pa.int64()), ("sha256", pa.string()), ("n_bytes", pa.int64()), ("sparse", pa.bool_()),
    ("once", pa.list_(pa.int64())), ("more", pa.list_(pa.int64())),
])
_SIGNS_DDL = "doc_id long, sha256 string, n_bytes long, sparse boolean, once array<long>, more array<long>"


def _sign_part(batches: Batches, length: int) -> Iterator[pa.RecordBatch]:
    """Digest of each text, its phrases that come once or more often, and whether a window holds no whole phrase."""
    for batch in slices(batches, 1):
        digests, sizes, sparse, once, more = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            digests.append(hashlib.sha256(text).hexdigest())
            sizes.append(len(text))
            if len(text) < length:
                sparse.append(False)
                once.append(b"")
                more.append(b"")
                continue
            symbols = _symbols(text)
            start, end, hashes = _inner_phrases(symbols, run_hashes(symbols, TRIGGER))
            found, n = np.unique(hashes, return_counts=True)
            sparse.append(bool(_windows_left(len(text) - length + 1, start, end, length).any()))
            once.append(found[n == 1].tobytes())
            more.append(found[n > 1].tobytes())
        yield record_batch(_SIGNS, [batch.column(0), digests, sizes, sparse, list_array(once, "<i8"), list_array(more, "<i8")])


_SHARED = pa.schema([("phrase", pa.int64()), ("text_key", pa.int64())])


def _shared_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by phrase and text: those whose neighbour has the phrase in another text.

    The first and last row of a partition are kept, as their neighbours are elsewhere.
    """
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        phrase, text = (c.to_numpy() for c in batch.columns)
        differ = (phrase[1:] == phrase[:-1]) & (text[1:] != text[:-1])
        keep = np.append(False, differ) | np.append(differ, False)
        if before is None or (before[0] == phrase[0] and before[1] != text[0]):
            keep[0] = True
            if before is not None:
                yield record_batch(_SHARED, [[before[0]], [before[1]]])
        before = (phrase[-1], text[-1])
        yield record_batch(_SHARED, [phrase[keep], text[keep]])
    if before is not None:
        yield record_batch(_SHARED, [[before[0]], [before[1]]])


_PIECE = pa.struct([("anchor", pa.int64()), ("piece", pa.binary()), ("at", pa.int32()), ("n", pa.int32())])
_SUSPECTS = pa.schema([("sha256", pa.string()), ("text", pa.binary()), ("pieces", pa.list_(_PIECE))])
_SUSPECTS_DDL = "sha256 string, text binary, pieces array<struct<anchor:bigint,piece:binary,at:int,n:int>>"


def _suspect_part(batches: Batches, length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of texts in which a window of repeated phrases begins: ``n`` windows from ``at`` on with one anchor."""
    for batch in slices(batches, 1):
        rows = []
        for digest, text, shared in zip(*(c.to_pylist() for c in batch.columns)):
            symbols = _symbols(text)
            rolling = run_hashes(symbols, TRIGGER)
            start, end, hashes = _inner_phrases(symbols, rolling)
            single = ~np.isin(hashes, np.array(shared or [], np.int64).view(np.uint64))
            at = np.flatnonzero(_windows_left(len(text) - length + 1, start[single], end[single], length))
            if not len(at):
                continue
            anchor = smallest_in(rolling, length - TRIGGER + 1)[at]
            edge = np.flatnonzero((np.diff(at) > 1) | (anchor[1:] != anchor[:-1])) + 1
            pieces = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(at)]):
                begin, n = int(at[a]), b - a
                key = hashlib.blake2b(text[begin : begin + n + length - 1], digest_size=16).digest()
                pieces.append({"anchor": int(anchor[a].view(np.int64)), "piece": key, "at": begin, "n": n})
            rows.append((digest, text, pieces))
        cols = list(zip(*rows)) if rows else [()] * 3
        yield record_batch(_SUSPECTS, [list(c) for c in cols])


# --- shards -----------------------------------------------------------------------------

_TEXTS = pa.schema([("anchor", pa.int64()), ("crowded", pa.bool_()), ("piece", pa.binary()), ("n", pa.int32()), ("bytes", pa.binary())])
_TEXTS_DDL = "anchor long, crowded boolean, piece binary, n int, bytes binary"


def _piece_part(batches: Batches, length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces that a text stands for: ``text, heads``."""
    for batch in slices(batches, 0, 500_000):
        rows = [
            (h["anchor"], h["crowded"], h["piece"], h["n"], text[h["at"] : h["at"] + h["n"] + length - 1])
            for text, heads in zip(*(c.to_pylist() for c in batch.columns)) for h in heads
        ]
        yield record_batch(_TEXTS, [list(c) for c in zip(*rows)] if rows else [[]] * 5)


_STARTS = pa.schema([("piece", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])
_STARTS_DDL = "piece binary, start int, end int"


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _shard_part(batches: Batches, length: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by anchor: runs of places where a string begins that repeats. Pieces of an anchor stay together."""
    keys, texts, counts, size, current = [], [], [], 0, None

    def solve() -> pa.RecordBatch:
        rows = [(k, a, b) for k, mask in zip(keys, repeated_starts(texts, counts, length)) for a, b in _runs(mask)]
        keys.clear(), texts.clear(), counts.clear()
        return record_batch(_STARTS, [list(c) for c in zip(*rows)] if rows else [[]] * 3)

    for batch in slices(batches, 3):
        for anchor, piece, n, text in zip(*(c.to_pylist() for c in batch.columns)):
            if anchor != current and size >= shard_bytes:
                yield solve()
                size = 0
            current = anchor
            keys.append(piece)
            texts.append(text)
            counts.append(n)
            size += len(text)
    if keys:
        yield solve()


_CROWDED = pa.schema([("string", pa.binary()), ("piece", pa.binary()), ("start", pa.int32())])


def _crowded_part(batches: Batches, length: int) -> Iterator[pa.RecordBatch]:
    """A digest of each string of a piece."""
    for batch in slices(batches, 2, 20_000):
        rows = [
            (hashlib.blake2b(text[k : k + length], digest_size=16).digest(), piece, k)
            for piece, n, text in zip(*(c.to_pylist() for c in batch.columns)) for k in range(n)
        ]
        yield record_batch(_CROWDED, [list(c) for c in zip(*rows)] if rows else [[]] * 3)


# --- removal ----------------------------------------------------------------------------

_KEPT = pa.schema([
    ("sha256", pa.string()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])
_KEPT_DDL = "sha256 string, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _keep_part(batches: Batches, length: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        rows = []
        for digest, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
            gone = np.zeros(len(text) + 1, np.int64)
            for r in runs:
                gone[r["start"]] += 1
                gone[r["end"] - 1 + length] -= 1
            removed = np.cumsum(gone[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
            spans = [{"start": a, "end": b} for a, b in _runs(removed)]
            rows.append((digest, int(removed.sum()), hashlib.sha256(kept).hexdigest(), spans))
        yield record_batch(_KEPT, [list(c) for c in zip(*rows)] if rows else [[]] * 4)


def _joined(runs: Column) -> Column:
    """Runs in order, those that follow each other without a gap as one."""
    starts, ends = F.transform(runs, lambda r: r["start"]), F.transform(runs, lambda r: r["end"])
    first, last = F.array_sort(F.array_except(starts, ends)), F.array_sort(F.array_except(ends, starts))
    return F.arrays_zip(first.alias("start"), last.alias("end"))


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, kept_sha256, spans`` of every row.

    ``spans`` has the maximal ranges of removed UTF-8 bytes (start, end exclusive) in order. Each row is a document of its
    own, so repeated rows remove each other, if they have ``length`` bytes; ids may be null or repeat. A null or
    empty text has no byte. An empty table gives an empty result; other columns are not looked at. ``length`` is 20 at least.
    """
    if length < 2 * TRIGGER:
        raise ValueError(f"length must be {2 * TRIGGER} at least")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    signs = cut(map_arrow(own, _sign_part, _SIGNS_DDL, length), "signs")
    texts = cut(
        signs.filter(F.col("n_bytes") >= length).groupBy("sha256")
        .agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"), F.max("sparse").alias("sparse")),
        "texts",
    )

    key = F.xxhash64("sha256").alias("text_key")
    single = signs.select(key, F.explode("once").alias("phrase")).select("phrase", "text_key")
    again = signs.select(key, F.explode("more").alias("phrase")).select("phrase", "text_key")
    # A phrase that is in a text twice counts as repeated; a second row with another key marks it so.
    rows = single.unionByName(again).unionByName(again.select("phrase", F.bitwise_not("text_key").alias("text_key")))
    order = rows.repartitionByRange("phrase", "text_key").sortWithinPartitions("phrase", "text_key")
    shared = map_arrow(order, _shared_part, "phrase long, text_key long").groupBy("text_key").agg(F.collect_set("phrase").alias("shared"))
    asked = texts.withColumn("text_key", key).join(shared, "text_key", "left").filter("sparse or shared is not null")
    found = (
        own.filter(F.octet_length("text") >= length).withColumn("sha256", F.sha2("text", 256))
        .join(asked.select("sha256", "first_doc", "shared"), "sha256").filter(F.col("doc_id").eqNullSafe(F.col("first_doc")))
    )
    suspects = cut(map_arrow(found.select("sha256", "text", "shared"), _suspect_part, _SUSPECTS_DDL, length), "suspects")

    pieces = suspects.select("sha256", F.explode("pieces").alias("p")).select("sha256", "p.*")
    heads = cut(
        pieces.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct("sha256", "at", "n")).alias("head")), "heads"
    )
    # Very many texts around one passage: their pieces share an anchor, and differ.
    crowds = heads.groupBy("anchor").agg(F.sum(F.col("head.n") + F.lit(length)).alias("size")).filter(F.col("size") > 2 * shard_bytes)
    placed = heads.join(crowds.select("anchor", F.lit(True).alias("is_crowd")), "anchor", "left")
    entry = F.struct("anchor", F.coalesce("is_crowd", F.lit(False)).alias("crowded"), "piece", F.col("head.at").alias("at"), F.col("head.n").alias("n"))
    by_text = placed.groupBy(F.col("head.sha256").alias("sha256")).agg(F.collect_list(entry).alias("heads"))
    bodies = suspects.select("sha256", "text").dropDuplicates(["sha256"])
    dealt = map_arrow(bodies.join(by_text, "sha256").select("text", "heads"), _piece_part, _TEXTS_DDL, length)
    dealt = cut(dealt, "pieces")
    shards = dealt.filter("not crowded").select("anchor", "piece", "n", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    starts = map_arrow(shards, _shard_part, _STARTS_DDL, length, shard_bytes)
    strings = map_arrow(dealt.filter("crowded").select("piece", "n", "bytes"), _crowded_part, "string binary, piece binary, start int", length)
    often = strings.groupBy("string").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("string")
    more = strings.join(often, "string").select("piece", "start", (F.col("start") + 1).alias("end"))
    marks = starts.unionByName(more).groupBy("piece").agg(_joined(F.collect_list(F.struct("start", "end"))).alias("runs"))

    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("head.n").alias("end")))
    runs = heads.join(marks, "piece", "left").select("piece", F.when(F.col("many") > 1, whole).otherwise(F.col("runs")).alias("runs")).filter("runs is not null")
    # The runs of a text stay arrays: a row for each would be as many as the bytes around a very common passage.
    moved = F.transform("runs", lambda r: F.struct((r["start"] + F.col("at")).alias("start"), (r["end"] + F.col("at")).alias("end")))
    in_text = pieces.join(runs, "piece").groupBy("sha256").agg(F.flatten(F.collect_list(moved)).alias("runs"))
    single_texts = texts.filter("copies = 1").select("sha256")
    changed = map_arrow(suspects.select("sha256", "text").join(in_text.join(single_texts, "sha256"), "sha256").select("sha256", "text", "runs"), _keep_part, _KEPT_DDL, length)
    copies = texts.filter("copies > 1").select(
        "sha256", F.col("n_bytes").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"),
        F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end"))).alias("spans"),
    )
    results = cut(changed.unionByName(copies), "results")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return signs.select("doc_id", "sha256", "n_bytes").join(results, "sha256", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), F.coalesce("spans", none).alias("spans")
    )


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without strings of 400 bytes that start more than once."""
    return repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
