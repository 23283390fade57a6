"""SimHash near-duplicates by a hierarchical index in Gray order.

Two fingerprints of 64 bits that differ in at most three agree in one of four
quarters of the bits, so each distinct fingerprint goes to four groups, one for each
quarter. A group that is too large for a task is split the same way on its remaining bits,
which loses no pair and bounds every group whatever the data: after four splits 44 bits are
fixed. Inside a group fingerprints are sorted by Gray rank, so neighbours differ in few
bits, and a binary tree is laid over them whose nodes hold the bits that all fingerprints below share.
Pairs of nodes are followed from the top down with the differences of their shared bits added
up; a pair of groups is pruned as a whole when they exceed three, and taken as a whole when all its members must be close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, map_arrow, numbered, place, record_batch, slices, table, whole_text
from labeltrail.operators.cluster.components import components
from labeltrail.scratch import cut

DISTANCE = 3
SHINGLE = 3
SEED = 42
GROUP_LIMIT = 20_000  # fingerprints of a group before it is split
_MOST_SPLITS = 4
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_FRONTIER = 200_000
#: Bit j of a byte as the j-th byte of a 64-bit number, to add up eight counters at once.
_SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(j)) & np.uint64(1)) << np.uint64(8 * j) for j in range(8))


# --- fingerprints ---------------------------------------------------------------------


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit set."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 255 * 1024):
        lanes = _SPREAD[hashes[a : a + 255 * 1024].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if over half of the shingle hashes have it; 0 without a word."""
    import xxhash

    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space cuts
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :]
    first = np.append(0, ends[:-1] + 1)[: len(last)]
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first.tolist(), last.tolist())), "<u8", len(last))
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def _fingerprint_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        prints = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield record_batch(_PRINTS, [batch.column(0), prints.view(np.int64)])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; the fingerprint as a signed long."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return map_arrow(own, _fingerprint_part, "doc_id long, fp long")


# --- index ----------------------------------------------------------------------------


def gray_rank(fp: F.Column) -> F.Column:
    """Place of a bit pattern in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def parts_of(mask: int) -> list[int]:
    """The mask extended by each quarter of its missing bits: a pair close in all bits agrees in one."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
    return [mask | sum(1 << b for b in free[a:b_]) for a, b_ in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _groups(prints: DataFrame, group_limit: int) -> DataFrame:
    """``mask, key, fp``: the groups that a task can hold, which together have all close pairs."""

    def dealt(df: DataFrame, masks: F.Column) -> DataFrame:
        return df.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")

    masks = parts_of(0)
    rows, done = dealt(prints, F.array(*[F.lit(_signed(m)) for m in masks])), []
    for _ in range(_MOST_SPLITS):
        large = cut(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_limit).drop("n"), "large")
        if large.isEmpty():
            break
        done.append(rows.join(large, ["mask", "key"], "left_anti"))
        finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in parts_of(m)]))])
        # one mask can be reached by several ways
        rows = cut(dealt(rows.join(large, ["mask", "key"], "left_semi"), finer[F.col("mask")]).distinct(), "finer")
        masks = sorted({p for m in masks for p in parts_of(m)})
    for part in done:
        rows = rows.unionByName(part)
    return rows


class GrayTree:
    """Binary trees over many groups of fingerprints, each sorted by Gray rank.

    Level 0 has the fingerprints, a node of level k up to 2**k neighbours of one group:
    ``shared`` has the bits in which they agree, ``bits`` their values. All groups are laid out one after
    the other; ``first[level][g]`` is the place of the first node of group g, which has ``count[level][g]``.
    """

    def __init__(self, prints: np.ndarray, sizes: np.ndarray):
        self.shared, self.bits = [np.full(len(prints), _ALL)], [prints]
        self.count, self.first = [sizes], [np.cumsum(sizes) - sizes]
        while self.count[-1].max(initial=0) > 1:
            shared, bits, count, first = self.shared[-1], self.bits[-1], self.count[-1], self.first[-1]
            up = np.where(count > 1, (count + 1) // 2, 0)  # a group ends with the level where it has one node
            group = np.repeat(np.arange(len(up)), up)
            local = np.arange(len(group)) - np.repeat(np.cumsum(up) - up, up)
            left = first[group] + 2 * local
            right = np.where(2 * local + 1 < count[group], left + 1, left)
            both = shared[left] & shared[right] & ~(bits[left] ^ bits[right])
            self.shared.append(both)
            self.bits.append(bits[left] & both)
            self.count.append(up)
            self.first.append(np.cumsum(up) - up)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places of close fingerprints that connect all that are connected."""
        for level in range(len(self.count)):
            own = np.flatnonzero(self.count[level] == 1)
            if len(own) and level:
                root = self.first[level][own]
                yield from self._follow(level, own, root, root, np.zeros(len(own), np.int64), np.zeros(len(own), np.uint64))

    def _follow(self, level, group, a, b, known, seen) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes (a, b) with ``known`` differences in the ``seen`` bits that their parents share."""
        stack = [(level, group, a, b, known, seen)]
        while stack:
            level, group, a, b, known, seen = stack.pop()
            if len(a) > _FRONTIER:
                half = len(a) // 2
                stack += [(level, *(x[s] for x in (group, a, b, known, seen))) for s in (slice(half), slice(half, None))]
                continue
            both = self.shared[level][a] & self.shared[level][b]
            known = known + np.bitwise_count((self.bits[level][a] ^ self.bits[level][b]) & both & ~seen)
            near = known <= DISTANCE
            whole = near & (known + np.bitwise_count(~both) <= DISTANCE)
            if whole.any():
                yield from self._whole(level, group[whole], a[whole], b[whole])
            go = near & ~whole
            if not go.any():
                continue
            group, a, b, known, both = group[go], a[go], b[go], known[go], both[go]
            below, count = self.first[level - 1][group], self.count[level - 1][group]
            at_a, at_b = 2 * (a - self.first[level][group]), 2 * (b - self.first[level][group])
            for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
                fine = (at_a + i < count) & (at_b + j < count) & ((a != b) | (i <= j))
                stack.append((level - 1, group[fine], (below + at_a + i)[fine], (below + at_b + j)[fine], known[fine], both[fine]))

    def _whole(self, level, group, a, b) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All members are close: neighbours of a node linked to a chain, two nodes linked once."""
        begin = self.first[0][group]
        start_a = begin + ((a - self.first[level][group]) << level)
        start_b = begin + ((b - self.first[level][group]) << level)
        other = a != b
        yield start_a[other], start_b[other]
        own = ~other
        width = np.minimum(begin[own] + self.count[0][group[own]], start_a[own] + (1 << level)) - start_a[own] - 1
        place = np.repeat(start_a[own], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        yield place, place + 1


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest place connected to each of n places."""
    root = np.arange(n)

    def settle() -> None:
        while True:
            up = root[root]
            if (up == root).all():
                return
            root[:] = up

    for a, b in links:
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            settle()
    return root


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Links inside the groups of a partition, which come sorted; each group whole, a number of them at once."""
    held = [np.zeros(0, np.int64)] * 3

    def linked(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        sizes = np.diff(np.append(begin, len(fp)))
        several = np.repeat(sizes > 1, sizes)
        prints = fp[several]
        root = _forest(len(prints), GrayTree(prints.view(np.uint64), sizes[sizes > 1]).links())
        moved = root != np.arange(len(root))
        return record_batch(_LINKS, [prints[moved], prints[root[moved]]])

    for batch in batches:
        held = [np.concatenate((h, np.asarray(c))) for h, c in zip(held, batch.columns)]
        mask, key, _ = held
        if len(mask) < 50_000:
            continue
        last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
        upto = last[-1] + 1 if len(last) else 0
        if upto:
            yield linked(*[h[:upto] for h in held])
            held = [h[upto:] for h in held]
    if len(held[0]):
        yield linked(*held)


def close_links(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that join all that are joined by close pairs.

    Every link differs in at most three bits or follows from such links inside one group.
    """
    grouped = (
        _groups(prints, group_limit).withColumn("rank", gray_rank(F.col("fp")))
        .repartition("mask", "key").sortWithinPartitions("mask", "key", "rank")
    )
    return map_arrow(grouped.select("mask", "key", "fp"), _link_part, "a long, b long").distinct()


# --- documents ------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``doc_id, fp, root, component_id`` of every row.

    Rows are linked if their fingerprints differ in at most three bits; ``component_id`` is the smallest id that
    can be reached, ``root`` the smallest fingerprint. Null and empty texts have fingerprint zero and are linked as
    any other. Rows with a null id take part and get the smallest id of the others, null if there is none.
    Repeated rows give repeated rows, an empty table an empty one; other columns are not looked at.
    """
    own = cut(fingerprints(docs, doc_id, text), "prints")
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct_prints")
    joined = components(close_links(distinct.select("fp"), group_limit)).select(F.col("id").alias("fp"), "root")
    rooted = cut(
        distinct.join(joined, "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    smallest = cut(rooted.groupBy("root").agg(F.min("first_doc").alias("component_id")), "smallest")
    named = cut(rooted.join(smallest, "root").select("fp", "root", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest id.

    Rows that repeat that id count as one document, of which the first by text stays. A group without
    any id keeps its first row by text.
    """
    own, doc_id, text = numbered(docs), place(docs, "doc_id"), place(docs, "text")
    rest = [c for c in own.columns if c not in (doc_id, text)]
    found = near_duplicates(docs)
    kept = cut(found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(doc_id)).agg(F.count(F.lit(1)).alias("rows")), "kept")
    by_id = own.join(kept.hint("merge"), doc_id)  # kept ids grow with the corpus: never a broadcast
    chosen = by_id.filter("rows = 1").select(*own.columns)
    if not kept.filter("rows > 1").isEmpty():
        order = Window.partitionBy(doc_id).orderBy(text, *rest)  # a few rows: those that repeat an id
        repeated = by_id.filter("rows > 1").withColumn("at", F.row_number().over(order)).filter("at = 1")
        chosen = chosen.unionByName(repeated.select(*own.columns))
    lone = found.filter("component_id is null").select("fp", "root").distinct()
    if not lone.isEmpty():
        nameless = own.filter(F.col(doc_id).isNull()).withColumn("words", whole_text(text))
        texts = nameless.select("words").distinct().withColumn("key", F.xxhash64("words"))
        prints = fingerprints(texts, "key", "words").select(F.col("doc_id").alias("key"), "fp")
        first_text = texts.join(prints, "key").join(lone, "fp").groupBy("root").agg(F.min("words").alias("words"))
        order = Window.partitionBy("words").orderBy(*rest)
        firsts = nameless.join(first_text.select("words"), "words").withColumn("at", F.row_number().over(order)).filter("at = 1")
        chosen = chosen.unionByName(firsts.select(*own.columns))
    return chosen.toDF(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
