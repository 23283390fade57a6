"""Near-duplicate vectors by sorted projection passes.

Each pass gives a vector the signs of 64 random projections as one number, and orders the vectors
of a label by it. In labels longer than a block, directions are taken from the label's mean, as a direction that all
share would leave most signs equal. Near vectors share a long prefix, so they come close to each other in most passes. A pass cuts the
order into blocks of 1,024; each block is compared with itself and the next in double precision, so every
vector meets all within 1,024 places. Pairs that an earlier pass has compared are left out, which shows
from the blocks both had there: so links are counted exactly once without writing any pair, and a block reports a
number for each vector and a spanning forest of its links.

The first pass tells how many passes each row needs so that a pair at the threshold is met with the wanted probability:
from the signs it shares with the rows a block before and after it, and from its distance to the mean. The number
of passes is the one with the least work; rows that need more are compared with their whole label. If a group of near copies is longer than a block, the
first pass goes on: blocks that still have links at full window length are compared with twice as many
following blocks, until no link is left at the far end. Equal vectors are one vector with a weight.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, list_array, map_arrow, record_batch, table
from labeltrail.llm.simhash import _forest
from labeltrail.operators.cluster.components import components
from labeltrail.operators.position import with_position
from labeltrail.scratch import cut

THRESHOLD = 0.93
BLOCK = 1_024
RECALL = 0.97  # expected share of pairs at the threshold that some pass brings within a block
LEAST_PASSES = 4
_BITS = 64
_NEVER = 10**9  # passes of a row that no number of passes serves


def passes_for(rows: int, block: int = BLOCK, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes that bring a pair at the threshold together with the wanted probability, if ``rows`` vectors share a label.

    A pair agrees in one sign with probability 1 - angle / pi; it is met if it agrees in the prefix that leaves a block of rows.
    """
    agree = 1 - math.acos(threshold) / math.pi
    met = agree ** max(1.0, math.log2(max(rows, 1) / block))
    return max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - met)) if met < 1 else 1)


def _need(depth: Column, agree: Column, recall: float = RECALL) -> Column:
    """Passes that a row needs if its prefixes of ``depth`` signs leave a block, rounded up to a ladder of tenths."""
    met = F.pow(agree, depth)
    need = F.greatest(F.lit(1.0), math.log(1 - recall) / F.log1p(-met))
    return F.when(met >= 1, 1).when(met < 1 / _NEVER, _NEVER).otherwise(F.ceil(F.pow(F.lit(1.1), F.ceil(F.log(need) / math.log(1.1))))).cast("long")


def _least_work(needs: list[tuple[int, int]], rows: int, block: int) -> int:
    """Passes with the fewest comparisons; ``needs`` has the passes that rows need and what comparing these rows with all costs."""
    tried = {LEAST_PASSES, *(max(LEAST_PASSES, n) for n, _ in needs if n < _NEVER)}
    return min(sorted(tried), key=lambda p: p * 1.5 * block * rows + sum(work for n, work in needs if n > p))


# --- hashes ---------------------------------------------------------------------------

_HASHED = pa.schema([
    ("vec_id", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("digest", pa.binary()), ("vec", pa.list_(pa.float64())),
])


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """The usable vectors: neither null nor zero, no null and no non-finite component."""
    found = []
    for v in column:
        if not v.is_valid or len(v.values) == 0 or v.values.null_count:
            found.append(None)
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        found.append(x if np.isfinite(x).all() and x.any() else None)
    return found


def _digest_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(1).to_pylist()
        own = [x if l is not None else None for x, l in zip(_vectors(batch.column(2)), labels)]
        digests = [None if x is None else hashlib.md5((x + 0.0).tobytes()).digest() for x in own]
        vecs = [None if x is None else x for x in own]
        yield record_batch(_HASHED, [batch.column(0), labels, [None if x is None else len(x) for x in own], digests, pa.array(vecs, pa.list_(pa.float64()))])


def _projections(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([dim, number]).standard_normal((dim, _BITS))


def _units(batch: pa.RecordBatch, rows: list[int], column: int) -> np.ndarray:
    x = np.stack([np.asarray(batch.column(column)[k].values) for k in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_SUMS = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])


def _sum_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of each label and length, in each batch."""
    for batch in batches:
        groups: dict[tuple[str, int], list[int]] = {}
        for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            groups.setdefault(key, []).append(k)
        sums = [_units(batch, own, 2).sum(axis=0) for own in groups.values()]
        yield record_batch(_SUMS, [[l for l, _ in groups], [d for _, d in groups], list(map(len, groups.values())), pa.array(sums, pa.list_(pa.float64()))])


def codes(vectors: np.ndarray, number: int) -> np.ndarray:
    """Signs of the projections of pass ``number``, first in the highest bit; signed, in the order of the unsigned numbers."""
    signs = vectors @ _projections(vectors.shape[1], number) >= 0
    raw = np.packbits(signs, axis=1).view(">u8")[:, 0].astype(np.uint64)
    return (raw ^ np.uint64(1 << 63)).view(np.int64)


_CODED = pa.schema([("label", pa.string()), ("digest", pa.binary()), ("dim", pa.int32()), ("codes", pa.list_(pa.int64())), ("agree", pa.float64())])
_CODED_DDL = "label string, digest binary, dim int, codes array<long>, agree double"


def _code_part(batches: Batches, first: int, last: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Codes of passes first to last - 1; and the chance that a sign is the same for a vector at the threshold, as far from the centre."""
    for batch in batches:
        out = np.zeros((batch.num_rows, last - first), np.int64)
        agree = np.zeros(batch.num_rows)
        dims = np.array(batch.column(2).to_pylist())
        centred = batch.column(4)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            x = _units(batch, own.tolist(), 3)
            for k, row in enumerate(own.tolist()):
                if centred[row].is_valid:
                    x[k] -= np.asarray(centred[row].values)
            agree[own] = 1 - np.arccos(np.maximum(-1, 1 - (1 - threshold) / np.maximum((x * x).sum(axis=1), 1e-30))) / math.pi
            for p in range(first, last):
                out[own, p - first] = codes(x, p)
        yield record_batch(_CODED, [*batch.columns[:3], list_array([r.tobytes() for r in out], "<i8"), agree])


# --- comparison -----------------------------------------------------------------------

_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("far_block", pa.int64())])
_FOUND_DDL = "node long, links long, root long, far_block long"


def _compare_part(batches: Batches, threshold: float, block: int, later: bool) -> Iterator[pa.RecordBatch]:
    """Columns: group (two numbers), right (in the following block), pass, rank, label, node, copies, blocks, reach, vec."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        ends = [*(np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1).tolist(), len(a)]
        begin = 0
        for end in ends:
            if end == begin:
                continue
            own = (int(a[begin]), int(b[begin]))
            if own != key and held:
                yield from _compared(pa.Table.from_batches(held), key, threshold, block, later)
                held = []
            key = own
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield from _compared(pa.Table.from_batches(held), key, threshold, block, later)


def _compared(rows: pa.Table, key: tuple[int, int], threshold: float, block: int, later: bool) -> Iterator[pa.RecordBatch]:
    right, number, rank, node, copies = (np.asarray(rows[c]) for c in ("right", "pass", "rank", "node", "copies"))
    if right.all():
        return
    _, label = np.unique(rows["label"].to_pylist(), return_inverse=True)
    blocks = np.stack([np.asarray(x) for x in rows["blocks"].to_pylist()])
    reach = np.asarray(rows["reach"])
    vecs = rows["vec"].to_pylist()
    dims = np.array([len(v) for v in vecs])
    links, pairs = np.zeros(len(node), np.int64), []
    far = False
    adjoining = key[1] - key[0] <= 1
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        x = np.array([vecs[k] for k in own.tolist()])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        left, other = own[~right[own]], own[right[own]]
        for second in ([left, other] if adjoining else [other]):
            if not len(left) or not len(second):
                continue
            i, j = np.nonzero(x[~right[own]] @ x[np.isin(own, second)].T >= threshold)
            i, j = left[i], second[j]
            fine = (label[i] == label[j]) & (number[i] == number[j]) & (i < j if second is left else True)
            if key[0] < 0:  # rows compared with their whole label: two of them meet twice
                fine &= (reach[j] == 0) | (node[i] < node[j])
            i, j = i[fine], j[fine]
            if later:  # pairs of the earlier passes
                apart = np.abs(blocks[i] - blocks[j])
                apart[:, 0] -= np.maximum(1, np.where(blocks[i, 0] < blocks[j, 0], reach[i], reach[j])) - 1
                old = (apart <= 1) & (np.arange(blocks.shape[1]) < number[i][:, None])
                i, j = i[~old.any(axis=1)], j[~old.any(axis=1)]
            far = far or bool((np.abs(rank[i] - rank[j]) >= block).any())
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            pairs.append((i, j))
    root = _forest(len(node), iter(pairs))
    told = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
    if len(told):
        mark = np.full(len(told), -1)
        mark[0] = key[0] if far else -1
        yield record_batch(_FOUND, [node[told], links[told], node[root[told]], mark])


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    block: int = BLOCK, passes: int | None = None,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Links join vectors of one label and one length with a cosine of ``threshold`` or more; equal vectors
    are linked. Rows whose label or vector is null, whose vector is empty, zero or has a null or non-finite
    component link with nothing and are their own component. A row with a null id takes part and gets the component's smallest
    id; it is not kept. Repeated rows are linked copies, of which all with the kept id are marked. An empty table gives an empty
    one; other columns are not looked at.
    """
    own = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vec")
    )
    hashed = cut(map_arrow(own, _digest_part, "vec_id long, label string, dim int, digest binary, vec array<double>"), "hashed")
    usable = hashed.filter("digest is not null")
    distinct = cut(
        usable.groupBy("label", "digest").agg(
            F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec")
        ), "distinct",
    )
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0]
    alone = hashed.filter("digest is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    if not largest:
        return alone
    large = distinct.groupBy("label", "dim").count().filter(F.col("count") > block).select("label", "dim", F.col("count").alias("in_label"))
    large = F.broadcast(cut(large, "large"))
    sums = map_arrow(distinct.join(large, ["label", "dim"]).select("label", "dim", "vec"), _sum_part, "label string, dim int, n long, total array<double>")
    centres = (
        sums.select("label", "dim", "n", F.posexplode("total").alias("pos", "x")).groupBy("label", "dim", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
        .groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("at")).select("label", "dim", F.col("at.x").alias("centre"))
    )
    centres = F.broadcast(cut(centres, "centres"))

    def coded(rows: DataFrame, first: int, last: int) -> DataFrame:
        own = rows.join(centres, ["label", "dim"], "left").select("label", "digest", "dim", "vec", "centre")
        return map_arrow(own, _code_part, _CODED_DDL, first, last, threshold)

    started = coded(distinct, 0, 1).select("label", "digest", "dim", F.col("codes")[0].alias("code"), "agree")
    started = cut(with_position(started, ["label", "dim", "code", "digest"], "node"), "started")
    rows_all = started.count()
    if passes is None and largest > block:

        def depth(places: int) -> Column:
            """Signs that part a row from the one so many places on; none if that is not of its label."""
            same = (F.col("label") == F.col(f"label{places}")) & (F.col("dim") == F.col(f"dim{places}"))
            differ = F.col("code").bitwiseXOR(F.col(f"code{places}"))
            return F.when(same, F.when(differ == 0, _BITS).otherwise(_BITS - F.length(F.bin(differ))) + 1).otherwise(0)

        told = started
        for places in (block, -block):
            other = started.select((F.col("node") - places).alias("node"), *[F.col(c).alias(f"{c}{places}") for c in ("label", "dim", "code")])
            told = told.join(other, "node", "left")
        started = cut(told.select("label", "digest", "dim", "node", _need(F.greatest(depth(block), depth(-block)), F.col("agree")).alias("need")), "needs")
        needs = started.join(large, ["label", "dim"]).groupBy("need").agg(F.sum("in_label").alias("work")).collect()
        passes = _least_work([(r["need"], r["work"]) for r in needs], rows_all, block)
    else:
        passes = passes or passes_for(largest, block, threshold)
        started = started.select("label", "digest", "dim", "node", F.lit(1).cast("long").alias("need"))
    own_block = F.floor(F.col("node") / block).cast("long")
    first = cut(distinct.join(started.withColumn("hard", F.col("need") > passes).drop("need", "dim"), ["label", "digest"]), "first")
    placed = first.filter(~F.col("hard"))
    if passes > 1:
        order = coded(placed, 1, passes).select("label", "digest", "dim", F.posexplode("codes").alias("pass", "code"))
        ranked = with_position(order, ["pass", "label", "dim", "code", "digest"], "rank").select("label", "digest", "pass", (F.col("rank") + rows_all).alias("rank"))
        later = ranked.groupBy("label", "digest").agg(F.sort_array(F.collect_list(F.struct("pass", "rank"))).alias("at"))
        placed = placed.join(later.select("label", "digest", F.col("at.rank").alias("ranks")), ["label", "digest"])
        placed = placed.withColumn("ranks", F.concat(F.array("node"), "ranks"))
    else:
        placed = placed.withColumn("ranks", F.array("node"))
    placed = cut(placed.withColumn("blocks", F.transform("ranks", lambda r: F.floor(r / block).cast("long"))), "placed")

    def compared(dealt: DataFrame, later: bool) -> DataFrame:
        return map_arrow(dealt.repartition("a", "b").sortWithinPartitions("a", "b", "right"), _compare_part, _FOUND_DDL, threshold, block, later)

    def compare(rows: DataFrame, groups: F.Column, later: bool) -> DataFrame:
        """``groups``: array of structs (pass, a, b, right) that a row takes part in."""
        return compared(rows.select("*", F.explode(groups).alias("g")).select(
            "g.a", "g.b", "g.right", "g.pass", F.col("ranks")[F.col("g.pass")].alias("rank"), "label", "node", "copies", "blocks", "reach", "vec"
        ), later)

    def compare_hard() -> DataFrame:
        """The rows that need more passes, in chunks of a block's size, against all blocks of their label."""
        chunks = with_position(first.filter("hard").select("label", "dim", "node"), ["label", "dim", "node"], "at")
        chunks = cut(chunks.withColumn("a", -2 - F.floor(F.col("at") / block).cast("long")).drop("at"), "chunks")
        met = chunks.select("label", "dim", "a").distinct().join(first.select("label", "dim", own_block.alias("b")).distinct(), ["label", "dim"])
        met = cut(met, "chunk_blocks")
        hard = first.join(chunks.select("node", "a"), "node").join(met, ["label", "dim", "a"]).withColumn("right", F.lit(False))
        all_ = first.withColumn("b", own_block).join(met, ["label", "dim", "b"]).withColumn("right", F.lit(True))
        sides = [
            d.select("a", "b", "right", F.lit(0).alias("pass"), F.col("node").alias("rank"), "label", "node", "copies",
                     F.array(own_block).alias("blocks"), F.col("hard").cast("long").alias("reach"), "vec")
            for d in (hard, all_)
        ]
        return compared(sides[0].unionByName(sides[1]), False)

    def windows(first: int, last: int) -> F.Column:
        """A row's own block with the next, and the block before with its own, in passes first to last - 1."""
        parts = []
        for p in range(first, last):
            b = F.col("blocks")[p]
            for a, right in ((b, False), (b - 1, True)):
                parts.append(F.struct(F.lit(p).alias("pass"), a.alias("a"), (a + 1).alias("b"), F.lit(right).alias("right")))
        return F.array(*parts)

    found = cut(compare(placed.withColumn("reach", F.lit(1).cast("long")), windows(0, 1), False), "found")
    results, reach = [found], 1
    reached = found.filter("far_block >= 0").select(F.col("far_block").alias("a"), F.lit(1).cast("long").alias("reach"))
    while True:
        open_ = cut(found.filter("far_block >= 0").select(F.col("far_block").alias("a")).distinct(), "open")
        if open_.isEmpty():
            break
        steps = open_.select("a", F.explode(F.sequence(F.col("a") + reach + 1, F.col("a") + 2 * reach)).alias("b"))
        sides = steps.select(F.col("a").alias("at"), "a", "b", F.lit(False).alias("right")).unionByName(
            steps.select(F.col("b").alias("at"), "a", "b", F.lit(True).alias("right"))
        )
        per_block = sides.groupBy("at").agg(F.collect_list(F.struct(F.lit(0).alias("pass"), "a", "b", "right")).alias("groups"))
        rows = placed.withColumn("reach", F.lit(1).cast("long")).withColumn("at", own_block).join(per_block, "at")
        found = cut(compare(rows, F.col("groups"), False), "found")
        reach *= 2
        results.append(found)
        reached = reached.unionByName(open_.select("a", F.lit(reach).cast("long").alias("reach")))
        # only blocks with links at the far end go on
        found = found.filter("far_block >= 0")
    reached = cut(reached.groupBy("a").agg(F.max("reach").alias("reach")), "reached")
    if passes > 1:
        rows = placed.withColumn("a", F.col("blocks")[0]).join(reached, "a", "left").withColumn("reach", F.coalesce("reach", F.lit(1).cast("long"))).drop("a")
        results.append(cut(compare(rows, windows(1, passes), True), "found"))
    if not first.filter("hard").isEmpty():
        results.append(cut(compare_hard(), "found"))
    told = results[0]
    for r in results[1:]:
        told = told.unionByName(r)
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(told.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("node"), "root")
    rooted = cut(
        first.select("label", "digest", "node", "first_id", "copies").join(links, "node", "left").join(joined, "node", "left")
        .select(
            "label", "digest", "first_id", F.coalesce("root", "node").alias("root"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ), "rooted",
    )
    smallest = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    named = cut(rooted.join(smallest, "root").select("label", "digest", "n_links", "component_id"), "named")
    return usable.select("vec_id", "label", "digest").join(named, ["label", "digest"]).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    ).unionByName(alone.withColumn("kept", F.col("vec_id").isNotNull()))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
