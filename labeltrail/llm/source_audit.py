"""Audit of how the words of the sources of a language diverge, by ranking cells of counts.

Within a group of documents (a source of a language) the divergence of a term depends on two numbers only: how
often the group has it and how often the language has it. So terms are grouped into cells of (group count,
language count), the divergence is evaluated once per cell, equal values are merged, and cells are ranked by the
terms before them (cumulative multiplicity). Only the cells that reach the wanted ranks are expanded into terms,
in UTF-8 order.

Sources are compared with each other in blocks: a task holds the shares of up to 256 + 256 sources for a slice of
the terms as two matrices and adds up absolute differences. Terms that neither source has differ alike, so they
are counted and not listed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, map_arrow, record_batch, slices, table
from labeltrail.scratch import cut

LEAST_DOCS = 30
TOP_TERMS = 50
STRIP = 256  # sources on either side of a matrix
SLICE_TERMS = 512
HELD_TERMS = 200_000  # counts that a task keeps before it hands them on
HELD_BYTES = 32_000_000
SCALE = 1_000_000_000  # fixed value: shares are counted in parts of it
PRIOR = 5  # fixed value: added to each count

# Letters stay, A-Z lower-cased; all other ASCII characters part terms. Bytes above are parts of letters of UTF-8.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return text.translate(_FOLD).split()


def _count_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, added up within the task as far as its memory allows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = weight = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            words = list(n)
            yield record_batch(_COUNTS, [
                [lang] * len(words), [source] * len(words), pa.array(words, pa.binary()).cast(pa.string()),
                list(n.values()), [docs[w] for w in words],
            ])
        held.clear()

    for batch in slices(batches, 2):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = terms_of(text)
            own = set(words)
            before = len(n)
            n.update(words)
            docs.update(own)
            size += len(n) - before
            weight += sum(map(len, own)) if len(text) > 100_000 else 0
            if size > HELD_TERMS or weight > HELD_BYTES:
                yield from rows()
                size = weight = 0
    yield from rows()


def count_terms(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in a source, and documents with it."""
    own = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    parts = map_arrow(own, _count_part, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str | Column, total: str, terms: str) -> Column:
    """The exact share; the product can pass 64 bits, so it is formed in decimals."""
    count = F.col(count) if isinstance(count, str) else count
    above = F.lit(SCALE).cast("decimal(12,0)") * (count.cast("decimal(20,0)") + F.lit(PRIOR).cast("decimal(2,0)"))
    below = (F.col(total) + PRIOR * F.col(terms)).cast("decimal(20,0)")
    return F.call_function("div", above, below).cast("long") + F.lit(1)


# --- sources against each other -------------------------------------------------------

_DIFF = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _filled(lists: pa.ListArray, rest: np.ndarray, strip: int) -> np.ndarray:
    """Shares of the sources (rows) for the terms of a pack (columns); a source without a term has ``rest``."""
    out = np.repeat(rest[:, None], len(lists), axis=1)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    entries = lists.flatten()
    out[entries.field("at").to_numpy() % strip, np.repeat(np.arange(len(lists)), sizes)] = entries.field("p").to_numpy()
    return out


def _differ(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.stack([np.abs(row[None, :] - right).sum(axis=1) for row in left])


def _pair_part(batches: Batches, strip: int) -> Iterator[pa.RecordBatch]:
    """Sums over the terms of each pack; a pack without terms stands for all terms, at the shares of none."""
    for batch in batches:
        for k in range(batch.num_rows):
            lang, terms, left, right, packed = (c[k] for c in batch.columns)
            same = not right.is_valid
            left, right = left.values, left.values if same else right.values
            rest_a, rest_b = (side.field("rest").to_numpy() for side in (left, right))
            base = np.abs(rest_a[:, None] - rest_b[None, :])
            if packed.is_valid:
                a = _filled(packed.values.field("left"), rest_a, strip)
                b = a if same else _filled(packed.values.field("right"), rest_b, strip)
                value = _differ(a, b) - a.shape[1] * base
            else:
                value = base * terms.as_py()
            i, j = np.nonzero(~np.eye(len(rest_a), dtype=bool) if same else np.ones(value.shape, bool))
            first, second = left.field("source").take(pa.array(i)), right.field("source").take(pa.array(j))
            for one, other in ((first, second),) if same else ((first, second), (second, first)):
                yield record_batch(_DIFF, [[lang.as_py()] * len(i), one, other, value[i, j]])


def _pairs(groups: DataFrame, shares: DataFrame, strip: int, slice_terms: int) -> DataFrame:
    """``lang, source, item, value`` of each ordered pair of sources of a language.

    ``groups(lang, source, at, rest, terms)`` numbers the sources of a language from 0 in ``at``, ``shares`` has
    ``lang, term, at, p`` of the terms that a source has.
    """
    part = F.floor(F.col("at") / strip).cast("int")
    strips = groups.groupBy("lang", part.alias("strip"), "terms").agg(F.sort_array(F.collect_list(F.struct("at", "source", "rest"))).alias("sources"))
    left = strips.select("lang", "terms", F.col("strip").alias("i"), F.col("sources").alias("left"))
    right = strips.select("lang", F.col("strip").alias("j"), F.col("sources").alias("other"))
    sides = (
        left.join(right, "lang").filter("i <= j")
        .select("lang", "i", "j", "terms", "left", F.when(F.col("i") < F.col("j"), F.col("other")).alias("right"))
    )
    # A term goes to each pair of strips of which one has it: as often as there are strips.
    by_strip = shares.groupBy("lang", "term", part.alias("strip")).agg(F.collect_list(F.struct("at", "p")).alias("held"))
    count = groups.groupBy("lang").agg((F.max(part) + 1).alias("strips"), F.first("terms").alias("terms"))
    dealt = by_strip.join(count, "lang").select(
        "lang", "term", "strip", "held", F.ceil(F.col("terms") / slice_terms).cast("int").alias("slices"),
        F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("other"),
    )
    none = F.lit(None).cast("array<struct<at:bigint,p:bigint>>")
    is_left, is_right = F.col("strip") <= F.col("other"), F.col("strip") > F.col("other")
    entries = (
        dealt.select(
            "lang", "term", F.least("strip", "other").alias("i"), F.greatest("strip", "other").alias("j"),
            F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice"),
            F.when(is_left, F.col("held")).otherwise(none).alias("left"), F.when(is_right, F.col("held")).otherwise(none).alias("right"),
        )
        .groupBy("lang", "i", "j", "slice", "term").agg(F.first("left", True).alias("left"), F.first("right", True).alias("right"))
        .groupBy("lang", "i", "j", "slice").agg(F.collect_list(F.struct("left", "right")).alias("entries"))
        .drop("slice")
    )
    whole = sides.withColumn("entries", F.lit(None).cast(entries.schema["entries"].dataType))
    packs = whole.unionByName(sides.join(entries, ["lang", "i", "j"])).select("lang", "terms", "left", "right", "entries")
    found = map_arrow(packs, _pair_part, "lang string, a string, b string, value long", strip)
    return found.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))


# --- terms of a source against its language ---------------------------------------------


def _top_terms(shares: DataFrame, top: int) -> DataFrame:
    """``lang, source, item, value, rank`` of the terms a source has more often than its language.

    ``shares`` has ``lang, source, term, n, all_n, p, q``.
    """
    above = shares.filter("p > q").withColumn("value", F.col("p") - F.col("q"))
    cells = above.groupBy("lang", "source", "n", "all_n", "value").agg(F.count(F.lit(1)).alias("cell"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("cell").alias("many"))
    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    leading = values.withColumn("place", F.row_number().over(group)).filter(F.col("place") <= top)
    before = F.sum("many").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("many")
    wanted = leading.withColumn("before", before).filter(F.col("before") < top).select("lang", "source", "value", "before")
    tied = Window.partitionBy("lang", "source", "value", "before").orderBy("term")
    return (
        above.select("lang", "source", "value", "term").join(wanted, ["lang", "source", "value"])
        .withColumn("among", F.row_number().over(tied)).filter(F.col("among") <= top)
        .withColumn("rank", F.col("before") + F.col("among")).filter(F.col("rank") <= top)
        .select("lang", "source", F.col("term").alias("item"), "value", F.col("rank").cast("int").alias("rank"))
    )


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS, strip: int = STRIP, slice_terms: int = SLICE_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every source of every language.

    Part ``pair`` has each other source of the language with the sum of all differences of term shares, part
    ``term`` the ``top`` terms that the source has more often than its language. A language keeps the terms that
    at least ``least_docs`` of its documents have. Null texts, languages and sources count as empty ones, and
    repeated rows each as a document. Equal values are ranked by the UTF-8 bytes of the item. A source whose
    texts have no kept term still stands in the pairs; a language with one source has none. An empty table
    gives an empty result; other columns are not looked at.
    """
    counts = cut(count_terms(docs, lang, source, text), "counts")
    kept = (
        counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= least_docs).drop("docs")
    )
    held = cut(counts.drop("docs").join(kept, ["lang", "term"]), "kept")
    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("all_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
        .join(languages, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "all_total", "total"])
    )
    numbers = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    rest = F.when(F.col("terms") > 0, _share(F.lit(0), "total", "terms")).otherwise(F.lit(0))
    groups = cut(groups.withColumn("at", numbers.cast("long")).withColumn("rest", rest), "groups")
    shares = held.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "all_n", "at", _share("n", "total", "terms").alias("p"), _share("all_n", "all_total", "terms").alias("q")
    )
    pairs = _pairs(groups, shares.select("lang", "term", "at", "p"), strip, slice_terms)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(
        _top_terms(shares, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language of ``documents``, and their leading terms."""
    return audit(table(spark, sf_dir, "documents"))
