"""Token ids in binary files: patched frame-of-reference blocks with an index.

A file holds the ids of a run of documents, in blocks of 128. A block keeps its
smallest id and the differences to it in the bit width that holds 90 percent of
them; the high bits of the others go to an exception list with their places.
Block starts and document starts are indexed, so any document can be read alone.

File layout, all numbers little-endian::

    blocks   one after the other:  base u32 | width u8 | exceptions u8 | packed u32[4 * width]
                                   | places u8[exceptions] | high bits u32[exceptions]
    block index   u64 for each block, its first byte
    doc index     u64 for each document, its first id; then i64 document ids; then u8, 1 where the id is null
    footer        docs u64 | ids u64 | blocks u64 | b"PFORIDS1"

The last block is filled up with its smallest id; the number of ids tells where
the documents end. Difference number 4 * j + lane of a block lies in bits
``j * width`` on of its lane; word i of lane l is word ``4 * i + l`` of the block.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, list_array, map_arrow, record_batch, slices
from labeltrail.scratch import cut, new_path

BLOCK = 128
PERCENTILE = 90
CACHE_WORDS = 500_000
_LANES = 4
_ROWS = BLOCK // _LANES
_MAGIC = b"PFORIDS1"
_FOOTER = struct.Struct("<QQQ8s")
_HEAD = struct.Struct("<IBB")
_READ_BLOCKS = 8_192
_SIGNS = b".,;:!?%$&#*|()"
_LAST_LETTER = "\u024f"  # up to here, all agree on what a letter is
_LONGEST = 64  # characters of a part that is kept
# Kinds of bytes; a letter and a sign have a sum of their own.
_OTHER, _LATIN, _MAYBE_WHITE, _LETTER, _SIGN, _WHITE, _FEED, _SPACE = 0, 1, 2, 8, 16, 40, 41, 42
_WHITE_SPACES = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_KINDS = np.zeros(256, np.uint8)
_KINDS[[c for c in range(0x80) if chr(c).isspace()]] = _WHITE
_KINDS[0x0A], _KINDS[0x20] = _FEED, _SPACE
_KINDS[[c for c in range(0x80) if chr(c).isalpha()]] = _LETTER
_KINDS[list(_SIGNS)] = _SIGN
_KINDS[0xC3:0xC9] = _LATIN  # of two bytes up to U+023F, all of them letters but two
_KINDS[sorted({raw[0] for raw in _WHITE_SPACES})] = _MAYBE_WHITE


# --- encoding -------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts by the tokenizers library, each distinct part of a text encoded once while it is in the cache.

    Texts are cut where the pre-tokenizer cuts whatever stands around: before a single space and around a single
    line feed between two non-spaces, and between letters and signs. So the ids of the parts are those of the whole
    text. Holds only for byte-level tokenizers without a normalizer, which is checked, and for texts without
    added tokens; others are encoded whole. A part of plain letters is one piece to the pre-tokenizer, so it
    goes to the model at once. Of the cache, the last ``limit`` parts and those before them are held.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"] or {}
        self.by_parts = (
            spec["normalizer"] is None and pre.get("type") == "ByteLevel"
            and not pre["add_prefix_space"] and pre["use_regex"] and not spec["model"].get("dropout")
        )
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled = [(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0]) for c in range(0x250)]
        self.bytes = {b: letter for raw, letters in spelled for b, letter in zip(raw, letters)}  # as the model spells them
        self.space = self.bytes[0x20]
        self.spaced = self.bytes | {0x20: " " + self.space}
        self.at_spaces = Tokenizer(self.model)  # the model over strings that are spelled already
        self.at_spaces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocab.items() if token.startswith(self.space)]] = True
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _letters(self, word: str) -> bytes:
        """Ids of plain letters, with a space before them or not."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.bytes))]).tobytes()

    def _spaced_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters with a space before each, in one call: only its first token begins with the space."""
        text = "".join(words)
        text = text.replace(" ", self.spaced[0x20]) if text.isascii() else text.encode().decode("latin-1").translate(self.spaced)
        ids = np.array(self.at_spaces.encode_batch_fast([text[1:]], add_special_tokens=False)[0].ids, np.uint32)
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(words):
            return [self._letters(w) for w in words]
        ends, data = [*(4 * first[1:]).tolist(), 4 * len(ids)], ids.tobytes()
        return [data[a:b] for a, b in zip((4 * first).tolist(), ends)]

    def _new(self, parts: list[str], places: list[int], found: list[bytes | None]) -> None:
        """Puts the ids of new parts into their places."""
        words, others = [], []
        for k in places:
            part = parts[k]
            body = part[1:] if part[0] == " " else part
            if not body.isalpha() or not body.isascii() and max(body) > _LAST_LETTER:
                others.append(k)
            elif body is part:
                found[k] = self._letters(part)
            else:
                words.append(k)
        for some, encode in (words, self._spaced_letters), (others, self._encode):
            for k, ids in zip(some, encode([parts[k] for k in some]) if some else ()):
                found[k] = ids

    def _found(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts."""
        found = list(map(self.known.get, parts))
        places = [k for k, ids in enumerate(found) if ids is None]
        if self.before:
            for k in places:
                found[k] = self.before.get(parts[k])
        self._new(parts, [k for k in places if found[k] is None], found)
        if len(self.known) >= self.limit:
            self.known, self.before = {}, self.known
        for k in places:
            if len(parts[k]) <= _LONGEST:
                self.known[parts[k]] = found[k]
        return found

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        _, offsets, body = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
        if not ends[-1]:
            return [b""] * len(texts)
        data = body.to_pybytes()[: ends[-1]]
        cuts = _cuts(data, ends)
        parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), body).dictionary_encode()
        ids = self._found(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes, which = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, parts.indices.to_numpy()
        n = sizes[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        shift = (np.cumsum(sizes) - sizes)[which] - upto[:-1]
        data = np.frombuffer(b"".join(ids), np.uint32)[np.repeat(shift, n) + np.arange(upto[-1])].tobytes()
        at = (4 * upto[np.searchsorted(cuts, ends)]).tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed ids, unsigned 32-bit little-endian, of each text."""
        whole = [not self.by_parts or any(a in t for a in self.added) for t in texts]
        if not any(whole):
            return self._by_parts(texts)
        others = iter(self._by_parts([t for t, w in zip(texts, whole) if not w]))
        return [self._encode([t])[0] if w else next(others) for t, w in zip(texts, whole)]


def _cuts(text: bytes, ends: np.ndarray) -> np.ndarray:
    """Where parts begin and end in UTF-8 texts one after the other, of which ``ends`` has the first byte and the ends."""
    data = np.frombuffer(text, np.uint8)
    kind = np.full(len(data) + 2, _WHITE, np.uint8)
    own = kind[1:-1]
    own[:] = np.frombuffer(text.translate(_KINDS.tobytes()), np.uint8)
    lead = np.flatnonzero(own == _LATIN)
    letter = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]  # not the signs of times and division
    own[letter] = own[letter + 1] = _LETTER
    lead = np.flatnonzero(own == _MAYBE_WHITE)
    if len(lead):
        code = sum(data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) << (16 - 8 * k) for k in range(3))
        for raw in _WHITE_SPACES:
            at = lead[code >> (24 - 8 * len(raw)) == int.from_bytes(raw)]
            for k in range(len(raw)):
                own[at + k] = _WHITE
    white = kind >= _WHITE
    alone = (own > _WHITE) & ~(white[:-2] | white[2:])
    begins = np.append(alone, False)
    begins[1:] |= alone & (own == _FEED)
    begins[:-1] |= kind[:-2] + own == _LETTER + _SIGN
    begins[ends] = True
    return np.flatnonzero(begins)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One per Python worker, so that its cache serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# --- blocks ---------------------------------------------------------------------------


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits needed for each value below 2**32."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Ids in whole blocks to their bytes, and the size of each block."""
    blocks = ids.astype(np.uint32).reshape(-1, BLOCK)
    base = blocks.min(axis=1) if len(blocks) else np.zeros(0, np.uint32)
    rest = blocks - base[:, None]
    place = BLOCK * PERCENTILE // 100
    width = _bits(np.partition(rest, place, axis=1)[:, place]) if len(blocks) else np.zeros(0, np.int64)
    outlier = (rest >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0) & (width < 32)[:, None]
    low = np.where(outlier, rest & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None], rest)
    n = outlier.sum(axis=1)
    sizes = _HEAD.size + 4 * _LANES * width + 5 * n
    begin = np.cumsum(sizes) - sizes
    out = np.empty(sizes.sum(), np.uint8)
    out[begin[:, None] + np.arange(4)] = base.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[begin + 4], out[begin + 5] = width, n
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        lanes = np.ascontiguousarray(low[own].reshape(-1, _ROWS, _LANES).transpose(1, 0, 2))
        packed = np.zeros((w, len(own), _LANES), "<u4")
        for j in range(_ROWS):
            word, shift = divmod(j * w, 32)
            packed[word] |= lanes[j] << np.uint32(shift)
            if shift + w > 32:
                packed[word + 1] |= lanes[j] >> np.uint32(32 - shift)
        body = np.ascontiguousarray(packed.transpose(1, 0, 2)).view(np.uint8).reshape(len(own), -1)
        out[begin[own, None] + _HEAD.size + np.arange(4 * w * _LANES)] = body
    block, at = np.nonzero(outlier)
    place, order = begin[block] + _HEAD.size + 4 * _LANES * width[block], _places(n)
    out[place + order] = at
    high = (rest[block, at] >> width[block].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(place + n[block] + 4 * order)[:, None] + np.arange(4)] = high
    return out.tobytes(), sizes


def _places(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``n``."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at the given bytes of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    starts = starts.astype(np.int64)
    base = sum(raw[starts + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
    width, outliers = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    body = starts + _HEAD.size
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            spans = body[own, None] + np.arange(4 * w * _LANES)
            packed = np.ascontiguousarray(raw[spans].view("<u4").reshape(-1, w, _LANES).transpose(1, 0, 2))
            mask = np.uint32((1 << w) - 1)
            lanes = np.empty((_ROWS, len(own), _LANES), np.uint32)
            for j in range(_ROWS):
                word, shift = divmod(j * w, 32)
                value = packed[word] >> np.uint32(shift)
                if shift + w > 32:
                    value = value | (packed[word + 1] << np.uint32(32 - shift))
                lanes[j] = value & mask
            out[own] = lanes.transpose(1, 0, 2).reshape(-1, BLOCK)
    block, order = np.repeat(np.arange(len(starts)), outliers), _places(outliers)
    first = (body + 4 * _LANES * width)[block]
    high = raw[(first + outliers[block] + 4 * order)[:, None] + np.arange(4)].view("<u4").ravel()
    out[block, raw[first + order]] |= (high.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    return (out + base[:, None]).reshape(-1)


# --- files ----------------------------------------------------------------------------


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if re.match("file:/(?!/)", path):  # as Spark writes the warehouse folder
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Hadoop has it on the driver: tasks find the same place by it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _open(path: str):
    store, name = _store(path)
    return store.open_input_file(name)


class FileWriter:
    """Writes one file from packed ids of document after document, holding a few blocks and the indexes."""

    def __init__(self, path: str):
        store, name = _store(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(name)
        self.rest = b""
        self.at = self.ids = 0
        self.blocks: list[np.ndarray] = []
        self.firsts: list[int] = []
        self.docs: list[int | None] = []

    def add(self, docs: list[int | None], ids: list[bytes]) -> None:
        for d, own in zip(docs, ids):
            self.docs.append(d)
            self.firsts.append(self.ids)
            self.ids += len(own) // 4
        data = b"".join([self.rest, *ids])
        whole = len(data) // (4 * BLOCK) * 4 * BLOCK
        for first in range(0, whole, 4 * BLOCK * _READ_BLOCKS):
            self._write(np.frombuffer(data[first : min(first + 4 * BLOCK * _READ_BLOCKS, whole)], "<u4"))
        self.rest = data[whole:]

    def _write(self, ids: np.ndarray) -> None:
        body, sizes = pack(ids)
        self.out.write(body)
        self.blocks.append(self.at + np.cumsum(sizes) - sizes)
        self.at += len(body)

    def close(self) -> None:
        if self.rest:
            left = np.frombuffer(self.rest, "<u4")
            self._write(np.concatenate((left, np.full(BLOCK - len(left), left.min(), np.uint32))))
        starts = np.concatenate(self.blocks) if self.blocks else np.zeros(0, np.int64)
        self.out.write(starts.astype("<u8").tobytes())
        self.out.write(np.array(self.firsts, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.out.write(_FOOTER.pack(len(self.docs), self.ids, len(starts), _MAGIC))
        self.out.close()


class FileReader:
    """Documents of a file, all in order or one alone."""

    def __init__(self, path: str):
        self.file = _open(path)
        size = self.file.size()
        docs, self.n_ids, blocks, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no token file")
        index = size - _FOOTER.size - 17 * docs - 8 * blocks
        part = lambda at, n, kind: np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)
        self.starts = np.append(part(index, blocks, "<u8"), np.uint64(index))
        at = index + 8 * blocks
        self.firsts = np.append(part(at, docs, "<u8"), np.uint64(self.n_ids)).astype(np.int64)
        null = part(at + 16 * docs, docs, np.uint8)
        self.docs = [None if n else d for d, n in zip(part(at + 8 * docs, docs, "<i8").tolist(), null.tolist())]

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first to last - 1."""
        begin = int(self.starts[first])
        data = self.file.read_at(int(self.starts[last]) - begin, begin)
        return unpack(data, self.starts[first:last] - np.uint64(begin))

    def document(self, k: int) -> np.ndarray:
        a, b = int(self.firsts[k]), int(self.firsts[k + 1])
        if a == b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, -(-b // BLOCK)
        return self.blocks(first, last)[a - first * BLOCK : b - first * BLOCK]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document, first id in the file, ids); holds a few thousand blocks and one document."""
        held, begin, block, blocks = [], 0, 0, len(self.starts) - 1
        have = 0
        for k, doc in enumerate(self.docs):
            a, b = int(self.firsts[k]), int(self.firsts[k + 1])
            while begin + have < b:
                upto = min(block + _READ_BLOCKS, blocks)
                held.append(self.blocks(block, upto))
                have += len(held[-1])
                block = upto
            if len(held) != 1:
                held = [np.concatenate(held)] if held else [np.zeros(0, np.uint32)]
            yield doc, a, held[0][a - begin : b - begin]
            if b - begin > BLOCK * _READ_BLOCKS:
                held, begin = [held[0][b - begin :]], b
                have = len(held[0])


# --- Spark ----------------------------------------------------------------------------


def _write_part(batches: Batches, path: str, tokenizer: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, writer = _encoder(tokenizer), None
    end = b"" if end_id is None else np.uint32(end_id).tobytes()
    name = f"{path.rstrip('/')}/{uuid.uuid4().hex}.ids"
    for batch in slices(batches, 1, 4_000_000):
        if batch.num_rows:
            writer = writer or FileWriter(name)
            writer.add(batch.column(0).to_pylist(), [i + end for i in encode(batch.column(1).to_pylist())])
    if writer:
        writer.close()
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "path": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.ids]}
        )


def _read_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []
            size = 0
            for doc, first, ids in FileReader(name):
                rows.append((doc, before + first, ids.astype("<u4").tobytes()))
                size += len(ids)
                if size > 2_000_000:
                    yield _doc_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _doc_batch(rows)


def _digest_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    """As ``_read_part``, but the ids stay where they are read."""
    for batch in batches:
        for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            for doc, first, ids in FileReader(name):
                rows.append((doc, before + first, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                if len(rows) == 10_000:
                    yield record_batch(_DIGEST, [list(c) for c in zip(*rows)])
                    rows = []
            if rows:
                yield record_batch(_DIGEST, [list(c) for c in zip(*rows)])


_MANIFEST = "part int, path string, n_docs long, n_ids long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode whole texts and write them in ascending order of ``doc_id``; returns the manifest.

    Rows are range-partitioned, each task writes the files of its range under a name of
    its own, and the manifest lists the files of the tasks that succeeded, so a repeated
    task leaves nothing behind that is read. ``start`` of the manifest is the number of
    ids before a file. A null text is empty, a null ``doc_id`` comes first, rows with
    equal ids are ordered by text, an empty table gives no file. A path without a scheme is in
    the file system that Spark takes by default.
    """
    path = _qualified(docs.sparkSession, path)

    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    begins = F.substring("text", 1, 64)  # in the order of the texts: many rows of one id, or of none, are more than a task's share
    ordered = own.repartitionByRange(F.col("doc_id"), begins).sortWithinPartitions("doc_id", "text")
    files = cut(map_arrow(ordered, _write_part, _MANIFEST, path, tokenizer, end_id), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of all documents; ``start`` counts the ids of all documents before it."""
    return map_arrow(_spread(manifest), _read_part, "doc_id long, start long, ids array<int>")


def _spread(manifest: DataFrame) -> DataFrame:
    """The files, one to a task."""
    return manifest.select("path", "start").repartition(max(1, manifest.count()))


def _doc_batch(rows: list[tuple]) -> pa.RecordBatch:
    docs, starts, ids = zip(*rows)
    return record_batch(_DOCS, [list(docs), list(starts), list_array(list(ids))])


def token_digest(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all documents, from the files."""
    return map_arrow(_spread(manifest), _digest_part, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids, written to token files and read back."""
    import public_tokenizers

    from labeltrail.llm.common import table

    documents = table(spark, sf_dir, "documents")
    manifest = write_tokens(documents, new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_digest(manifest)
