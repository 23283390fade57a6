"""Language identification by a convolutional network over bytes.

Filters of two, three and four bytes slide over windows of 256 bytes; the largest
answer of each filter in a window goes through a ReLU to a softmax over the languages. A
text of any length is cut into windows, and its prediction is the mean of their
probabilities, weighted by their letters. The network is trained in numpy on the driver,
on a sample of labelled windows whose size is bounded by parameters.

As a filter over one-hot bytes is a sum of table rows, one for each byte, the
rows of neighbouring bytes are added up beforehand, and a window costs a few look-ups per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, ddl, map_arrow, numbered, place, record_batch, table, whole_text

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
MOST_LANGUAGES = 1_000
_CHUNK = 64  # windows computed at once
_HELD = 4_096  # windows cut at once


def _byte_classes() -> np.ndarray:
    """Class of each byte: 0 is padding; ASCII letters fold to lower case, digits, spaces and other signs fall together."""
    classes = np.empty(256, np.int32)
    for b in range(256):
        char = chr(b).lower()
        if b >= 128:
            classes[b] = 30 + b - 128
        elif "a" <= char <= "z":
            classes[b] = 4 + ord(char) - ord("a")
        else:
            classes[b] = 1 if char.isspace() else 2 if char.isdigit() else 3
    return classes


_CLASS = _byte_classes()
N_CLASSES = 30 + 128
_LETTER = (np.arange(N_CLASSES) >= 4).astype(np.float32)


@dataclass
class Network:
    """``filters[w]`` has a row of weights for each place and byte class; the row of padding stays zero."""

    languages: list[str]
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width: (width, classes, filters)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def tables(self) -> dict[int, tuple[np.ndarray, ...]]:
        """Answers of neighbouring byte pairs, and of a last single byte."""
        found = {}
        for width, w in self.filters.items():
            pairs = [(w[i][:, None] + w[i + 1][None]).reshape(-1, w.shape[2]) for i in range(0, width - 1, 2)]
            found[width] = (*pairs, *([w[width - 1]] if width % 2 else []))
        return found

    def answers(self, codes: np.ndarray, tables: dict[int, tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        """(windows, places, filters) for each width."""
        pairs = codes[:, :-1] * N_CLASSES + codes[:, 1:]
        places = codes.shape[1] - max(WIDTHS) + 1
        found = []
        for width in WIDTHS:
            total = None
            for k, t in enumerate(tables[width]):
                at = (codes if len(t) == N_CLASSES else pairs)[:, 2 * k : 2 * k + places]
                part = t.take(at, axis=0, mode="clip")
                total = part if total is None else np.add(total, part, out=total)
            found.append(total)
        return found

    def probabilities(self, codes: np.ndarray, tables: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
        out = np.empty((len(codes), len(self.languages)), np.float32)
        for a in range(0, len(codes), _CHUNK):
            pooled = np.concatenate([_top(x) for x in self.answers(codes[a : a + _CHUNK], tables)], axis=1)
            out[a : a + _CHUNK] = _softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)
        return out


def _top(x: np.ndarray) -> np.ndarray:
    """Maximum over the middle axis, by halves."""
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        upper = np.maximum(x[:, :half], x[:, half : 2 * half])
        if x.shape[1] % 2:
            upper[:, 0] = np.maximum(upper[:, 0], x[:, -1])
        x = upper
    return x[:, 0]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def window_places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and length of all windows of the texts that lie between the offsets."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, offsets[:-1][text] + number * WINDOW, np.minimum(sizes[text] - number * WINDOW, WINDOW)


def window_codes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Byte classes of windows, each followed by the padding that the widest filter needs."""
    codes = np.zeros((len(start), WINDOW + max(WIDTHS) - 1), np.int32)
    at = np.arange(WINDOW)
    codes[:, :WINDOW] = _CLASS[data[np.minimum(start[:, None] + at, len(data) - 1)]]
    codes[:, :WINDOW][at >= length[:, None]] = 0
    return codes


# --- training -------------------------------------------------------------------------


def train(windows: list[bytes], labels: list[str], epochs: int = 8, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit by Adam on mini-batches; languages weigh the same whatever their number of windows."""
    languages = sorted(set(labels))
    net = Network(languages)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (w, N_CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
    for p in params:
        p[:, 0] = 0
    n_features = FILTERS * len(WIDTHS)
    params += [
        np.zeros(n_features, np.float32),
        rng.normal(0, 0.1, (n_features, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    ]
    net.filters = dict(zip(WIDTHS, params))
    net.bias, net.out, net.out_bias = params[len(WIDTHS) :]
    if len(languages) < 2:
        return net
    offsets = np.append(0, np.cumsum([len(w) for w in windows]))
    text, start, length = window_places(offsets)
    codes = window_codes(np.frombuffer(b"".join(windows), np.uint8), start, length)
    target = np.searchsorted(languages, labels)[text]
    weight = (len(target) / len(languages) / np.bincount(target, minlength=len(languages))).astype(np.float32)
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for a in range(0, len(order), 128):
            own = order[a : a + 128]
            step += 1
            for p, g, m, v in zip(params, _gradients(net, codes[own], target[own], weight), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            for w in net.filters.values():
                w[:, 0] = 0
    return net


def _gradients(net: Network, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    rows = np.arange(len(codes))
    answers = net.answers(codes, net.tables())
    places = [x.argmax(axis=1) for x in answers]
    pooled = np.concatenate([np.take_along_axis(x, p[:, None], 1)[:, 0] for x, p in zip(answers, places)], axis=1) + net.bias
    active = np.maximum(pooled, 0)
    error = _softmax(active @ net.out + net.out_bias)
    error[rows, target] -= 1
    error *= (weight[target] / len(codes))[:, None]
    back = (error @ net.out.T) * (pooled > 0)
    found = []
    for k, width in enumerate(WIDTHS):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        g = np.empty((width, N_CLASSES, FILTERS), np.float32)
        for i in range(width):
            seen = codes[rows[:, None], places[k] + i] * FILTERS + np.arange(FILTERS)
            g[i] = np.bincount(seen.ravel(), own.ravel(), N_CLASSES * FILTERS).reshape(N_CLASSES, FILTERS)
        found.append(g)
    return [*found, back.sum(axis=0), active.T @ error, error.sum(axis=0)]


def fit(
    docs: DataFrame, docs_per_language: int = 800, windows_per_doc: int = 3,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_languages: int = MOST_LANGUAGES,
) -> Network:
    """Train on labelled rows: those with a text, a language and a document id.

    The sample is bounded by ``docs_per_language`` documents of each language, chosen by a hash
    of their id, with ``windows_per_doc`` windows each, at places chosen by a hash; only
    windows come to the driver. Of more than ``most_languages`` languages, those with the most documents are learnt.
    """
    own = docs.select(
        F.col(doc_id).cast("string").alias("d"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")
    ).filter("d is not null and l is not null and t rlike '\\\\p{L}'")
    counts = {r["l"]: r["n"] for r in own.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(most_languages).collect()}
    if not counts:
        return Network([])
    shares = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, docs_per_language / n))])
    drawn = F.pmod(F.xxhash64("d", F.lit(1)), F.lit(1_000_000)) / 1_000_000
    places = F.transform(
        F.sequence(F.lit(1), F.lit(windows_per_doc)),
        lambda k: F.pmod(F.xxhash64("d", k), F.greatest(F.length("t") - WINDOW, F.lit(0)) + 1).cast("int") + 1,
    )
    sample = own.filter(drawn < shares[F.col("l")]).select(
        "d", "l", F.array_distinct(F.transform(places, lambda p: F.substring("t", p, F.lit(WINDOW // 2)))).alias("w")
    )
    rows = sorted((r["d"], r["l"], w) for r in sample.collect() for w in r["w"] if w)
    return train([w.encode("utf-8")[:WINDOW] for _, _, w in rows], [l for _, l, _ in rows])


# --- prediction -----------------------------------------------------------------------


def _predict_part(batches: Batches, net: Network, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    tables = net.tables()
    for batch in batches:
        texts = batch.column(0)
        pred = np.full(batch.num_rows, -1)
        score = np.zeros(batch.num_rows)
        if net.languages and batch.num_rows:
            plain = texts.cast(pa.large_binary())
            offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
            body = plain.buffers()[2]
            data = np.frombuffer(body if body is not None else b"", np.uint8)
            windows = window_places(offsets)
            mean = np.zeros((batch.num_rows, len(net.languages)))
            total = np.zeros(batch.num_rows)
            for a in range(0, len(windows[0]), _HELD):
                text, start, length = (x[a : a + _HELD] for x in windows)
                codes = window_codes(data, start, length)
                weight = _LETTER[codes].sum(axis=1) + 1e-3
                total += np.bincount(text, weight, batch.num_rows)
                for k, p in enumerate(net.probabilities(codes, tables).T):
                    mean[:, k] += np.bincount(text, p * weight, batch.num_rows)
            mean /= np.maximum(total, 1e-9)[:, None]
            lettered = np.asarray(batch.column(1).to_pylist(), bool)
            pred = np.where(lettered, mean.argmax(axis=1), -1)
            score = np.where(lettered, mean.max(axis=1), 0.0).clip(0, 1)
        names = [UNKNOWN if p < 0 else net.languages[p] for p in pred.tolist()]
        yield record_batch(schema, [*batch.columns[2:], names, score])


def predict(docs: DataFrame, net: Network, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, then ``lang_pred`` and ``score`` of each whole text.

    A text that is null or has no letter is ``und`` with score 0, as is any text if the
    network has learnt no language. Equal texts get equal answers; an empty table gives an empty one.
    Columns are chosen by ``keep``; others may have any name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = numbered(docs)
    kept = own.select(*[place(docs, c) for c in keep])
    words = whole_text(place(docs, text))
    lettered = own.select(words.alias("text"), words.rlike("\\p{L}").alias("lettered"), *kept.columns)
    arrow = pa.schema([*to_arrow_schema(kept.schema), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])
    columns = ", ".join(filter(None, [ddl(kept), "lang_pred string, score double"]))
    return map_arrow(lettered, _predict_part, columns, net, arrow).toDF(*keep, "lang_pred", "score")


def keep_known(
    docs: DataFrame, net: Network, text: str = "text", lang: str = "lang", languages: tuple[str, ...] | None = None, least_score: float = 0.0,
) -> DataFrame:
    """The rows of ``docs`` whose language the network can tell, with their columns; a null ``lang`` gets that language.

    ``languages`` keeps only rows predicted as one of these, ``least_score`` only those with that score or more. By default
    neither rejects a row, so all rows whose text has a letter stay; so they do if the network has learnt no
    language, and then null languages stay null. A table without the column ``lang`` is fine.
    """
    own = numbered(docs)
    if not net.languages:
        return own.filter(whole_text(place(docs, text)).rlike("\\p{L}")).toDF(*docs.columns)
    found = predict(own, net, own.columns, place(docs, text)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    if languages is not None:
        found = found.filter(F.col("lang_pred").isin(*languages))
    if lang in docs.columns:
        where = place(docs, lang)
        found = found.withColumn(where, F.coalesce(F.col(where), F.col("lang_pred")))
    return found.select(*own.columns).toDF(*docs.columns)


def is_held_out(doc_id: str = "doc_id"):
    """Documents that the network must not learn from: crc32 of the id as text leaves 1 by 3; null ids are not among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from the labelled ones that are not held out."""
    documents = table(spark, sf_dir, "documents")
    net = fit(documents.filter(~is_held_out()))
    return predict(documents, net, ["doc_id"]).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
