"""Quality classifier: a convolutional network over bytes, in numpy.

Filters look at a few bytes each; what a filter gives at a place is a sum of learned numbers, one
per byte and place in the window, so a convolution is a few table lookups per byte. Texts are
covered by overlapping chunks from first to last byte. In each chunk the filters are max-pooled;
mean, smallest and largest of that over the chunks, and how short the text is (a short one has little for
a filter to find), make one probability for the document.

The network is fitted on the driver on a bounded sample of whole documents (``PER_CLASS`` a class, together at most
``SAMPLE_BYTES``), from the very chunks that scoring pools. Scoring is a narrow pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled, words
from .frames import free_names, stored

WIDTH, FILTERS = 5, 16
#: Chunks are two halves long and begin at every half.
HALF = 256
PER_CLASS, EPOCHS = 1500, 25
#: Bytes of the sample's texts; documents beyond it are left out of the sample, whole.
SAMPLE_BYTES = 64 << 20
#: Scales, in bytes, of the inputs that tell how short a text is.
LENGTHS = (24, 64, 256)


def shortness(sizes: np.ndarray) -> np.ndarray:
    """(text, LENGTHS): near 1 for texts that are short on each of a few scales."""
    return np.exp(-np.asarray(sizes, np.float32)[:, None] / np.float32(LENGTHS))


@dataclass
class Halves:
    """Texts laid out in halves of chunks, each text from a half of its own on.

    ``inside`` tells the places that belong to a text from padding, by its length. A text of several halves has
    a chunk less than halves: its last half is in the chunk before. ``starts`` and ``count`` are each text's chunks.
    """

    padded: np.ndarray
    inside: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Halves:
        sizes = np.diff(offsets)
        halves = -(-(sizes + WIDTH) // HALF)  # room for the last window, so none sees the next text
        first = np.concatenate([[0], np.cumsum(halves)])
        padded = np.zeros(first[-1] * HALF + WIDTH, np.uint8)
        inside = np.zeros(first[-1] * HALF, bool)
        for a, n, at in zip(offsets[:-1], sizes, first[:-1] * HALF):
            padded[at : at + n] = data[a : a + n]
            inside[at : at + n] = True
        count = np.maximum(halves - 1, 1)
        return cls(padded, inside, first, np.concatenate([[0], np.cumsum(count)])[:-1], count)

    def chunks(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, filter): the larger value of each chunk's halves, and the number of the half that has it."""
        last = np.zeros(len(top), bool)
        last[self.first[1:] - 1] = True
        half = np.arange(len(top))[:, None] + np.zeros(top.shape[1], np.int64)
        chunk = top.copy()
        second = top[1:] > top[:-1]
        second[last[:-1]] = False
        chunk[:-1][second] = top[1:][second]
        half[:-1][second] += 1
        keep = ~(last & np.repeat(np.diff(self.first) > 1, np.diff(self.first)))
        return chunk[keep], half[keep]


@dataclass
class Network:
    """``tables`` (width, byte, filter), ``shift`` (filter), ``head`` (3 x filter and lengths), ``bias``."""

    tables: np.ndarray
    shift: np.ndarray
    head: np.ndarray
    bias: float

    def responses(self, data: np.ndarray, n: int) -> np.ndarray:
        """The filters at the first n places; ``data`` has WIDTH - 1 bytes more."""
        data = data.astype(np.intp)
        out = self.tables[0].take(data[:n], axis=0)
        more = np.empty_like(out)
        for j in range(1, WIDTH):
            self.tables[j].take(data[j : n + j], axis=0, out=more, mode="clip")
            out += more
        return out

    def tops(self, padded: np.ndarray, inside: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(half, filter): the largest response in each half before ``shift``; with ``places`` also where it is."""
        count = len(inside) // HALF
        top = np.empty((count, FILTERS), np.float32)
        place = np.empty((count, FILTERS), np.int64) if places else None
        step = 64  # halves at a time, which keeps the numbers in the processor's cache
        for at in range(0, count, step):
            n = min(step, count - at) * HALF
            some = self.responses(padded[at * HALF : at * HALF + n + WIDTH], n)
            some[~inside[at * HALF : at * HALF + n]] = -np.inf
            some = some.reshape(-1, HALF, FILTERS)
            if places:
                place[at : at + n // HALF] = found = some.argmax(axis=1)
                top[at : at + n // HALF] = np.take_along_axis(some, found[:, None], axis=1)[:, 0]
            else:
                top[at : at + n // HALF] = some.max(axis=1)
        return top, place

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, 3 x filter) of texts that lie in ``data`` one behind the other."""
        own = Halves.of(data, offsets)
        top, _ = self.tops(own.padded, own.inside)
        chunk, _ = own.chunks(np.maximum(top + self.shift, 0))
        mean = np.add.reduceat(chunk, own.starts) / own.count[:, None]
        low, high = np.minimum.reduceat(chunk, own.starts), np.maximum.reduceat(chunk, own.starts)
        return np.concatenate([mean, low, high, shortness(np.diff(offsets))], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.pooled(data, offsets) @ self.head + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _sampled(docs: DataFrame, labels: DataFrame, label: str, text: str) -> list:
    """(doc_id, text, label, weight) of the sample, in order of doc_id; bounded in rows and in bytes."""
    picked = stored(labelled.sample(docs, labels, label, PER_CLASS, text), "labelled-sample")
    sizes = picked.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).collect()  # bounded
    held, room = [], SAMPLE_BYTES
    for r in sorted(sizes, key=lambda r: words.mixed(np.array([r["doc_id"]]).astype(np.uint64))[0]):
        if r["n"] <= room:
            room -= r["n"]
            held.append(r["doc_id"])
    fits = picked if len(held) == len(sizes) else picked.where(F.col("doc_id").isin(held))
    return sorted(fits.collect(), key=lambda r: r["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", seed: int = 4) -> Network:
    """A network for P(label = 1). Without labels of both classes it gives the known share, or one half."""
    return fit_rows(_sampled(docs, labels, label, text), seed)


def fit_rows(rows: list, seed: int = 4) -> Network:
    """The same from rows with text, label and weight."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.05, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 3 * FILTERS + len(LENGTHS)).astype(np.float32),
        0.0,
    )
    target = np.array([r["label"] for r in rows], np.float32)
    if len(set(target.tolist())) < 2:
        net.head[:] = 0
        net.bias = float(np.log((target.sum() + 1) / (len(target) - target.sum() + 1)))
        return net
    weight = np.array([r["weight"] for r in rows], np.float32)
    weight /= weight.mean()
    texts = [np.frombuffer((r["text"] or "").encode(), np.uint8) for r in rows]
    for f in range(FILTERS):  # each filter starts from bytes that occur
        some = texts[rng.integers(len(texts))]
        if len(some) >= WIDTH:
            at = rng.integers(0, len(some) - WIDTH + 1)
            net.tables[np.arange(WIDTH), some[at : at + WIDTH], f] += 0.3
    params = [net.tables, net.shift, net.head]
    bias = np.zeros(1, np.float32)
    params.append(bias)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            grads = gradients(net, bias, [texts[i] for i in pick], target[pick], weight[pick])
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net.bias = float(bias[0])
    return net


def gradients(net: Network, bias: np.ndarray, texts: list[np.ndarray], target: np.ndarray, weight: np.ndarray) -> list:
    """Of the weighted cross entropy over a few whole texts, for tables, shift, head and bias."""
    sizes = np.array([len(t) for t in texts])
    own = Halves.of(np.concatenate(texts), np.concatenate([[0], np.cumsum(sizes)]))
    raw, place = net.tops(own.padded, own.inside, places=True)
    top, half = own.chunks(raw + net.shift)
    h = np.maximum(top, 0)
    mean = np.add.reduceat(h, own.starts) / own.count[:, None]
    low, high = np.minimum.reduceat(h, own.starts), np.maximum.reduceat(h, own.starts)
    pooled = np.concatenate([mean, low, high, shortness(sizes)], axis=1)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.head + bias[0], -30, 30)))
    dz = (p - target) * weight / len(texts)
    du = pooled.T @ dz + 1e-4 * net.head
    doc = np.repeat(np.arange(len(texts)), own.count)
    a, b, c = np.split(net.head[: 3 * FILTERS], 3)
    dh = a * (dz / own.count)[doc][:, None]
    every = np.arange(FILTERS)
    for share, best in ((b, low), (c, high)):  # of chunks with the same value, the first counts
        first = np.minimum.reduceat(np.where(h == best[doc], np.arange(len(h))[:, None], len(h)), own.starts)
        dh[first, every] += share * dz[:, None]
    dh = (dh * (top > 0)).astype(np.float32)
    used, column = np.nonzero(dh)  # most chunks of a long text change nothing
    value, where = dh[used, column], half[used, column]
    at = where * HALF + place[where, column]
    index = np.concatenate([(j * 256 + own.padded[at + j].astype(np.intp)) * FILTERS + column for j in range(WIDTH)])
    dt = np.bincount(index, np.tile(value, WIDTH), minlength=WIDTH * 256 * FILTERS)
    return [
        dt.reshape(WIDTH, 256, FILTERS).astype(np.float32),
        dh.sum(axis=0),
        du.astype(np.float32),
        np.array([dz.sum()], np.float32),
    ]


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Adds ``score`` DOUBLE (underscores behind it if taken): P(label = 1) of the whole text.

    A null text counts as empty; an empty one has the score of no response. All rows are kept.
    """
    (name,) = free_names(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [net.scores(data, offsets) for _, data, offsets in words.chunks(batch.column(text))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, schema)
