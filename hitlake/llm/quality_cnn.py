"""Quality classifier: a byte-level convolutional network in numpy.

Each document's UTF-8 bytes, padded to whole blocks, are convolved with learned filters (width 8, every 4th byte; a
filter is one weight per place and byte value, so a convolution is a sum of table look-ups). Overlapping chunks of 512
bytes, one every 256, cover the whole document; each filter's response is max-pooled within every chunk, and the chunk
maxima are combined by their mean, maximum and minimum over the document into one probability by a logistic unit.

Training: at most `sample_docs` labelled documents (smallest hashes of doc_id; the bound is a parameter), each with its
whole text and the same pooling as in scoring. Labels are read by the caller.

Defined cases: null text = empty text, scored as one block of padding; repeated rows each give a row; a document with
several labels takes the larger one; without labels every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlake.llm.common import bounded_sample, utf8

WIDTH, STRIDE, BLOCK, PAD = 8, 4, 256, 256
SYMBOLS = 257  # bytes and the padding


@dataclass
class Network:
    tables: np.ndarray  # (WIDTH, SYMBOLS, filters)
    bias: np.ndarray  # (filters,)
    out: np.ndarray  # (3 * filters,)
    out_bias: float

    def blocks(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each block, and the place of it."""
        places = starts[:, None] + np.arange(0, BLOCK, STRIDE)
        response = self.tables[0][symbols[places]]
        for j in range(1, WIDTH):
            response += self.tables[j][symbols[places + j]]
        return response, places


def padded(data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, int]:
    """The symbols of one document, in whole blocks plus a filter's width of padding; and its number of blocks."""
    blocks = max(1, -(-(hi - lo) // BLOCK))
    symbols = np.full(blocks * BLOCK + WIDTH, PAD, np.uint16)
    symbols[: hi - lo] = data[lo:hi]
    return symbols, blocks


def pool(maxima: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Mean, maximum and minimum over each document's chunks (two neighbouring blocks; one if there is only one)."""
    ends = np.cumsum(blocks)
    begins = ends - blocks
    chunk = maxima.copy()
    inner = np.ones(len(maxima), bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    chunk[at] = np.maximum(maxima[at], maxima[at + 1])
    single = blocks == 1
    keep = inner.copy()
    keep[begins[single]] = True
    chunk = chunk[keep]
    counts = np.where(single, 1, blocks - 1)
    first = np.cumsum(counts) - counts
    mean = np.add.reduceat(chunk, first) / counts[:, None]
    return np.concatenate([mean, np.maximum.reduceat(chunk, first), np.minimum.reduceat(chunk, first)], axis=1)


def features(net: Network, data: np.ndarray, offsets: np.ndarray, slab: int = 1 << 20) -> np.ndarray:
    """Pooled responses of each document; short documents are convolved together, long ones in slabs of about `slab` bytes."""
    pooled: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, int]] = []

    def flush() -> None:
        symbols = np.concatenate([s for s, _ in waiting])
        bases = np.cumsum([0, *[len(s) for s, _ in waiting[:-1]]])
        starts = np.concatenate([base + BLOCK * np.arange(n) for base, (_, n) in zip(bases, waiting)])
        maxima = [net.blocks(symbols, starts[lo : lo + slab // BLOCK])[0].max(axis=1) for lo in range(0, len(starts), slab // BLOCK)]
        pooled.append(pool(np.concatenate(maxima), np.array([n for _, n in waiting])))
        waiting.clear()

    size = 0
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        waiting.append(padded(data, lo, hi))
        size += len(waiting[-1][0])
        if size > slab:
            flush()
            size = 0
    if waiting:
        flush()
    return np.concatenate(pooled) if pooled else np.zeros((0, len(net.out)), np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def score(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    pooled = np.maximum(features(net, data, offsets) + np.tile(net.bias, 3), 0)
    return sigmoid(pooled @ net.out + net.out_bias)


# ---------------------------------------------------------------- training


def sample_texts(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000) -> pd.DataFrame:
    """(doc_id, label, data): the whole texts, as UTF-8 bytes, of at most `sample_docs` labelled documents."""
    chosen = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = bounded_sample(chosen, sample_docs, "doc_id")
    # The sample has a fixed bound of small rows (an id and a label each), so it may be broadcast. Of repeated rows one is used.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "label", F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b"")).alias("data"))
    return rows.toPandas().sort_values("doc_id", ignore_index=True)


def peaks(net: Network, symbols: np.ndarray, starts: np.ndarray, slab: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter in each block, and where it stands."""
    values, at = [], []
    for lo in range(0, len(starts), slab // BLOCK):
        response, places = net.blocks(symbols, starts[lo : lo + slab // BLOCK])
        arg = response.argmax(axis=1)
        values.append(np.take_along_axis(response, arg[:, None], axis=1)[:, 0])
        at.append(np.take_along_axis(places, arg, axis=1))
    return np.concatenate(values), np.concatenate(at)


def gradient(net: Network, symbols: np.ndarray, starts: np.ndarray, blocks: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss of a batch: the form that `score` uses, over every chunk of every document.

    Only the place of a chunk's largest response passes gradient on to the filters: that of each chunk for the mean, that
    of the largest and of the smallest chunk for maximum and minimum.
    """
    filters = len(net.bias)
    value, place = peaks(net, symbols, starts)
    ends = np.cumsum(blocks)
    counts = np.maximum(blocks - 1, 1)
    owner = np.repeat(np.arange(len(blocks)), counts)
    left = np.concatenate([np.arange(e - n, max(e - 1, e - n + 1)) for e, n in zip(ends.tolist(), blocks.tolist())])
    right = np.where(np.repeat(blocks, counts) == 1, left, left + 1)
    later = value[right] > value[left]
    chunk, at = np.where(later, value[right], value[left]), np.where(later, place[right], place[left])
    begins = np.cumsum(counts) - counts
    pooled = np.concatenate([np.add.reduceat(chunk, begins) / counts[:, None], np.maximum.reduceat(chunk, begins), np.minimum.reduceat(chunk, begins)], axis=1)
    hidden = np.maximum(pooled + np.tile(net.bias, 3), 0)
    error = (sigmoid(hidden @ net.out + net.out_bias) - labels) / len(labels)
    back = np.where(hidden > 0, error[:, None] * net.out[None, :], 0)
    by_chunk = back[owner, :filters] / counts[owner, None]
    for third in (1, 2):
        part = slice(third * filters, (third + 1) * filters)
        same = chunk == pooled[owner, part]  # neighbouring chunks may share their largest response: they share its gradient
        by_chunk = by_chunk + back[owner, part] * same / np.add.reduceat(same, begins, dtype=np.int64)[owner]
    tables = np.empty_like(net.tables)
    column = np.broadcast_to(np.arange(filters), at.shape)
    for j in range(WIDTH):
        tables[j] = np.bincount((symbols[at + j].astype(np.int64) * filters + column).ravel(), by_chunk.ravel(), SYMBOLS * filters).reshape(SYMBOLS, filters)
    return [tables, back.reshape(len(labels), 3, filters).sum(axis=(0, 1)), hidden.T @ error + 1e-4 * net.out, np.array([error.sum()])]


def train(sample: pd.DataFrame, filters: int = 24, epochs: int = 14, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the log loss over whole texts."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, SYMBOLS, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.1, 3 * filters).astype(np.float32), 0.0)
    if not len(sample):
        return Network(net.tables, net.bias, np.zeros(3 * filters, np.float32), 0.0)
    texts = [padded(np.frombuffer(d, np.uint8), 0, len(d)) for d in sample["data"]]
    labels = sample["label"].to_numpy(float)
    params = [net.tables, net.bias, net.out, np.array([np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))], np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            blocks = np.array([texts[i][1] for i in part])
            symbols = np.concatenate([texts[i][0] for i in part])
            bases = np.cumsum([0, *[len(texts[i][0]) for i in part[:-1]]])
            starts = np.concatenate([base + BLOCK * np.arange(n) for base, n in zip(bases, blocks)])
            grads = gradient(Network(params[0], params[1], params[2], float(params[3][0])), symbols, starts, blocks, labels[part])
            step += 1
            pace = rate * (1 - 0.9 * epoch / epochs)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(params[0], params[1], params[2], float(params[3][0]))


def score_documents(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted): the network's probability of label 1 over each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # tables of a fixed size

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            data, offsets = utf8(column)
            yield pa.array(score(shared.value, data, offsets).astype(np.float64))

    scored = docs.select("doc_id", run(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
