"""A quality classifier: a small convolutional network over the bytes of a text, in numpy.

Bytes become vectors; filters run over windows of ``KERNEL`` bytes, one every
``STRIDE``; their answers are averaged in chunks of two blocks, each chunk
sharing a block with the next, so that the chunks overlap and cover the whole
text. A second layer reads each chunk; its answers are max-pooled over all
chunks of the document, and one unit makes a probability of them.

The network is fitted on the driver, on a sample of labelled rows that is
bounded in rows (``MAX_ROWS``) and in bytes per row (``MAX_BYTES``), chosen by
a hash of the id: the same whatever else the tables hold. Only the text and
the label of these rows are used. Scoring takes whole texts, a slice at a
time, in the partitions where they are.

Defined results: a null text is scored as an empty one. Labels that are null
are left out; of several labels for an id the lowest counts; several texts of a
labelled id all count. Arithmetic is in single precision: beyond six digits a
score may depend on the texts scored beside it. Without two classes in the sample the network stays as
it was initialised, and scores follow the sample's share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import flat

MAX_ROWS = 3000
MAX_BYTES = 20_000
KERNEL, STRIDE, BLOCK = 8, 4, 128
VECTOR, FILTERS, UNITS = 4, 24, 16
STEPS, BATCH, RATE = 1000, 24, 0.004
_WINDOWS = BLOCK // STRIDE
_SLICE = 2**19


@dataclass
class Batch:
    """Documents padded to whole blocks: bytes, windows that start in a text and end in its own blocks, and each document's first block."""

    data: np.ndarray
    valid: np.ndarray  # (blocks, windows of a block)
    first: np.ndarray  # one more than there are documents


def padded(data: np.ndarray, bounds: np.ndarray) -> Batch:
    lengths = np.diff(bounds)
    blocks = np.maximum(-(-lengths // BLOCK), 1)
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * BLOCK + KERNEL, np.uint8)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(owner)) - bounds[owner] + first[owner] * BLOCK] = data
    window = np.arange(first[-1] * _WINDOWS).reshape(-1, _WINDOWS) * STRIDE
    begin = np.repeat(first[:-1] * BLOCK, blocks)[:, None]
    end = np.repeat(first[1:] * BLOCK, blocks)[:, None]
    # The window at the very end would reach into the next document; the one before it holds its bytes too.
    valid = (window - begin < np.maximum(np.repeat(lengths, blocks)[:, None], 1)) & (window + KERNEL <= end)
    return Batch(out, valid, first)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.weights = {
            "bytes": rng.standard_normal((256, VECTOR)).astype(np.float32),
            "filters": normal(KERNEL * VECTOR, FILTERS),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "units": normal(FILTERS, UNITS),
            "unit_bias": np.full(UNITS, 0.1, np.float32),
            "out": normal(UNITS),
            "bias": np.zeros(1, np.float32),
        }

    def forward(self, batch: Batch) -> tuple[np.ndarray, dict]:
        """The logit of each document, and what a step back needs."""
        w = self.weights
        vectors = w["bytes"][batch.data]
        n = batch.valid.size
        step = vectors.strides[0]
        windows = np.lib.stride_tricks.as_strided(vectors, (n, KERNEL * VECTOR), (STRIDE * step, vectors.itemsize))
        hits = np.maximum(windows @ w["filters"] + w["filter_bias"], 0).reshape(*batch.valid.shape, FILTERS)
        weight = batch.valid.astype(np.float32)
        sums = np.einsum("bwf,bw->bf", hits, weight, optimize=True)
        counts = weight.sum(axis=1)
        # A chunk is a block and the next one of the same document.
        paired = np.ones(len(sums), bool)
        paired[batch.first[1:] - 1] = False
        next_ = np.flatnonzero(paired) + 1
        chunk, size = sums.copy(), counts.copy()
        chunk[paired] += sums[next_]
        size[paired] += counts[next_]
        size = np.maximum(size, 1)
        mean = chunk / size[:, None]
        units = np.maximum(mean @ w["units"] + w["unit_bias"], 0)
        pooled = np.maximum.reduceat(units, batch.first[:-1], axis=0)
        logits = pooled @ w["out"] + w["bias"][0]
        return logits, {"windows": windows, "hits": hits, "weight": weight, "paired": paired, "size": size, "mean": mean, "units": units, "pooled": pooled}

    def gradients(self, batch: Batch, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        w = self.weights
        logits, s = self.forward(batch)
        slope = ((1 / (1 + np.exp(-logits))) - labels).astype(np.float32) / len(labels)
        blocks = np.diff(batch.first)
        d_pooled = slope[:, None] * w["out"]
        best = s["units"] == np.repeat(s["pooled"], blocks, axis=0)
        ties = np.add.reduceat(best.astype(np.float32), batch.first[:-1], axis=0)
        d_units = best * np.repeat(d_pooled / ties, blocks, axis=0) * (s["units"] > 0)
        d_chunk = (d_units @ w["units"].T) / s["size"][:, None]
        d_sums = d_chunk.copy()
        d_sums[np.flatnonzero(s["paired"]) + 1] += d_chunk[s["paired"]]
        d_hits = (d_sums[:, None, :] * s["weight"][:, :, None] * (s["hits"] > 0)).reshape(-1, FILTERS)
        d_windows = (d_hits @ w["filters"].T).reshape(-1, KERNEL, VECTOR)
        d_bytes = np.zeros_like(w["bytes"])
        starts = np.arange(len(d_windows)) * STRIDE
        for k in range(KERNEL):
            at = batch.data[starts + k]
            for v in range(VECTOR):
                d_bytes[:, v] += np.bincount(at, d_windows[:, k, v], 256)
        return {
            "bytes": d_bytes, "filters": s["windows"].T @ d_hits, "filter_bias": d_hits.sum(axis=0), "units": s["mean"].T @ d_units,
            "unit_bias": d_units.sum(axis=0), "out": s["pooled"].T @ slope, "bias": slope.sum(keepdims=True),
        }

    def scores(self, batch: Batch) -> np.ndarray:
        return 1 / (1 + np.exp(-self.forward(batch)[0].astype(np.float64)))


def fit(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = 7) -> Network:
    """The network after at least so many steps of Adam, in whole passes over the texts, in a fixed order."""
    network, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y):
        return network
    share = np.clip(y.mean(), 0.01, 0.99)
    network.weights["bias"][:] = np.log(share / (1 - share))
    if y.min() == y.max():
        return network
    raw = [np.frombuffer(text.encode(), np.uint8) for text in texts]
    first = {name: np.zeros_like(x) for name, x in network.weights.items()}
    second, step = {name: np.zeros_like(x) for name, x in network.weights.items()}, 0
    epochs = -(-steps * BATCH // len(raw))
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        rate = RATE * (1 - epoch / epochs)
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            bounds = np.concatenate([[0], np.cumsum([len(raw[i]) for i in some])])
            step += 1
            for name, slope in network.gradients(padded(np.concatenate([raw[i] for i in some]), bounds), y[some]).items():
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope**2
                network.weights[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return network


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learned: every fifth by the checksum of the id's text."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, max_rows: int, max_bytes: int) -> DataFrame:
    """At most ``max_rows`` labelled texts of at most ``max_bytes``, by the hash of their ids (text, label)."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).filter(F.octet_length("text") <= max_bytes)
    # The broadcast side is the sample of ids, bounded by max_rows.
    found = texts.join(F.broadcast(chosen), "id")
    return found.orderBy(F.xxhash64("id"), "id", "text").limit(max_rows).select("text", "label")


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES,
) -> Network:
    rows = sample(docs, labels, id_column, text_column, label_column, max_rows, max_bytes).collect()
    return fit([row["text"] for row in rows], [row["label"] for row in rows])


def score(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id of each row and the probability of label 1 (``score``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in flat.slices(batch.column(1), _SLICE):
                found = network.scores(padded(texts.data, texts.bounds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(found)], names=["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_column)
