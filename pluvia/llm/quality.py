"""Quality classifier: a byte-level convolutional network in numpy.

A text is laid out in blocks of 256 bytes (zeros behind its end); a chunk is two
neighbouring blocks, so chunks overlap by half and cover the whole text. Learned
filters of six bytes slide over the chunk byte by byte, each is max-pooled, a small
dense layer turns the pooled vector into the chunk's logit, and the mean, largest and
smallest chunk logits are combined into one probability.

Only the choice of labelled rows to fit on is bounded: at most ``max_rows`` rows, those
with the smallest hashes of their ids, as long as their texts add up to no more than
``max_bytes``; a row whose text alone is longer teaches nothing. Every byte of a chosen
row is used. Scoring reads every byte of every text; texts over ``SLICE`` bytes go alone,
and all are convolved ``PART`` blocks at a time, so memory grows by about three bytes for
each byte of the longest text.

Nulls, empty texts: a null text is the empty one, which has one chunk of zeros and so
a score. Rows with null or repeated ids are scored one by one. With no labelled rows,
or one label only, every score is that label's smoothed share. Other columns of the
input stay; one that is named like the score gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pluvia.llm.common import fold, sample_rows, table, text_of

BLOCK = 256
TAPS = 6
SLICE = 1 << 18
PART = 64


@dataclass
class Network:
    filters: np.ndarray  # TAPS x 256 x F
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    mix: np.ndarray  # weights of the mean, largest and smallest chunk logit, and 1
    constant: float | None = None

    def tables(self) -> np.ndarray:
        """pair_tables of the filters, made once for each worker; they do not travel with the network."""
        if getattr(self, "_tables", None) is None:
            self._tables = pair_tables(self.filters)
        return self._tables

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}


def blocks_of(sizes: np.ndarray) -> np.ndarray:
    """Blocks of each text: at least TAPS zeros stand behind its end."""
    return (sizes + TAPS) // BLOCK + 1


def lay_out(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, each from the start of a block; and each one's first block, with the end."""
    first = np.concatenate(([0], np.cumsum(blocks_of(sizes))))
    out = np.zeros(int(first[-1]) * BLOCK + TAPS, np.uint8)
    for i in range(len(sizes)):
        at = int(first[i]) * BLOCK
        out[at : at + sizes[i]] = data[starts[i] : starts[i] + sizes[i]]
    return out, first


def pair_tables(filters: np.ndarray) -> np.ndarray:
    """What two neighbouring bytes add to each filter's answer, for taps 0 and 1, 2 and 3, 4 and 5: half the lookups."""
    return np.stack([(filters[k][:, None] + filters[k + 1][None]).reshape(1 << 16, -1) for k in range(0, TAPS, 2)])


def pooled_blocks(net: Network, laid: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each filter's largest answer in each block, some blocks at a time."""
    n, tables = int(first[-1]), net.tables()
    pairs = laid[:-1].astype(np.uint16) << 8 | laid[1:]
    out = np.empty((n, net.filters.shape[2]), np.float32)
    blank, tail = net.filters[:, 0, :].sum(axis=0), np.zeros(n, bool)
    tail[first[1:] - 1] = True
    for b in range(0, n, PART):
        e = min(n, b + PART)
        answers = tables[0][pairs[b * BLOCK : e * BLOCK]]
        for k in (1, 2):
            answers += tables[k][pairs[b * BLOCK + 2 * k : e * BLOCK + 2 * k]]
        answers = answers.reshape(e - b, BLOCK, -1)
        answers[tail[b:e], BLOCK - TAPS + 1 :] = blank  # what follows a text counts as zeros
        out[b:e] = answers.max(axis=1)
    return out


def chunk_logits(net: Network, pooled: np.ndarray) -> np.ndarray:
    middle = np.maximum(np.maximum(pooled + net.bias, 0) @ net.hidden + net.hidden_bias, 0)
    return middle @ net.out + net.out_bias


def document_inputs(net: Network, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean, largest and smallest chunk logit of each text, and 1."""
    chunk = np.maximum(pooled, np.concatenate((pooled[1:], pooled[-1:])))
    last = first[1:] - 1
    chunk[last] = pooled[last]
    logits = chunk_logits(net, chunk)
    counted = np.ones(len(logits), bool)
    counted[last[np.diff(first) > 1]] = False  # the last block alone is no chunk, unless it is all there is
    begin = first[:-1]
    n = np.add.reduceat(counted.astype(np.float64), begin)
    mean = np.add.reduceat(np.where(counted, logits, 0.0), begin) / n
    high = np.maximum.reduceat(np.where(counted, logits, -np.inf), begin)
    low = np.minimum.reduceat(np.where(counted, logits, np.inf), begin)
    return np.stack([mean, high, low, np.ones(len(n))], axis=1)


def slices(sizes: np.ndarray, most: int = SLICE):
    """Ranges of texts of at most so many bytes together; a longer text stands alone."""
    i, ends = 0, np.cumsum(sizes)
    while i < len(sizes):
        upto = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, upto
        i = upto


def document_scores(net: Network, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if net.constant is not None:
        return np.full(len(sizes), net.constant)
    out = []
    for i, upto in slices(sizes):
        laid, first = lay_out(data, starts[i:upto], sizes[i:upto])
        out.append(document_inputs(net, pooled_blocks(net, laid, first), first))
    # the last digits depend on which texts share a slice
    return np.round(1 / (1 + np.exp(-np.clip(np.concatenate(out) @ net.mix, -30, 30))), 6)


def arrow_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, with the start and size of each text."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def fit(laid: np.ndarray, first: np.ndarray, labels: np.ndarray, filters: int = 32, dense: int = 24, epochs: int = 4, seed: int = 7) -> Network:
    """Learns from all chunks of the texts that lay_out() gives, in random order."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net = Network(rng.normal(0, 0.3, (TAPS, 256, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.25, (filters, dense)).astype(np.float32), np.zeros(dense, np.float32), rng.normal(0, 0.3, dense).astype(np.float32), 0.0, np.array([1.0, 0, 0, 0]))
    if len(np.unique(labels)) < 2:
        net.constant = float(share)
        return net
    blocks = np.diff(first)
    owner = np.repeat(np.arange(len(labels)), np.maximum(1, blocks - 1))
    begin = np.cumsum(np.maximum(1, blocks - 1)) - np.maximum(1, blocks - 1)
    chunk = first[owner] + np.arange(len(owner)) - begin[owner]
    left = (first[owner + 1] - chunk) * BLOCK  # bytes to the end of the text's blocks
    y = labels[owner].astype(np.float32)
    # each document weighs the same, each class half
    weight = (1.0 / np.bincount(owner, minlength=len(labels)))[owner]
    for label in (0, 1):
        weight[y == label] *= 0.5 / max(weight[y == label].sum(), 1e-9)
    weight = (weight / weight.mean()).astype(np.float32)
    params = ["filters", "bias", "hidden", "hidden_bias", "out"]
    moment = {k: np.zeros_like(getattr(net, k)) for k in params}
    spread = {k: np.zeros_like(getattr(net, k)) for k in params}
    padded = np.concatenate((laid, np.zeros(2 * BLOCK, np.uint8)))
    span, batch, step = np.arange(2 * BLOCK + TAPS), 64, 0
    for epoch in range(epochs):
        order = rng.permutation(len(owner))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for b in range(0, len(order), batch):
            some = order[b : b + batch]
            x, t, w = padded[chunk[some][:, None] * BLOCK + span], y[some], weight[some]
            x[span[None] >= left[some][:, None]] = 0  # nothing of the next text
            answers = sum(net.filters[k][x[:, k : k + 2 * BLOCK]] for k in range(TAPS))
            where = answers.argmax(axis=1)
            pooled = np.take_along_axis(answers, where[:, None], axis=1)[:, 0]
            a = np.maximum(pooled + net.bias, 0)
            h = np.maximum(a @ net.hidden + net.hidden_bias, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -30, 30)))
            d = (w * (p - t) / len(t)).astype(np.float32)
            dh = d[:, None] * net.out * (h > 0)
            da = dh @ net.hidden.T * (a > 0)
            grads = {"out": h.T @ d, "hidden": a.T @ dh, "hidden_bias": dh.sum(0), "bias": da.sum(0), "filters": np.zeros_like(net.filters)}
            rows, cols = np.arange(len(t))[:, None], np.broadcast_to(np.arange(pooled.shape[1]), where.shape)
            for k in range(TAPS):
                np.add.at(grads["filters"][k], (x[rows, where + k], cols), da)
            step += 1
            for k in params:
                moment[k] += 0.1 * (grads[k] - moment[k])
                spread[k] += 0.01 * (grads[k] ** 2 - spread[k])
                scale = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                setattr(net, k, (getattr(net, k) - scale * moment[k] / (np.sqrt(spread[k]) + 1e-7)).astype(np.float32))
            net.out_bias -= rate * float(d.sum())
    return net


def calibrate(net: Network, inputs: np.ndarray, labels: np.ndarray, rounds: int = 30) -> None:
    """Logistic regression of the labels on the chunk logits' mean, largest and smallest."""
    mix = np.array([0.3, 0.0, 0.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(inputs @ mix, -30, 30)))
        ridge = 0.05 * np.diag([1, 1, 1, 0.01])
        mix += np.linalg.solve((inputs * (p * (1 - p))[:, None]).T @ inputs + ridge, inputs.T @ (labels - p) - ridge @ mix)
    net.mix = mix


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, max_rows: int = 4000, max_bytes: int = 6 << 20) -> Network:
    """Fits on at most max_rows labelled rows that keep admits (a Column on doc_id), of at most max_bytes of text together; whole texts."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = sample_rows((rows.where(keep) if keep is not None else rows).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct(), max_rows, "doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # all rows of an id count as one: a row for each labelled id comes to the driver
    sizes = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label").agg(F.sum(F.octet_length("text") + BLOCK).alias("size"), F.first(F.xxhash64("doc_id", "label")).alias("h"))
    chosen, used = [], 0
    for r in sorted(sizes.collect(), key=lambda r: (r["h"], r["doc_id"], r["label"])):
        if used + r["size"] <= max_bytes:
            chosen.append((r["doc_id"], r["label"]))
            used += r["size"]
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    got = sorted((r["doc_id"], r["label"], r["text"]) for r in texts.join(F.broadcast(picked), "doc_id").collect())  # max_bytes bounds this
    texts, y = [t.encode() for *_, t in got], np.array([y for _, y, _ in got], float)
    sizes = np.array([len(t) for t in texts], np.int64)
    laid, first = lay_out(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    net = fit(laid, first, y)
    if net.constant is None:
        calibrate(net, document_inputs(net, pooled_blocks(net, laid, first), first), y)
    return net


def batch_scores(net: Network, batch: pa.RecordBatch, at: int) -> np.ndarray:
    data, starts, sizes = arrow_texts(pc.fill_null(batch.column(at), ""))
    return document_scores(net, data, starts, sizes) if len(sizes) else np.zeros(0)


def score(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """docs with a probability of label 1 for every whole text; all other columns stay."""
    docs = docs.drop(column)
    given = docs.sparkSession.sparkContext.broadcast(net)  # about 0.2 MB, whatever the input
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(batch_scores(given.value, batch, at), pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def keep(docs: DataFrame, net: Network, least: float = 0.3) -> DataFrame:
    """The rows of docs whose texts score least or more, as they are."""
    given, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(given.value, batch, at) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    net = train(docs, labels, keep=~fold("doc_id", 5, 0))
    return score(docs, net).select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
