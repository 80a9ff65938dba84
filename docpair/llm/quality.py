"""Quality by a byte-level convolutional network in numpy.

Filters look at WIDTH bytes each; a filter's response is a sum of table entries, one for each byte in its view. A
document is covered whole by chunks of CHUNK bytes that overlap by one SEGMENT; responses are max-pooled within each chunk, and
a chunk's maxima are pooled over the document by maximum and by mean; one logistic unit makes a probability of these.

The network is fitted on the driver by gradient descent on at most 2 * `sample` labelled documents of at most `most_bytes`
bytes each (`sample` of either label, first in the order of a hash of their ids), weighted to the labels' true shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

WIDTH, FILTERS, SEGMENT, SPAN, STEP = 6, 12, 128, 4, 3
CHUNK = SEGMENT * SPAN
BATCH = 1 << 19


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    base: float


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another in whole segments, with WIDTH zeros at least behind each; the first segment of each."""
    n = [-(-(len(t) + WIDTH) // SEGMENT) for t in texts]
    first = np.concatenate(([0], np.cumsum(n)))
    buffer = b"".join(t + bytes(k * SEGMENT - len(t)) for t, k in zip(texts, n, strict=True))
    return np.frombuffer(buffer + bytes(WIDTH), np.uint8), first


def _responses(data: np.ndarray, net: Network, last: np.ndarray) -> np.ndarray:
    """Of each segment, place and filter. last: the segments that end a text; views that reach behind these are all zeros."""
    size = len(data) - WIDTH
    total, zeros = net.tables[0].take(data[:size], 0), net.tables[0][0].copy()
    for j in range(1, WIDTH):
        total += net.tables[j].take(data[j : size + j], 0)
        zeros += net.tables[j][0]
    total = total.reshape(-1, SEGMENT, FILTERS)
    total[last, SEGMENT - WIDTH + 1 :] = zeros
    return total


def _pooled(maxima: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each document the maximum and the mean of its chunks' maxima; the chunks' first and last segments."""
    counts = np.diff(first)
    chunks = np.maximum(1, -(-(counts - SPAN) // STEP) + 1)
    start = np.concatenate([first[i] + STEP * np.arange(c) for i, c in enumerate(chunks)])
    end = np.minimum(start + SPAN, np.repeat(first[1:], chunks))
    bounds = np.column_stack([start, end]).ravel()
    padded = np.concatenate([maxima, maxima[:1]])  # so that an end may be the last place
    by_chunk = np.maximum.reduceat(padded, bounds, 0)[::2]
    at = np.concatenate(([0], np.cumsum(chunks)))[:-1]
    return np.maximum.reduceat(by_chunk, at, 0), np.add.reduceat(by_chunk, at, 0) / chunks[:, None], start, end


def probabilities(texts: list[bytes], net: Network) -> np.ndarray:
    """The score of each text, whole; texts are worked on a few segments at a time, so memory doesn't grow with them."""
    if not texts:
        return np.zeros(0)
    data, first = _laid_out(texts)
    maxima = np.empty((first[-1], FILTERS), np.float32)
    for s in range(0, len(maxima), BATCH // SEGMENT):
        e = min(len(maxima), s + BATCH // SEGMENT)
        last = first[1:] - 1 - s
        maxima[s:e] = _responses(data[s * SEGMENT : e * SEGMENT + WIDTH], net, last[(last >= 0) & (last < e - s)]).max(1)
    top, mean, *_ = _pooled(np.maximum(maxima + net.bias, 0), first)
    return 1 / (1 + np.exp(-np.clip(np.hstack([top, mean]) @ net.out + net.base, -30, 30)))


def fit(texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = 10, seed: int = 5) -> Network:
    """Adam on the weighted logistic loss."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    share = float((weight * y).sum() / max(weight.sum(), 1e-9)) if len(y) else 0.5
    net.base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if len(set(y.tolist())) < 2:
        net.out[:] = 0
        return net
    params = [net.tables, net.bias, net.out, np.array([net.base], np.float32)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            net.base = float(params[3][0])
            data, first = _laid_out([texts[i] for i in some])
            raw = _responses(data, net, first[1:] - 1)
            where = raw.argmax(1)
            high = np.take_along_axis(raw, where[:, None], 1)[:, 0] + net.bias
            maxima = np.maximum(high, 0)
            top, mean, start, end = _pooled(maxima, first)
            x = np.hstack([top, mean])
            p = 1 / (1 + np.exp(-np.clip(x @ net.out + net.base, -30, 30)))
            g = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)
            back = g[:, None] * net.out[None]
            down = np.zeros_like(maxima)
            doc = np.repeat(np.arange(len(some)), np.diff(first))
            best = maxima == top[doc]
            down += best * back[doc, :FILTERS] / np.maximum(1, np.add.reduceat(best, first[:-1], 0))[doc]
            chunk_doc = np.searchsorted(first, start, "right") - 1
            chunks = np.bincount(chunk_doc, minlength=len(some))
            share_of = back[:, FILTERS:] / chunks[:, None]
            for k in range(SPAN):  # the chunk's highest segment gets its share
                seg = np.minimum(start + k, end - 1)
                fresh = start + k < end
                peak = np.maximum.reduce([maxima[np.minimum(start + i, end - 1)] for i in range(SPAN)])
                np.add.at(down, seg[fresh], ((maxima[seg] == peak) * share_of[chunk_doc])[fresh])
            down *= high > 0
            grad_tables = np.zeros_like(net.tables)
            seg, f = np.nonzero(down)
            place = seg * SEGMENT + where[seg, f]
            for j in range(WIDTH):
                np.add.at(grad_tables[j], (data[place + j], f), down[seg, f])
            grads = [grad_tables, down.sum(0), x.T @ g + 1e-4 * net.out, np.array([g.sum()], np.float32)]
            t += 1
            rate = 0.02 * (0.5 if epoch >= epochs // 2 else 1) * (0.4 if epoch >= epochs - 2 else 1)
            for i, (param, grad) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.99 * v[i] + 0.01 * grad**2
                param -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    net.base = float(params[3][0])
    return net


def learn(docs: DataFrame, labels: DataFrame, sample: int = 1000, most_bytes: int = 16_384, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Fits a network on at most `sample` labelled documents of either label, of at most `most_bytes` bytes each.

    Null labels, null ids and labels without a document don't count. A repeated row, of labels or of documents, counts as
    often as it is there. Null texts are empty. Other columns don't matter. Without documents of both labels every score
    is the share of label 1 among the labels.
    """
    order = F.xxhash64(F.lit(11), F.col(id_col))
    rows = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__lid"), F.col(label_col).cast("int").alias("y"), order.alias("__order"))
    shares = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        some = rows.where(F.col("y") == y).orderBy("__order", "__lid").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    known = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(picked), F.col("__id") == F.col("__lid")).where(F.octet_length("t") <= most_bytes)
    got = known.select("t", "y", "__order", "__id").toPandas().sort_values(["__order", "__id"])
    y = got["y"].to_numpy(np.float32)
    here = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    total = max(1, sum(shares.values()))
    weight = np.where(y == 1, shares.get(1, 0) / here[1], shares.get(0, 0) / here[0]) * len(y) / total
    return fit([t.encode() for t in got["t"]], y, weight.astype(np.float32))


def with_quality(docs: DataFrame, net: Network, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Adds score (double, 0 to 1) and predicted (int, 1 from the threshold on); columns of these names are replaced.

    Null texts score as empty ones, which are one chunk of zeros. Equal texts score alike; repeated rows stay. Texts are
    read whole, a few segments at a time. Other columns pass through. An empty table stays so.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out, held, size = [], [], 0
            for t in texts:
                held.append((t or "").encode())
                size += len(held[-1])
                if size >= BATCH:
                    out.append(probabilities(held, net))
                    held, size = [], 0
            yield pd.Series(np.concatenate([*out, probabilities(held, net)]), dtype="float64")

    out = docs.withColumn("score", score(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
