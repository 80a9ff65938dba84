"""Pairwise similarities of a table of vectors, by blocked matrix products.

Vectors are packed into blocks of up to BLOCK_BYTES; each two blocks are one matrix product in one task, which serves the rows of both and gives
back only the entries from a threshold on, or the k best of each row. All pairs never are rows, and no task holds more than two blocks. A block is
sent once for each block, so what is sent grows with the square of the rows over a block's size: large tables have large blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block at least and at most, blocks that a table gives at least (if it has the rows), and bytes of a block at most.
BLOCK, MOST, LEAST_BLOCKS, BLOCK_BYTES = 2048, 1 << 15, 8, 1 << 24


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, rows: int | None) -> tuple[DataFrame, int]:
    """block, ids, and unit vectors as packed doubles; vectors without length, null or not finite are left out."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null").where(finite)
    count, widest = kept.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    fitting = max(1, min(MOST, BLOCK_BYTES // (8 * max(widest, 1))))
    n = max(1, -(-count // (rows or min(fitting, max(BLOCK, -(-count // LEAST_BLOCKS))))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, pdf["v"]))
        x = np.zeros((len(pdf), width))
        for i, v in enumerate(pdf["v"]):
            x[i, : len(v)] = v
        top = np.abs(x).max(1, keepdims=True, initial=0)
        x = np.divide(x, top, out=np.zeros_like(x), where=top > 0)  # squares of very large or small numbers stay finite
        size = np.linalg.norm(x, axis=1)
        x, ids = x[size > 0] / size[size > 0, None], pdf["id"].to_numpy(np.int64)[size > 0]
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "ids": [ids.tobytes()], "x": [x.tobytes()], "width": [width]})

    dealt = kept.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInPandas(pack, "block int, ids binary, x binary, width int"), n


def _read(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["x"]).reshape(len(ids), row["width"]) if len(ids) else np.zeros((0, row["width"]))


def _product(threshold: float | None, k: int | None):
    """The entries of one product of blocks: from the threshold on with left_id < right_id, or of each row of both blocks the k best others."""

    def best(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the k-th of some maxima of stretches is no more than the k-th of all, so few entries are left to be told apart
        width = scores.shape[1]
        stretch = max(1, min(64, width // (4 * k)))
        maxima = np.maximum.reduceat(scores, np.arange(0, width, stretch), axis=1)
        least = np.partition(maxima, -k, axis=1)[:, -k] if maxima.shape[1] >= k else np.full(len(scores), -1.0)
        return np.nonzero(scores >= np.maximum(least - 2e-9, -1.0)[:, None])

    def nearest_of(ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray) -> list[pd.DataFrame]:
        out = []
        for at in range(0, len(ids), 256):
            mine = ids[at : at + 256]
            scores = (a[at : at + 256] @ b.T).clip(-1, 1)
            scores[mine[:, None] == b_ids[None]] = -2
            i, j = best(scores)
            order = np.lexsort((b_ids[j], -np.round(scores[i, j], 9), i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[first], j[first]
            out.append(pd.DataFrame({"left_id": mine[i], "right_id": b_ids[j], "cosine": scores[i, j]}))
        return out

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"left_id": np.zeros(0, np.int64), "right_id": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        same = left["block"].iloc[0] == right["block"].iloc[0]
        (a_ids, a), (b_ids, b) = _read(left.iloc[0]), _read(right.iloc[0])
        if not len(a_ids) or not len(b_ids):
            return none
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
        if k is not None:
            return pd.concat([none, *nearest_of(a_ids, a, b_ids, b), *([] if same else nearest_of(b_ids, b, a_ids, a))])
        out = [none]
        for at in range(0, len(a_ids), 256):
            cosine = (a[at : at + 256] @ b.T).clip(-1, 1)
            i, j = np.nonzero(cosine >= threshold)
            x, y, c = a_ids[at + i], b_ids[j], cosine[i, j]
            kept = x < y if same else x != y
            x, y, c = x[kept], y[kept], c[kept]
            out.append(pd.DataFrame({"left_id": np.minimum(x, y), "right_id": np.maximum(x, y), "cosine": c}))
        return pd.concat(out)

    return product


def _met(blocks: DataFrame, n: int, work) -> DataFrame:
    """Each two blocks once, each block with itself included."""
    to = lambda a, b, name: F.explode(F.sequence(a, b)).alias(name)
    block = F.col("block")
    left = blocks.select(block.alias("i"), to(block, F.lit(n - 1), "j"), "block", "ids", "x", "width")
    right = blocks.select(to(F.lit(0), block, "i"), block.alias("j"), *[F.col(c).alias(c) for c in ("block", "ids", "x", "width")])  # columns of its own, as both sides are one table
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(work, "left_id long, right_id long, cosine double")


def pairs_above(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """left_id, right_id (the larger id), cosine: all pairs of rows whose cosine is at least the threshold.

    Equal vectors have 1. Vectors that are null, of no length, or hold null or non-finite numbers take no part; numbers that a
    shorter vector lacks are 0. Rows that repeat an id aren't paired with each other.
    """
    blocks, n = _blocks(vectors, id_col, vector_col, block_rows)
    return _met(blocks, n, _product(threshold, None))


def nearest(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """left_id, rank, right_id, cosine: of each row the k rows of the highest cosine, ties (to 9 places) to the smaller id. Rows as in pairs_above()."""
    blocks, n = _blocks(vectors, id_col, vector_col, block_rows)
    found = _met(blocks, n, _product(None, k))
    best = Window.partitionBy("left_id").orderBy(F.round("cosine", 9).desc(), "right_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("left_id", "rank", "right_id", "cosine")
