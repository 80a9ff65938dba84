"""Exact top-k search by integer inner product, with a uniform threshold in three phases.

A vector's dimensions are cut into slices; a score is the sum of the slices' partial scores. Query blocks meet row
blocks, each of a bounded number of rows, so no task holds more than one block of each.

1. For each query, each slice of each row block lists its k best partial scores; the lists' entries are summed, and
   the k-th best sum over all blocks is a cutoff that the k-th best score reaches at least.
2. The cutoff goes back to the blocks. Rows that no query of a strip can meet at its cutoff, by the lengths of their
   slices, aren't multiplied again. Only entries where some slice reaches cutoff / slices can reach the cutoff in all;
   of these, an entry whose upper bound (its large partial scores, and cutoff / slices for the others) is below the
   cutoff is left out.
3. What remains is scored in full, and the best k of each block, then of all blocks, are the result.

The blocks are written once, and read by both passes. Scores are summed in doubles where these are exact for the blocks
at hand, else in integers of any length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SLICES = 4
QUERY_BLOCK, ROW_BLOCK, STRIP = 2048, 4096, 256
LIMIT = 2**63 - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for vectors that are null or hold null or non-finite ones."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _packed(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """Rows (vec_id, v) in blocks: block int, ids and numbers as bytes of int64, width int; and the blocks' number, of which some may lack rows."""
    n_blocks = max(1, -(-rows.count() // block_rows))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(len(v) for v in pdf["v"])
        numbers = np.zeros((len(pdf), width), np.int64)
        for i, v in enumerate(pdf["v"]):
            numbers[i, : len(v)] = v
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "numbers": [numbers.tobytes()], "width": [width]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(pack, "block int, ids binary, numbers binary, width int"), n_blocks


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["numbers"], np.int64).reshape(len(ids), row["width"])


def _slices(queries: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same dimensions of both, in slices; as doubles if every sum is exact in them."""
    width = max(queries.shape[1], rows.shape[1], 1)
    queries, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, rows))
    top = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (queries, rows)]
    kind = np.float64 if top[0] * top[1] * width * SLICES < 2**52 else object
    return [(q.astype(kind), r.astype(kind)) for q, r in zip(np.array_split(queries, SLICES, 1), np.array_split(rows, SLICES, 1), strict=True) if q.shape[1]]


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query: highest score first, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    first = np.searchsorted(query[order], query[order])
    return order[np.arange(len(order)) - first < k]


def _search(k: int, cutoffs: bool):
    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            (query_ids, queries), (ids, rows) = _unpacked(left.iloc[0]), _unpacked(right.iloc[0])
            parts = _slices(queries, rows)
            m = len(parts)
            limits = np.full(len(query_ids), -np.inf)
            if cutoffs and left["places"].iloc[0] is not None:
                limits = limits.astype(parts[0][0].dtype) if parts[0][0].dtype != object else limits.astype(object)
                limits[np.asarray(left["places"].iloc[0])] = np.asarray(left["cutoffs"].iloc[0]).astype(limits.dtype)
            exact_parts, all_ids = parts, ids
            lengths = [[np.sqrt((x * x).sum(1)) for x in both] for both in parts] if cutoffs and parts[0][0].dtype != object else []
            for at in range(0, len(query_ids), STRIP):
                q = slice(at, at + STRIP)
                parts, ids = exact_parts, all_ids
                if lengths:  # no score exceeds the sum of the products of lengths; a little more for rounding
                    most = np.column_stack([x[q] for x, _ in lengths]) @ np.column_stack([y for _, y in lengths]).T
                    near = np.flatnonzero((most * (1 + 1e-9) >= limits[q, None]).any(0))
                    if len(near) < len(ids):
                        parts, ids = [(x, y[near]) for x, y in parts], ids[near]
                scores = [x[q] @ y.T for x, y in parts]
                other = query_ids[q, None] != ids[None, :]
                if cutoffs:
                    limit = limits[q, None]
                    enough = other & np.logical_or.reduce([s * m >= limit for s in scores])
                    bound = sum(np.maximum(s * m, limit) for s in scores)
                    a, b = np.nonzero(enough & (bound >= limit * m))
                else:
                    listed = np.zeros(other.shape, bool)
                    some = min(k + 1, len(ids))
                    for s in scores:
                        best = np.argpartition(-s, some - 1, 1)[:, :some]
                        np.put_along_axis(listed, best, True, 1)
                    a, b = np.nonzero(listed & other)
                total = sum(s[a, b] for s in scores)
                keep = _best(a, ids[b], total, k)
                a, b, total = a[keep] + at, b[keep], total[keep]
                exact = total.astype(np.int64) if total.dtype != object else np.array([max(-LIMIT, min(LIMIT, int(x))) for x in total], np.int64)
                out.append(pd.DataFrame({"query_block": key[0], "place": a, "query_id": query_ids[a], "vec_id": ids[b], "score": exact}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_block", "place", "query_id", "vec_id", "score")}).astype("int64")

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Returns query_id, rank (from 1), vec_id, score: each query row's k best other rows (all, if fewer).

    A row's own id is no candidate for it. Ties go to the smaller vec_id. Vectors that are null or hold null or
    non-finite components, and rows with a null id, take no part. Components that a shorter vector lacks count as 0.
    Repeated rows are rows of their own, which don't meet rows of the same id. Scores beyond a long are set to the nearest long. Other columns are left out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("is_query")).where("vec_id is not null and v is not null")
    queries, query_blocks = _packed(rows.where("is_query").drop("is_query"), QUERY_BLOCK)
    blocks, row_blocks = _packed(rows.drop("is_query"), ROW_BLOCK)
    queries, blocks = cut(queries), cut(blocks)
    found = "query_block int, place int, query_id long, vec_id long, score long"

    def meet(left: DataFrame, cutoffs: bool) -> DataFrame:
        left = left.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        right = blocks.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumnRenamed("block", "row_block")
        left = left.withColumnRenamed("block", "query_block")
        return left.groupBy("query_block", "row_block").cogroup(right.groupBy("query_block", "row_block")).applyInPandas(_search(k, cutoffs), found)

    best = Window.partitionBy("query_block", "place").orderBy(F.col("score").desc(), "vec_id")
    kth = meet(queries, False).withColumn("n", F.row_number().over(best)).where(F.col("n") == k)
    kth = kth.groupBy("query_block").agg(F.collect_list("place").alias("places"), F.collect_list("score").alias("cutoffs"))
    limited = queries.join(kth.withColumnRenamed("query_block", "block"), "block", "left")
    ranked = meet(limited, True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
