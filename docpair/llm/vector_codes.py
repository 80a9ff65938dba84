"""Vector compression by codes: each of a vector's parts becomes the index of an entry of that part's codebook.

Codebooks are refined in rounds. The search for a part's nearest entry goes by pivots: distances of every part to a few
fixed pivots are computed once and written beside the numbers. In a round, pivot-to-entry distances are known (they are
few), and the difference of both is a lower bound on the part's distance to the entry. Entries are taken in the order of
their bounds and evaluated in integers, until the next bound is above the best distance found. Bounds are rounded down, so
results are exact.

The numbers are written once and read by each round; a task returns sums and counts for each entry, and the driver holds
the codebooks only: parts * entries rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, discarded, stored

PIVOTS, SALT = 4, 32
#: What bounds are lowered by, relatively; roots and their 32-bit forms are nearer than that.
SLACK = 1e-6
#: Numbers below it, and sums of a batch's, are exact in 64 bits; larger ones are Python's integers.
SAFE = 1 << 26
LIMIT = 2**63 - 1


def finite(vector: Column) -> Column:
    """Whether a vector is not null and holds finite components only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _numbers(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Equal lists of integers, or of their decimal strings, as rows of an array."""
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    if pa.types.is_string(flat.type):
        return np.array([int(x) for x in flat.to_pylist()] or [], object).reshape(-1, width)
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis, exact."""
    diff = a - b
    return (diff * diff).sum(-1)


def _doubles(squares: np.ndarray) -> np.ndarray:
    """As doubles; infinite beyond these."""
    return np.array([float(x) if x < 1 << 1000 else math.inf for x in squares]) if squares.dtype == object else squares.astype(np.float64)


def _roots(squares: np.ndarray) -> np.ndarray:
    """Distances as doubles, with a relative error far below SLACK; infinite beyond doubles."""
    return np.sqrt(_doubles(squares.ravel())).reshape(squares.shape)


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (ties to the lower) and the squared distance.

    parts: n x d, to_pivots: n x p distances of the parts, entries: k x d, pivots: p x d.
    """
    of_entries = _roots(_squares(entries[:, None], pivots[None]))  # k x p
    bounds = np.zeros((len(parts), len(entries)))
    for p in range(len(pivots)):
        a, b = to_pivots[:, p, None].astype(np.float64), of_entries[None, :, p]
        with np.errstate(invalid="ignore"):
            gap = np.abs(a - b) - SLACK * (a + b)
        np.maximum(bounds, np.where(np.isfinite(gap), gap, 0), out=bounds)
    bounds *= bounds
    order = np.argsort(bounds, 1, kind="stable")
    at = order[:, 0]
    best = _squares(parts, entries[at])
    active = np.arange(len(parts))
    for k in range(1, len(entries)):
        nth = order[active, k]
        active, nth = (x[bounds[active, nth] * (1 - SLACK) <= _doubles(best[active])] for x in (active, nth))
        if not len(active):
            break
        found = _squares(parts[active], entries[nth])
        better = (found < best[active]) | ((found == best[active]) & (nth < at[active]))
        at[active[better]], best[active[better]] = nth[better], found[better]
    return at, best


class _Rows:
    """The written rows: of a batch, the numbers by part and the parts' distances to the pivots."""

    def __init__(self, width: int, parts: int, pivots: np.ndarray):
        self.width, self.parts, self.pivots = width, parts, pivots

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        numbers = _numbers(batch.column("numbers"), self.width).reshape(batch.num_rows, self.parts, -1)
        far = batch.column("far").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, self.parts, -1)
        return ((part, np.ascontiguousarray(numbers[:, part]), far[:, part]) for part in range(self.parts))


def _start(rows: DataFrame, entries: int, parts: int, width: int, scale: int) -> np.ndarray:
    """parts x entries x d: the parts of the rows with the smallest ids; null ids come last, equal ids by their vectors."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    numbers = np.array([_floors(r["vector"], scale, width) for r in first], object)
    return numbers.reshape(len(first), parts, -1).transpose(1, 0, 2)


def _floors(vector: list[float], scale: int, width: int) -> list[int]:
    """floor(scale * x) of each component, exact; zeros for those that a shorter vector lacks."""
    whole = [math.floor(x * scale) if abs(x) < 1e15 else int(x) * scale for x in vector]
    return whole + [0] * (width - len(whole))


def _pivots(start: np.ndarray, most: int) -> np.ndarray:
    """parts x p x d: of each part's first entries, ones far from each other."""
    chosen = []
    for entries in start:
        at, far = [0], _squares(entries, entries[:1])
        while len(at) < min(most, len(entries)):
            at.append(int(np.argmax(far)))
            far = np.minimum(far, _squares(entries, entries[at[-1:]]))
        chosen.append(entries[at])
    return np.array(chosen)


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, list]:
    """Returns the rows id_col, label_col, indexes (array<int>), error (long), and the codebooks: parts lists of entries, each a list of integers.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors of other lengths than the
    longest, or whose length the parts don't divide, are filled up with zeros. A row with a null id is coded like others, but
    comes last among the codebooks' first entries; rows that repeat an id are rows of their own, there in the order of
    their vectors. With fewer rows than entries there are fewer entries. Errors beyond a long are set to the largest.
    Labels may be null. Other columns are left out, whatever their names. An empty table gives no rows and no entries.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(finite(F.col("vector")))
    longest, largest = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()
    names = {c: dict(vectors.dtypes)[c] for c in (id_col, label_col)}
    if longest is None:
        empty = vectors.limit(0).select(id_col, label_col, F.array().cast("array<int>").alias("indexes"), F.lit(0).cast("long").alias("error"))
        return empty, [[] for _ in range(parts)]
    width = parts * max(1, -(-longest // parts))
    kind = np.int64 if (largest or 0) * scale < SAFE and width < 1 << 8 else object
    books = _start(rows, entries, parts, width, scale).astype(kind)
    pivots = _pivots(books, PIVOTS)
    layout = _Rows(width, parts, pivots)

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            if kind is object or pc.min_max(pc.list_value_length(lists))["min"].as_py() != width:
                numbers = np.array([_floors(v, scale, width) for v in lists.to_pylist()], object).astype(kind).reshape(batch.num_rows, width)
            else:
                numbers = np.floor(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * scale).astype(np.int64)
            cut = numbers.reshape(batch.num_rows, parts, 1, -1)
            far = _roots(_squares(cut, pivots[None])).clip(max=3e38).astype(np.float32)
            far[far >= 3e38] = np.inf
            flat = pa.array(numbers.ravel() if kind is np.int64 else [str(x) for x in numbers.ravel()], pa.int32() if kind is np.int64 else pa.string())
            ends = np.arange(batch.num_rows + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.ListArray.from_arrays(ends * width, flat), pa.ListArray.from_arrays(ends * (far.size // batch.num_rows), pa.array(far.ravel()))],
                ["id", "label", "numbers", "far"],
            )

    kinds = f"id {names[id_col]}, label {names[label_col]}"
    table, path = stored(rows.mapInArrow(prepared, f"{kinds}, numbers array<{'int' if kind is np.int64 else 'string'}>, far array<float>"))

    def summed(books: np.ndarray):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for part, numbers, far in layout.read(batch):
                    at, _ = nearest(numbers, far, books[part], pivots[part])
                    here = np.zeros(books.shape[1:], kind)
                    np.add.at(here, at, numbers)
                    total[part] += here
                    count[part] += np.bincount(at, minlength=books.shape[1])
            held = np.argwhere(count > 0)
            out = [[int(p) for p, _ in held], [int(e) for _, e in held], [int(count[p, e]) for p, e in held], [[str(x) for x in total[p, e]] for p, e in held]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())), strict=True)], ["part", "entry", "n", "sums"])

        return sums

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = [str(sum(map(int, x))) for x in zip(*pdf["sums"], strict=True)]
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "entry": pdf["entry"].iloc[:1], "n": [int(pdf["n"].sum())], "sums": [sums]})

    fields = "part int, entry int, n long, sums array<string>"
    for _ in range(rounds):
        new = books.copy()
        for r in table.mapInArrow(summed(books), fields).groupBy("part", "entry").applyInPandas(added, fields).collect():  # at most parts * entries rows
            new[r["part"], r["entry"]] = [int(x) // r["n"] for x in r["sums"]]
        books = new

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(numbers, far, books[part], pivots[part]) for part, numbers, far in layout.read(batch)]
            error = [min(LIMIT, int(x)) for x in sum(d for _, d in found)]
            indexes = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * parts, pa.array(np.column_stack([at for at, _ in found]).astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), indexes, pa.array(error, pa.int64())], ["id", "label", "indexes", "error"])

    codes, _ = stored(table.mapInArrow(coded, f"{kinds}, indexes array<int>, error long"))
    discarded(spark, path)
    return codes.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "indexes", "error"), [[[int(x) for x in e] for e in part] for part in books]


def with_label_error(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """Adds label_error (long): errors summed over equal labels, null ones together; beyond a long, the largest.

    Partial sums come first; a label's sum meets its rows in SALT portions, as a label may hold a third of all rows.
    """
    sums = codes.groupBy(F.col(label_col).alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LIMIT)).cast("long").alias("label_error"))
    sums = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = codes.withColumn("__portion", F.pmod(F.xxhash64(*codes.columns), F.lit(SALT)).cast("int"))
    return salted.join(sums, F.col(label_col).eqNullSafe(F.col("__label")) & (F.col("__portion") == F.col("__salt"))).drop("__label", "__salt", "__portion")


def digest(codebooks: list) -> str:
    """SHA-256 of all entries' components in decimals, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in codebooks for entry in part for x in entry).encode()).hexdigest()
