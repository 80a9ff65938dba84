"""Latent semantic similarity of texts within a group: chunks, weighted terms, singular vectors, mean vectors.

A group is what is compared: the two documents of a pair, or a document's sections and a posting. Each document is chunked
and tokenised once, in the JVM, before it meets others; a group's row holds its words. Tasks count a document's terms once
for the groups in which it is met in a row, take a group's products from the two sides' counts, and singular vectors from
products, of many groups at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counts import bounded_batches
from .language import chunk_arrays
from .terms import content_text

MOST, OVERLAP = 512, 64
#: A task forgets the words and counts it keeps beyond so many words or weights, and takes singular vectors beyond so many products.
KEPT = 1 << 20
#: The number of no term, above all others.
NONE = np.array([np.iinfo(np.int64).max])


class Counted:
    """The chunks of a side: its terms' numbers, sorted, the last one of no text, a row of 1 + ln(tf) for each chunk, and how many have each term."""

    def __init__(self, chunks: Sequence[np.ndarray]):
        every, sizes = np.concatenate([NONE, *chunks]), [len(c) for c in chunks]
        order = np.argsort(every)
        terms = every[order]
        new = np.append(True, terms[1:] != terms[:-1])
        at = np.empty(len(every), np.int64)
        at[order] = np.cumsum(new) - 1
        self.terms = terms[new]
        shape = len(chunks), len(self.terms)
        n = np.bincount(np.repeat(np.arange(len(chunks)), sizes) * shape[1] + at[1:], minlength=shape[0] * shape[1]).reshape(shape)
        some = n > 0
        self.df = some.sum(0)
        self.weights = np.log(n, out=np.full(shape, -1.0), where=some) + 1


@lru_cache(maxsize=1024)
def _squared_idf(n: int) -> np.ndarray:
    """(ln((1 + n) / (1 + df)) + 1) squared, by df."""
    return (np.log((1 + n) / (1 + np.arange(n + 1))) + 1) ** 2


def products(left: Counted, right: Counted) -> tuple[np.ndarray, int]:
    """Products of all chunks of both sides, as rows of length 1 of 1 + ln(tf) times ln((1 + n) / (1 + df)) + 1; and the number of terms."""
    a, b = left.weights, right.weights
    n, here = len(a) + len(b), len(a)
    at = np.searchsorted(left.terms, right.terms)
    met = (left.terms[at] == right.terms) & (right.terms < NONE)
    at = at[met]
    of_left, of_right = left.df.copy(), right.df.copy()
    of_left[at] += right.df[met]
    of_right[met] = of_left[at]
    idf = _squared_idf(n)
    weighted = a * idf[of_left]
    out = np.empty((n, n))
    out[:here, :here] = weighted @ a.T
    out[:here, here:] = weighted[:, at] @ b[:, met].T
    out[here:, :here] = out[:here, here:].T
    out[here:, here:] = (b * idf[of_right]) @ b.T
    size = np.sqrt(out.diagonal())
    size[size == 0] = 1
    out /= size
    out /= size[:, None]
    return out, len(left.terms) + len(right.terms) - len(at) - 2


def rank(n: int, terms: int) -> int:
    """How many singular vectors are kept of so many chunks and terms."""
    if n < 2 or terms < 2:
        return n
    most = min(192, max(16, n // 2))
    return max(2, min(max(8, min(most, n - 1)), terms - 1, n - 1))


def vectors(grams: np.ndarray, k: int) -> np.ndarray:
    """Each chunk in the space of the k largest singular vectors, as a row of length 1 (zeros for a chunk without terms), for each group's products."""
    values, found = np.linalg.eigh(grams)  # as many as chunks, whatever the number of terms
    out = found[:, :, ::-1][:, :, :k] * np.sqrt(values[:, None, ::-1][:, :, :k].clip(0))
    size = np.linalg.norm(out, axis=2, keepdims=True)
    some = (size > 1e-12) & (np.diagonal(grams, axis1=1, axis2=2)[:, :, None] > 0)
    return np.divide(out, size, out=np.zeros_like(out), where=some)


def latent(chunks: list[list[str]]) -> np.ndarray:
    """vectors() of one group, of chunks that are lists of terms."""
    number = {t: i for i, t in enumerate(sorted({t for c in chunks for t in c}))}
    gram, terms = products(Counted([np.array([number[t] for t in c], np.int64) for c in chunks]), Counted([]))
    return vectors(gram[None], rank(len(chunks), terms))[0]


def text_similarities(grams: np.ndarray, k: int, sizes: tuple[int, ...]) -> np.ndarray:
    """For each group's products: cosines of each text's vector but the last with the last one's. A text's vector is the mean of its chunks'; sizes counts them."""
    texts = np.zeros((len(sizes), sum(sizes)))
    for row, end, n in zip(texts, np.cumsum(sizes), sizes, strict=True):
        row[end - n : end] = 1 / max(n, 1)
    means = texts @ vectors(grams, k)
    size = np.linalg.norm(means, axis=2, keepdims=True)
    means = np.divide(means, size, out=np.zeros_like(means), where=size > 0)
    return np.round((means[:, :-1] @ means[:, -1, :, None])[:, :, 0].clip(0, 1), 6)


class _Sides(dict):
    """The counts of sides met last, by their words: a chunk is closed by a newline, a text by a form feed. Terms are words, and two in a row."""

    def __init__(self):
        super().__init__()
        self.words: defaultdict[str, int] = defaultdict(lambda: len(self.words))
        self.held = 0

    def __missing__(self, side: str) -> tuple[Counted, tuple[int, ...]]:
        texts = [t.split("\n")[:-1] for t in side.split("\f")[:-1]]
        counted = Counted([self._terms(c) for t in texts for c in t])
        self.held += counted.weights.size + len(counted.df)
        self[side] = counted, tuple(map(len, texts))
        return self[side]

    def _terms(self, chunk: str) -> np.ndarray:
        listed = chunk.split()
        ids = np.fromiter(map(self.words.__getitem__, listed), np.int64, len(listed))
        return np.concatenate([ids, (ids[:-1] + 1 << 32) + ids[1:]])

    def trimmed(self) -> None:
        """Forgets all if that is much; numbers of words hold between two calls."""
        if self.held > KEPT or len(self.words) > KEPT:
            self.clear()
            self.words.clear()
            self.held = 0


def _batch_similarities(sides: _Sides, lefts: list[str], rights: list[str]) -> list[np.ndarray]:
    """Groups of one shape go through each step together, a bounded number of products at a time."""
    out: list = [None] * len(lefts)
    waiting: dict[tuple, list] = defaultdict(list)
    held = 0

    def done() -> None:
        for (k, sizes), found in waiting.items():
            for (i, _), row in zip(found, text_similarities(np.stack([g for _, g in found]), k, sizes), strict=True):
                out[i] = row
        waiting.clear()

    for i, (l, r) in enumerate(zip(lefts, rights, strict=True)):  # noqa: E741
        sides.trimmed()
        (left, left_sizes), (right, right_sizes) = sides[l], sides[r]
        gram, terms = products(left, right)
        waiting[rank(len(gram), terms), left_sizes + right_sizes].append((i, gram))
        held += gram.size
        if held > KEPT:
            done()
            held = 0
    done()
    return out


def _lists(sides: _Sides, lefts: pa.Array, rights: pa.Array) -> pa.Array:
    found = _batch_similarities(sides, lefts.to_pylist(), rights.to_pylist())
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate([np.zeros(0), *found]))


def similarities_of(left: Column, right: Column) -> Column:
    """similarities of similarities(), in the row of a pair."""

    @F.arrow_udf("array<double>")
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sides = _Sides()
        for lefts, rights in batches:
            yield _lists(sides, lefts, rights)

    return found(left, right)


def words_of(text: Column) -> Column:
    """The content words of a text's chunks between blanks, each chunk closed by a newline and the whole by a form feed. No word has either."""
    chunks = F.transform(chunk_arrays(text, MOST, OVERLAP), lambda c: F.concat(content_text(c["chunk"]), F.lit("\n")))
    return F.concat(F.coalesce(F.array_join(chunks, ""), F.lit("")), F.lit("\f"))


def similarities(groups: DataFrame) -> DataFrame:
    """groups has left, words_of() texts, one after the other, and right, those of one text; they give way to similarities: the cosine of each left text with the right one, from 0 to 1.

    Texts without content terms, and null ones, have 0. Groups of one left side are best met in a row, so that its terms are counted once.
    """
    bounded_batches(groups.sparkSession)
    others = [c for c in groups.columns if c not in ("left", "right")]
    kinds = dict(groups.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _Sides()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*map(b.column, others), _lists(sides, b.column("left"), b.column("right"))], [*others, "similarities"])

    return groups.mapInArrow(work, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "similarities array<double>"]))


def _joined(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of pairs with the words of both sides; a merge join by the left side, as that leaves its rows sorted, and is met last, as its words are the longer."""
    rights = right.select(F.col("doc_id").alias("right_id"), words_of(F.col("text")).alias("right"))
    return pairs.join(rights, "right_id").join(left.hint("merge"), "left_id")


def pair_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pair_id, similarity of the pair's texts; equal texts have 1."""
    lefts = left.select(F.col("doc_id").alias("left_id"), words_of(F.col("text")).alias("left"))
    found = similarities(_joined(pairs, lefts, right).select("pair_id", "left", "right"))
    return found.select("pair_id", F.col("similarities")[0].alias("similarity"))


def section_similarity(pairs: DataFrame, sections: DataFrame, right: DataFrame) -> DataFrame:
    """pair_id, name, similarity of each section of the left (doc_id, name, text) with the whole text of the right, in one space for each pair."""
    words = sections.where("text <> ''").select(F.col("doc_id").alias("left_id"), "name", "text", words_of(F.col("text")).alias("words"))
    lists = words.groupBy("left_id").agg(F.array_sort(F.collect_list(F.struct("name", "text", "words"))).alias("s"))
    lists = lists.select("left_id", F.col("s.name").alias("names"), F.array_join("s.words", "").alias("left"))
    found = similarities(_joined(pairs, lists, right).select("pair_id", "names", "left", "right"))
    each = F.arrays_zip(F.col("names").alias("name"), F.col("similarities").alias("similarity"))
    return found.select("pair_id", F.inline_outer(each)).toDF("pair_id", "name", "similarity")
