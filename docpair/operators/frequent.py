"""Runs of tokens that at least so many documents have, and where texts hold them, without a row for each run.

Documents are dealt into chunks. A chunk tells each bucket of hashes which runs it has, each once and sorted, in RUN_BYTES a
run; a bucket answers with a bit for each. Runs are told apart by their hashes alone: the last 56 of 64 bits and the first few (4 at least), which
are the bucket's. By estimate, 2.5e9 runs hold some 0.2 pairs of equal hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Bytes of text in a chunk, bytes of text for each bucket, and the most and least buckets (powers of two).
CHUNK, SHARE, MOST_BUCKETS, LEAST_BUCKETS = 8 << 20, 1 << 20, 1024, 16
#: Bytes of a run's hash beside its bucket.
RUN_BYTES = 7


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits stirred, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """The runs of a chunk (a table of doc_id and content, tokens between blanks, ordered by doc_id): distinct ones in the order of their hashes.

    n_docs holds the number of their documents up to `least`; at and size say where each run stands, number which it is.
    """

    def __init__(self, table: pa.Table, sizes: tuple[int, ...], least: int):
        ids = table["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.doc = np.nan_to_num(ids, nan=-1).astype(np.int64)  # rows of one id are one document; a null one counts for none
        content = table["content"].combine_chunks()
        lists = pc.split_pattern(pc.if_else(pc.equal(content, ""), None, content), " ")
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        self.starts = np.cumsum(lengths) - lengths
        coded = lists.flatten().dictionary_encode()
        self.words, self.word = np.array(coded.dictionary.to_pylist(), object), coded.indices.to_numpy()
        hashed = (pd.util.hash_array(self.words, categorize=False) if len(self.words) else np.zeros(0, np.uint64))[self.word]
        row = np.repeat(np.arange(len(lengths)), lengths)
        hashes, at = [], []
        for n in sizes:
            here = np.arange(max(len(hashed) - n + 1, 0))
            here = here[row[here] == row[here + n - 1]]
            h = np.full(len(here), n, np.uint64)
            for k in range(n):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + hashed[here + k])
            hashes.append(h), at.append(here)
        self.at, self.size = np.concatenate(at), np.repeat(np.array(sizes), [len(x) for x in at])
        h = np.concatenate(hashes)
        order = np.argsort(h)
        new = np.diff(h[order], prepend=~h[order[:1]]) != 0
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        times = np.diff(first, append=len(h))
        several = np.flatnonzero(times[group] > 1)
        inner, doc = group[several], self.doc[row[self.at[order[several]]]]
        sub = np.lexsort((doc, inner))
        inner, doc = inner[sub], doc[sub]
        counted = (doc >= 0) & ((np.diff(inner, prepend=-1) != 0) | (np.diff(doc, prepend=-2) != 0))
        n_docs = np.bincount(inner[counted], minlength=len(first))
        alone = times == 1
        n_docs[alone] = self.doc[row[self.at[order[first[alone]]]]] >= 0
        self.hashes, self.n_docs = h[order[first]], np.minimum(n_docs, least).astype(np.uint8)
        self.number = np.empty(len(h), np.int64)
        self.number[order] = group

    def parts(self, buckets: int) -> list[tuple[int, int, int]]:
        """(bucket, first, end) of each bucket with runs; a bucket has hashes with the same first bits."""
        of = (self.hashes >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)
        firsts = np.flatnonzero(np.diff(of, prepend=-1))
        return list(zip(of[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(of)], strict=True)) if len(of) else []


def _told(runs: Runs, chunk: int, buckets: int) -> pa.Table:
    parts = runs.parts(buckets)
    low = runs.hashes << np.uint64(64 - 8 * RUN_BYTES)  # without the bits that all of a bucket have
    raw = low.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :RUN_BYTES]
    return pa.table({
        "chunk": pa.array([chunk] * len(parts), pa.int32()), "bucket": pa.array([b for b, _, _ in parts], pa.int32()), "hashes": pa.array([raw[a:e].T.tobytes() for _, a, e in parts], pa.binary()),
        "n_docs": pa.array([runs.n_docs[a:e].tobytes() for _, a, e in parts], pa.binary()),
    })


def _answered(table: pa.Table, least: int) -> pa.Table:
    """For each chunk's runs of a bucket the bits of those that at least so many documents have."""
    lists, counts = [], []
    for raw, n_docs in zip(table["hashes"].to_pylist(), table["n_docs"].to_pylist(), strict=True):
        wide = np.zeros((len(n_docs), 8), np.uint8)
        wide[:, 8 - RUN_BYTES :] = np.frombuffer(raw, np.uint8).reshape(RUN_BYTES, -1).T
        lists.append(wide.view(">u8").ravel().astype(np.uint64)), counts.append(np.frombuffer(n_docs, np.uint8).astype(np.int64))
    hashes, n = np.concatenate(lists), np.concatenate(counts)
    order = np.argsort(hashes)
    first = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))
    many = np.empty(len(hashes), bool)
    many[order] = np.repeat(np.add.reduceat(n[order], first) >= least, np.diff(first, append=len(hashes)))
    ends = np.cumsum([len(x) for x in lists])
    bits = [np.packbits(many[e - len(x) : e]).tobytes() for x, e in zip(lists, ends, strict=True)]
    return pa.table({"chunk": table["chunk"].combine_chunks(), "bucket": table["bucket"].combine_chunks(), "bits": pa.array(bits, pa.binary())})


def _matched(runs: Runs, bits: pa.Table, ids: pa.Array, buckets: int) -> pa.Table:
    """doc_id, pos, n, surface of the matches of each document, the longest at each place."""
    many = np.zeros(len(runs.hashes), bool)
    given = dict(zip(bits["bucket"].to_pylist(), bits["bits"].to_pylist(), strict=True))
    for bucket, a, e in runs.parts(buckets):
        many[a:e] = np.unpackbits(np.frombuffer(given[bucket], np.uint8), count=e - a)
    hit = np.flatnonzero(many[runs.number])
    at, size = runs.at[hit], runs.size[hit]
    row = np.searchsorted(runs.starts, at, "right") - 1
    pos = at - runs.starts[row]
    doc = runs.doc[row]
    order = np.lexsort((-size, pos, doc))  # few of all runs
    kept, surface = [], lambda i: " ".join(runs.words[runs.word[at[i] : at[i] + size[i]]])
    free, last = 0, None
    for i, d, p, n in zip(order.tolist(), doc[order].tolist(), pos[order].tolist(), size[order].tolist(), strict=True):
        if d != last:
            last, free = d, 0
        if p >= free:
            free = p + n
            kept.append(i)
        elif p + n == free and n == size[kept[-1]] and row[i] != row[kept[-1]] and surface(i) < surface(kept[-1]):
            kept[-1] = i  # texts of one id: of two runs at one place, the first by name
    chosen = np.array(kept, np.int64)
    rows, places, ns, surfaces = row[chosen], pos[chosen] + 1, size[chosen], [surface(i) for i in kept]
    return pa.table({"doc_id": ids.take(pa.array(rows, pa.int64())), "pos": pa.array(places, pa.int32()), "n": pa.array(ns, pa.int32()), "surface": pa.array(surfaces, pa.string())})


def frequent_matches(docs: DataFrame, sizes: tuple[int, ...] = (2, 3), least_docs: int = 3, chunk_bytes: int = CHUNK) -> DataFrame:
    """language.longest_matches() with the runs that at least so many documents have as the dictionary. Reads the sizes of texts when called."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = total // chunk_bytes + 1
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (total // SHARE).bit_length()))
    kind = dict(docs.dtypes)["doc_id"]
    dealt = docs.where("text is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", F.array_join(tokens(F.col("text")), " ").alias("content")).repartition("chunk")
    ordered = lambda t: t.sort_by([("doc_id", "ascending"), ("content", "ascending")])  # noqa: E731  rows of a shuffle come in any order

    def tell(table: pa.Table) -> pa.Table:
        return _told(Runs(ordered(table), sizes, least_docs), table["chunk"][0].as_py(), buckets)

    def match(table: pa.Table, bits: pa.Table) -> pa.Table:
        table = ordered(table)
        return _matched(Runs(table, sizes, least_docs), bits, table["doc_id"].combine_chunks(), buckets)

    told = dealt.groupBy("chunk").applyInArrow(tell, "chunk int, bucket int, hashes binary, n_docs binary")
    answers = told.groupBy("bucket").applyInArrow(lambda t: _answered(t, least_docs), "chunk int, bucket int, bits binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(match, f"doc_id {kind}, pos int, n int, surface string")
