"""Byte-level BPE, encoding and decoding.

A text is cut at special tokens, then into words by the vocabulary's pattern. A word's merges are driven by a segment
tree over the ranks of adjacent pairs, with WIDE children to a node: the root is the leftmost pair of the lowest rank;
a merge updates the leaves beside it, each in logarithmic time, until no pair can be merged. Words repeat, so each
task keeps the ids of up to twice CACHED words it has met last.

A word is a run of letters, digits, blanks or signs, so a very long text may be one word: it takes about 250 bytes of
memory a byte and time n log n, and is not kept.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Fixed value: the word pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same words where a text is ASCII.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
CACHED, WIDE = 120_000, 16
NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """The ids of words, as bytes; those met since the last CACHED others are kept, and once more found again."""

    def __init__(self, merged):
        super().__init__()
        self.merged, self.older = merged, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.merged(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """The vocabulary in a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.first = [ids[c] for c in letters]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((ids[a], ids[b]), rank)
            self.made.append(ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words, self.ascii_words = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.cache = _Words(self.merged)

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word."""
        first, rank_of, made = self.first, self.ranks.get, self.made
        ids = [first[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        # a leaf is the pair's rank, then its place, as one number
        leaves = [NONE if (rank := rank_of(pair)) is None else rank * n + i for i, pair in enumerate(zip(ids, ids[1:]))]  # noqa: B905
        levels = [leaves]
        while len(levels[-1]) > WIDE:
            below = levels[-1]
            levels.append([min(below[k : k + WIDE]) for k in range(0, len(below), WIDE)])
        top, deep = levels[-1], len(levels) > 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := min(top)) < NONE:
            rank, i = divmod(best, n)
            j = after[i]
            k = after[j]
            new = ids[i] = made[rank]
            ids[j] = -1
            after[i] = k
            h = before[i]
            if k < n:
                before[k] = i
                leaves[j] = NONE
                rank = rank_of((new, ids[k]))
                leaves[i] = NONE if rank is None else rank * n + i
            else:
                leaves[i] = NONE
            if h >= 0:
                rank = rank_of((ids[h], new))
                leaves[h] = NONE if rank is None else rank * n + h
            if deep:
                changed = {h, i, j} if h >= 0 else {i, j}
                for below, above in zip(levels, levels[1:]):  # noqa: B905
                    changed = {at // WIDE for at in changed if at < len(below)}
                    for at in changed:
                        above[at] = min(below[at * WIDE : at * WIDE + WIDE])
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        ids_of = self.cache.__getitem__
        words = (self.ascii_words if text.isascii() else self.words).findall
        if not self.marks:
            return b"".join(map(ids_of, words(text)))
        parts = self.marks.split(text)  # every second part is a special token
        return b"".join(array("I", [self.special[part]]).tobytes() if odd else b"".join(map(ids_of, words(part))) for at, part in enumerate(parts) for odd in (at % 2,))


class Decoder:
    """The bytes of each id of the vocabulary in a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        known = {i: bytes(to_byte[c] for c in token) for token, i in spec["model"]["vocab"].items() if all(c in to_byte for c in token)}
        known |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes = [known.get(i) for i in range(max(known) + 1)]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit) and n_tokens (long) to docs; columns of these names are replaced.

    A null or empty text has no ids. path is the vocabulary file, at the same place on every executor.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def ids_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = Bpe(path)  # for the task: workers live on, and shouldn't keep it
        for texts in parts:
            yield pd.Series([bpe.encode(t or "") for t in texts], dtype=object)

    return docs.withColumn("ids", ids_of(F.col(text_col))).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (string) to a table with ids; null ids decode to an empty string."""
    bounded_batches(encoded.sparkSession)

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(path)
        for ids in parts:
            yield pd.Series([decoder.decode(x or b"") for x in ids], dtype=object)

    return encoded.withColumn("decoded", text_of(F.col(ids_col)))


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass of one Python worker: adds ids, n_tokens and decoded; columns of these names are replaced."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("ids binary, decoded string")
    def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe, decoder = Bpe(path), Decoder(path)
        for texts in parts:
            ids = [bpe.encode(t or "") for t in texts]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([decoder.decode(x) for x in ids], dtype=object)})

    out = docs.withColumn("__both", both(F.col(text_col)))
    return out.withColumns({"ids": F.col("__both.ids"), "n_tokens": (F.octet_length("__both.ids") / 4).cast("long"), "decoded": F.col("__both.decoded")}).drop("__both")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded, in one pass.

    The ids and the decoded text stay in the worker, so that only digests leave it. Null and empty texts, repeated rows
    and other columns: as in encode().
    """
    bounded_batches(docs.sparkSession)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, decoder = Bpe(path), Decoder(path)
        for pdf in batches:
            ids = [bpe.encode(t or "") for t in pdf["__text"]]
            yield pd.DataFrame({
                id_col: pdf["__id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(decoder.decode(x).encode()).hexdigest() for x in ids],
            })

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInPandas(digests, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
