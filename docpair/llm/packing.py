"""Packing documents into training sequences, with a bounded number of open windows.

Each partition keeps OPEN windows. A document's full windows are sequences of their own; its rest is placed best-fit,
into the open window that it leaves with the least room. When none fits, the fullest window is filled up with the head of
the document and emitted, and what is left of the document is placed again; so no emitted window is padded. At the end a
partition hands over its open windows, at most OPEN of them whatever its size. They are laid end to end by running totals
over partitions and cut at multiples of the window, without a task that sees them all. What is left of that, less than one
window in all, is cut into powers of two, which need no padding.

Ids come from the tokenizers library. A text is cut at places where its word pattern and its normalizing cut in any case:
Latin texts into the pattern's words, which go to the library's model as they are, others at blanks and before signs that
end a word. Each task keeps the ids of up to twice CACHED words, and as many pieces, it has met last.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .shared import bounded_batches, running_total, stored

WINDOW, OPEN, CACHED = 4096, 16, 120_000
#: Characters of a text that are cut into pieces at a time.
SPAN = 1 << 20
#: A partition numbers its sequences from its own multiple of PER_PARTITION; those of leftovers begin at MERGED.
PER_PARTITION, MERGED = 1 << 33, 1 << 60


def _kept(category: str) -> str:
    return "".join(c for c in map(chr, range(0x80, 0x180)) if unicodedata.category(c)[0] == category)


#: Beyond these characters (Latin letters, usual quotes and dashes), normalizing may join characters or the classes below not hold.
OUTSIDE = re.compile("[^\x00-\u017f\u2010-\u2027\u20ac]").search
#: The words of the vocabulary's pattern where a text has no others and is in lower case.
WORDS = re.compile(rf"[a-z{_kept('L')}]+|[0-9{_kept('N')}]|'(?:re|ve|ll|[stmd])|[^ \t-\r\x85\xa0a-z{_kept('L')}0-9{_kept('N')}]+").findall
#: The letter that stands for each byte.
LETTERS = dict(enumerate(byte_letters()))
#: ASCII signs between a letter and a blank are words of their own.
ENDING = re.compile(r"([A-Za-z])([!-/:-@\[-`{-~]+)(?=[ \n]|$)")


class _Kept(dict):
    """The ids of pieces, made by a function; those met since the last CACHED others are kept, and once more found again."""

    def __init__(self, made: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.made, self.older = made, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.made(piece)
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """The ids of texts under a tokenizers JSON file whose words end at ASCII blanks, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.marked = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words, self.pieces = _Kept(self._word), _Kept(self._piece)

    def _word(self, word: str) -> bytes:
        """One word of WORDS: there's nothing to normalize or cut."""
        if not (word.isascii() and word.isprintable()):  # the bytes that stand for themselves
            word = word.encode().decode("latin-1").translate(LETTERS)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not OUTSIDE(piece) and WORDS(piece.lower()) == [piece]:
            return self._word(piece)
        return array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()

    def _part(self, text: str) -> bytes:
        if any(mark in text for mark in self.marked):  # a special token is one word, whatever its signs
            return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        if not OUTSIDE(text):
            return b"".join(map(self.words.__getitem__, WORDS(text.lower())))
        return b"".join(map(self.pieces.__getitem__, ENDING.sub(r"\1 \2", text).replace("\n", " ").split(" ")))

    def encode(self, text: str) -> bytes:
        n = len(text)
        if n <= SPAN:
            return self._part(text)
        parts, at = [], 0
        while at < n:
            to = text.find(" ", at + SPAN)
            parts.append(self._part(text[at : n if to < 0 else to]))
            at = n if to < 0 else to
        return b"".join(parts)


class Packer:
    """The open windows of one partition. add() and leftovers() give pieces: id, start, length, doc_tokens, sequence_id, offset, ids, open."""

    def __init__(self, partition: int, window: int, most_open: int):
        self.next, self.window, self.most_open = partition * PER_PARTITION, window, most_open
        self.open: list[tuple[int, int, list]] = []  # tokens held, sequence, pieces

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _placed(self, at: int | None, piece: tuple) -> list[tuple]:
        """Lays a piece into an open window, or a new one; the window's pieces if it is full now."""
        held, sequence, pieces = self.open.pop(at) if at is not None else (0, self._sequence(), [])
        doc, start, length, total, ids = piece
        pieces.append((doc, start, length, total, sequence, held, ids, False))
        if held + length == self.window:
            return pieces
        self.open.append((held + length, sequence, pieces))
        return []

    def add(self, doc, ids: bytes) -> list[tuple]:
        """Packs a document; returns the pieces of the windows that are full now."""
        total = len(ids) // 4
        piece = lambda start, length: (doc, start, length, total, ids[4 * start : 4 * (start + length)])
        full, start = [], total - total % self.window
        for at in range(0, start, self.window):
            full += self._placed(None, piece(at, self.window))
        while start < total:
            need = total - start
            fits = [(self.window - held, at) for at, (held, _, _) in enumerate(self.open) if held + need <= self.window]
            if fits:
                full += self._placed(min(fits)[1], piece(start, need))
            elif len(self.open) < self.most_open:
                full += self._placed(None, piece(start, need))
            else:
                held, at = max((held, at) for at, (held, _, _) in enumerate(self.open))
                need = self.window - held
                full += self._placed(at, piece(start, need))
            start += need
        return full

    def leftovers(self) -> list[tuple]:
        return [(*piece[:-1], True) for _, _, pieces in self.open for piece in pieces]


def _merged(left: DataFrame, id_col: str, window: int) -> DataFrame:
    """Pieces of open windows, laid end to end and cut anew."""
    ends = running_total(left, [F.col("sequence_id"), F.col("offset")], F.col("length"), "__at", "all_ids")
    wide, at, rest = F.lit(window), F.col("__at"), F.col("all_ids") % window
    to, tail = at + F.col("length"), F.col("all_ids") - rest
    span = lambda begin, end: F.struct(begin.alias("begin"), end.alias("end"))
    whole = F.transform(F.sequence(F.floor(at / wide), F.floor((to - 1) / wide)), lambda w: span(w * wide, F.least((w + 1) * wide, tail)))
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(window.bit_length())])
    powers = F.transform(F.filter(bits, lambda b: rest.bitwiseAND(b) > 0), lambda b: span(tail + rest - rest % (2 * b), tail + rest - rest % b))
    met = F.filter(F.concat(whole, powers), lambda s: (s["begin"] < F.least(s["end"], to)) & (s["end"] > at))
    cuts = ends.withColumn("__s", F.explode(met))
    begin, end = F.greatest(F.col("__s.begin"), at), F.least(F.col("__s.end"), to)
    ids = F.expr("substring(ids, cast(4 * (greatest(__s.begin, __at) - __at) + 1 as int), cast(4 * (least(__s.end, __at + length) - greatest(__s.begin, __at)) as int))")
    return cuts.select(
        id_col, (F.col("start") + begin - at).alias("start"), (end - begin).alias("length"), "doc_tokens", (F.lit(MERGED) + F.col("__s.begin")).alias("sequence_id"),
        (begin - F.col("__s.begin")).alias("offset"), ids.alias("ids"),
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 2, most_open: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns pieces of documents: id_col, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian unsigned 32-bit).

    A document's ids are its text's, then end_id; null and empty texts have just end_id. start counts the ids of the
    document before the piece, offset those of the sequence. All sequences hold `window` ids but the last few of the whole
    table, which hold powers of two; nothing is padded. Null ids and rows that repeat an id are documents of their own.
    Very long texts fill windows of their own. Which documents share a window depends on how the table is dealt into
    partitions. Other columns are left out, whatever their names. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "open"]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, packer, end = Encoder(path), Packer(TaskContext.get().partitionId(), window, most_open), np.array([end_id], "<u4").tobytes()
        frame = lambda rows: pd.DataFrame(dict(zip(names, zip(*rows), strict=True)), dtype=object)  # noqa: B905, E731
        for pdf in batches:
            rows = [piece for doc, text in zip(pdf["__id"], pdf["__text"], strict=True) for piece in packer.add(doc, encoder.encode(text or "") + end)]
            if rows:
                yield frame(rows)
        if packer.open:
            yield frame(packer.leftovers())

    pieces = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    pieces = pieces.mapInPandas(packed, f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean")
    pieces, _ = stored(pieces)
    return pieces.where("not open").drop("open").unionByName(_merged(pieces.where("open").drop("open"), id_col, window))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length, ids (binary): the sequences of pack()'s pieces, put together."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    joined = F.aggregate(listed, F.lit(b""), lambda out, x: F.concat(out, x))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
