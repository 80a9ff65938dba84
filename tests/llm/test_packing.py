"""Packing against the tokenizers library and the rules of a packed table."""

import random
import zlib

import numpy as np
import pytest
from conftest import SF

from docpair.llm import packing, queries


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_vocabulary())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def checked(pieces, want, window):
    """pieces: rows of a pack; want: the ids of each document, by its id."""
    of_doc, of_sequence = {}, {}
    for r in pieces:
        of_doc.setdefault(r["doc_id"], []).append(r)
        of_sequence.setdefault(r["sequence_id"], []).append(r)
    assert of_doc.keys() == want.keys()
    for doc, rows in of_doc.items():
        rows.sort(key=lambda r: r["start"])
        assert [i for r in rows for i in np.frombuffer(r["ids"], "<u4").tolist()] == want[doc]
        at = 0
        for r in rows:
            assert (r["start"], r["doc_tokens"], len(r["ids"])) == (at, len(want[doc]), 4 * r["length"]) and r["length"] > 0
            at += r["length"]
    for rows in of_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in rows])
        assert [r["offset"] for r in rows] == [0, *ends[:-1]] and (ends[-1] == window or (ends[-1] < window and ends[-1] & (ends[-1] - 1) == 0))
    short = [sum(r["length"] for r in rows) for rows in of_sequence.values()]
    assert len([n for n in short if n < window]) == len({n for n in short if n < window})  # at most one of each power


def test_encoder_equals_the_library(library, monkeypatch):
    rng = random.Random(4)
    bits = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "é", "É", "́", "İ", "Σ", "ß", "1", "²", "!", "'s", "'RE", "<|endoftext|>", "<|", "中", "😀", "\r\n", "\x00"]
    texts = ["", " ", "x" * 3000, *("".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(500))]
    encoder = packing.Encoder(queries.word_vocabulary())
    monkeypatch.setattr(packing, "SPAN", 16)
    monkeypatch.setattr(packing, "CACHED", 50)
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize(("window", "most_open"), [(64, 3), (4096, 16)])
def test_packing(spark, library, window, most_open):
    rng = random.Random(5)
    texts = [None, "", "one", "a b\nc", "word " * 20_000, "é" * 5000] + [" ".join(rng.choices(["red", "Green", "blue", "x1"], k=rng.randint(1, 90))) for _ in range(120)]
    rows = [(i, t, "en", 1, 2.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, offset int, ids double").repartition(5)
    pieces = packing.pack(docs, queries.word_vocabulary(), window, most_open=most_open)
    assert pieces.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    got = pieces.collect()
    checked(got, {i: ids_of(library, t) for i, t in enumerate(texts)}, window)
    whole = {r["sequence_id"]: (r["length"], r["ids"]) for r in packing.sequences(pieces).collect()}
    want: dict = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        want[r["sequence_id"]] = want.get(r["sequence_id"], b"") + bytes(r["ids"])
    assert {k: (len(v) // 4, v) for k, v in want.items()} == {k: (n, bytes(v)) for k, (n, v) in whole.items()}


def test_packing_of_odd_tables(spark, library):
    path = queries.word_vocabulary()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, path).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "z")], "doc_id long, text string").repartition(1)
    got = packing.pack(twice, path, 4).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 8 and sum(r["length"] for r in got if r["doc_id"] is None) == 2


def test_best_fit():
    packer = packing.Packer(0, 10, 2)
    ids = lambda n: bytes(4 * n)
    assert packer.add("a", ids(7)) == [] and packer.add("b", ids(4)) == []
    [*done] = packer.add("c", ids(3))  # fills a's window, not b's
    assert [p[0] for p in done] == ["a", "c"]
    assert packer.add("d", ids(8)) == []
    done = packer.add("e", ids(7))  # fits nowhere: the fullest takes its head
    assert [(p[0], p[1], p[2]) for p in done] == [("d", 0, 8), ("e", 0, 2)]
    assert [(p[0], p[1], p[2]) for p in packer.leftovers()] == [("b", 0, 4), ("e", 2, 5)]


def test_query_on_the_given_tables(spark, library):
    got = queries.op12_packing(spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    seen = 0
    for r in got:
        ids = ids_of(library, texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        seen += r["length"]
    assert seen == sum(len(ids_of(library, t)) for t in texts.values())


def test_latin_texts_are_cut_without_the_library(library):
    rng = random.Random(6)
    latin = [*map(chr, range(0x180)), *map(chr, range(0x2010, 0x2028)), "€"]
    bits = [*latin, *"'\"’–éÉßçñÅİŉſ¼²ª\xad", *(["'s", "'RE", "'ll", "''t", " ", "\n", "\xa0", "mañana", "Ünder", "WÖRTER"] * 30)]
    texts = [*latin, *(f"a{c}b" for c in latin), *("".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(2000))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = packing.Encoder(queries.word_vocabulary())
    encoder.library = None  # only its model is asked
    for t, ids in zip(texts, want, strict=True):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids, repr(t)


def test_texts_of_many_scripts_equal_the_library(library):
    rng = random.Random(7)
    marks = ["e\u0301", "\u0301", "\u0307", "\u0345", "A\u030a", "\u212b", "\u212a", "\u1100\u1161", "\u0391\u03a3", "\u2126", "\u2c65", "\u1e9e", "\ufb01", "\u0663", "\uff11", "\u4e2d", "\u093e"]
    bits = [*map(chr, range(0x180, 0x250)), *map(chr, range(0x2000, 0x2070)), *([*marks, *" aZ1!éİ\n ", "'s"] * 5)]
    encoder = packing.Encoder(queries.word_vocabulary())
    for t in ("".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(2000)):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
