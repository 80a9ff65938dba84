"""Near copies whose ids are null or shared; long sets."""

import random

import pytest

from docpair.llm import near_dedup

WORDS = [f"w{k}" for k in range(500)]


def near(text, k):
    words = text.split()
    words[k] = "other"
    return " ".join(words)


def test_ids_that_are_null_or_shared(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choices(WORDS, k=90)) for _ in range(9)]
    rows = [(100, base[0]), (None, near(base[0], 40)), (None, base[1]), (None, near(base[1], 40))]
    rows += [(1, t) for t in base[2:]] + [(10 + i, near(t, 50)) for i, t in enumerate(base[2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(100, 100, True), (None, 100, False), (None, None, True), (1, 1, True)} | {(10 + i, 1, False) for i in range(7)}


@pytest.mark.parametrize("most", [2**22, 300])
def test_blocks_by_shingles(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", most)
    monkeypatch.setattr(near_dedup, "GROUP_SHINGLES", most)
    rng = random.Random(10)
    stem = rng.choices(WORDS, k=90)
    texts = [" ".join(stem[:60] + rng.choices(WORDS, k=30)) for _ in range(30)]
    texts += [near(t, 70) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert all(got[30 + i] == got[i] == i for i in range(30))


def linked(sets, percent=75):
    """Smallest index that each set can reach, by comparing all pairs."""
    low = list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while any(low[i] != low[j] for i, j in pairs):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    return low


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [2048, 7])
def test_drifting_copies_against_all_pairs(spark, monkeypatch, block):
    """Copies of copies: many share buckets with texts that they aren't linked with, so that guests visit blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "TURN", 3)
    rng = random.Random(11)
    texts = [" ".join(rng.choices(WORDS, k=120))]
    for _ in range(220):
        words = rng.choice(texts[-40:]).split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [None, "", "  ", "few words", "Few WORDS"]
    want = linked([shingles(t) for t in texts])
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in enumerate(texts)}
    assert len(set(want)) > 20


def test_given_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = linked([shingles(r["text"]) for r in rows])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {r["doc_id"]: rows[k]["doc_id"] for r, k in zip(rows, want, strict=True)}
