"""The audit of sources against plain Python on a small fixture."""

import random
import re
from collections import Counter, defaultdict

import pytest

from docpair.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value int, term string"


def plain(rows, min_docs=3, most=200):
    """rows: (text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(divergence.TERM, (text or "").translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, counts = Counter(), defaultdict(Counter)
        for one, source, terms in docs:
            if one == lang:
                held.update(set(terms))
                counts[source].update(terms)
        kept = [t for t, n in held.items() if n >= min_docs]
        share = lambda c, n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}  # noqa: B023, E731
        shares = {s: share(c, sum(c[t] for t in kept)) for s, c in counts.items()}
        of_lang = sum(counts.values(), Counter())
        whole = share(of_lang, sum(of_lang[t] for t in kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, p in shares.items():
            parts = {"pair": [(sum(f(p[t], q[t]) for t in kept), o) for o, q in shares.items() if o != s]}
            parts["term"] = [(f(p[t], whole[t]), t) for t in kept if counts[s][t] > 0 and p[t] > whole[t]]
            for part, found in parts.items():
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < most]
    return sorted(out)


def fixture():
    rng = random.Random(6)
    words = ["Red", "red", "blue", "É", "é", "x\x85y", "中", "a1b", "don't", "end_of", "😀"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choices(words[k % 5 :], k=rng.randint(1, 40))), rng.choice(["en", "de", None, "a\x00b"]), rng.choice(["web", "news", "books", None, "x y"])) for k in range(90)]
    return [*rows, (None, "en", "only empty"), ("", None, None), ("once", "xx", "one"), ("twice", "xx", "two"), ("z", "yy", "lonely"), ("word " * 30_000, "en", "long"), ("5 %", "en", "signs"), rows[0], rows[0]]


@pytest.mark.parametrize("limits", [{}, {"SLICE": 5}, {"CELL": 4, "STRIP": 2}])
def test_against_plain_python(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    rows = fixture()
    docs = spark.createDataFrame([(i, *r, 1, "t") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    for most in (200, 3):
        got = divergence.audit(docs, most_terms=most)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, most=most)


def test_odd_tables(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None), ("a", "en", "s"), ("b", "en", "t")]
    got = divergence.audit(spark.createDataFrame([(i, *r, 1, "t") for i, r in enumerate(rows)], SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_of_large_counts(spark):
    for n, whole in ((0, 1), (8 * 10**13, 9 * 10**13), (12, 7 * 10**12), (123456789012, 987654321098)):
        got = spark.range(1).select(divergence.smoothed(f"{n}L", f"{whole}L")).first()[0]
        assert got == 1 + 10**9 * (n + 1) // whole
