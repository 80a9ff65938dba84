"""Vector codes against plain Python, and the pivots' pruning against all distances."""

import math
import random

import numpy as np
import pytest

from docpair.llm import vector_codes


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, vector, label); the codes, errors and codebooks, by the rules alone."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = parts * max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    d = width // parts
    whole = [[(int(x) * scale if abs(x) >= 1e15 else math.floor(scale * x)) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    cut = [[tuple(w[p * d : p * d + d]) for p in range(parts)] for w in whole]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda part, x: min((far(x, e), k) for k, e in enumerate(books[part]))
    for _ in range(rounds):
        at = [[best(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at, strict=True) if a[p] == k]
                if mine:
                    at_k = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
                    books[p] = [*books[p][:k], at_k, *books[p][k + 1 :]]
    found = [[best(p, c[p]) for p in range(parts)] for c in cut]
    out = [(i, label, [k for _, k in f], min(2**63 - 1, sum(e for e, _ in f))) for (i, _, label), f in zip(kept, found, strict=True)]
    return out, [[list(e) for e in b] for b in books]


def rows_of(n, width, rng, scale=1.0):
    return [(i, [rng.gauss(0, scale) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int, far string, numbers int"
order = lambda rows: sorted(rows, key=str)


@pytest.mark.parametrize("case", ["usual", "few", "ties", "odd", "huge"])
def test_against_plain_python(spark, case):
    rng = random.Random(9)
    rows = rows_of(200, 16, rng)
    if case == "few":
        rows = rows[:5]
    if case == "ties":
        rows = [(i, [float(rng.randrange(2)) / 4096 for _ in range(16)], 1) for i in range(150)]
    if case == "odd":
        rows += [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 16, 1), (503, [float("-inf")] * 16, None), (504, [], 3), (505, [1.0, -2.0, 3.0], 3), (None, [0.5] * 16, None), (1, [0.25] * 16, 2), (1, [0.25] * 16, 2)]
        rows = rows[60:]
    if case == "huge":
        rows = [(i, [x * 10.0 ** rng.choice([0, 7, 18, 200]) for x in v], label) for i, v, label in rows[:40]]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA).repartition(3)
    want, books = plain(rows)
    codes, got_books = vector_codes.compress(df)
    assert got_books == books
    assert order(tuple(r) for r in codes.select("vec_id", "label", "indexes", "error").collect()) == order(want)
    sums: dict = {}
    for _, label, _, error in want:
        sums[label] = min(2**63 - 1, sums.get(label, 0) + error)
    got = vector_codes.with_label_error(codes).collect()
    assert len(got) == len(want) and all(r["label_error"] == sums[r["label"]] for r in got)


def test_empty_table(spark):
    codes, books = vector_codes.compress(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA))
    assert vector_codes.with_label_error(codes).count() == 0 and books == [[]] * 8


def test_nearest_prunes_nothing_that_wins():
    rng = np.random.default_rng(2)
    for spread in (1, 5, 3000):
        x, e = rng.integers(-spread, spread + 1, (500, 8)), rng.integers(-spread, spread + 1, (16, 8))
        pivots = e[:4]
        at, best = vector_codes.nearest(x, vector_codes._roots(vector_codes._squares(x[:, None], pivots[None])).astype(np.float32), e, pivots)
        every = vector_codes._squares(x[:, None], e[None])
        assert (best == every.min(1)).all() and (at == every.argmin(1)).all()
