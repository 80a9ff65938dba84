"""Misspelled and disguised terms of a lexicon that was learned."""

import math
import random
import re

from docpair.llm import toxicity


def test_learned_words_allow_misspellings(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("aeiourtnls", k=rng.randint(3, 8))) for _ in range(300)]
    abuse = ["stupid", "worthless", "pathetic", "idiot"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(vocabulary, k=40)
        if i % 3 == 0:
            words[rng.randrange(40)] = rng.choice(abuse)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert {(w, False) for w in abuse} <= {(t, o) for t, o, _ in model.terms}
    lexicon = toxicity.Lexicon(model.terms, swaps=True)
    for word in ("sutpid", "stupd", "tupid", "ztupid", "stuppid", "wrothless", "worhtles", "iidot", "diiot", "pathetik"):
        exact, near = lexicon.match(word)
        assert not exact and near > 2, word
    for word in ("path", "wort", "worte", "stupa"):
        assert lexicon.match(word) == (0.0, 0.0), word
    found = lambda text: toxicity.features(text, lexicon, {})
    assert all(found(f"so {w} here")[0] > 2 for w in ("idiot", "id1ot", "w0rthl3$s", "p@thetic", "stop!idiot"))
    assert found("$tupid")[2] > 2 and found("12 idi 07 ot 3.14") == [0.0] * 8
    assert toxicity.readings("x" * 30_000 + " a1b") == [(30_001, 30_004, "aib")]


def apart(a, b):
    """Edits between two words, an exchange of two adjacent letters being one."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] != a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_scores_are_those_of_plain_edit_distances(spark):
    rng = random.Random(12)
    terms = [("worthless", False, 3.0), ("idiot", False, 2.5), ("scum", False, 2.0), ("patheti", True, 1.5)]
    model = toxicity.Model(terms, [0.7, 0.3, 0.5, 0.2, 0.4, -0.6, 0.1, 0.05, -1.5])

    def hit(word):
        exact = max([w for t, open_end, w in terms if word == t or open_end and word.startswith(t)], default=0.0)
        near = max([w for t, open_end, w in terms if not open_end and 0 < apart(word, t) <= (len(t) >= 5) + (len(t) >= 9)], default=0.0)
        return exact, near

    def score(text):
        lower = (text or "").lower()
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]+", lower)]
        top = [0.0, 0.0, 0.0]  # exact, near, quoted
        sums, address, hits = {}, 0, 0
        for start, end, word in found:
            exact, near = hit(word)
            if not exact and not near:
                continue
            hits += 1
            before, after = lower[max(0, start - toxicity.WINDOW) : start], lower[end : end + toxicity.WINDOW]
            around = set(re.findall(r"[^\W\d_]+", before)) | set(re.findall(r"[^\W\d_]+", after))
            if set(before) & set(toxicity.QUOTES) and set(after) & set(toxicity.QUOTES) or around & toxicity.REPORTING:
                top[2] = max(top[2], exact, near)
                continue
            top[:2] = max(top[0], exact), max(top[1], near)
            sums[word] = exact, near
            address += bool(around & toxicity.ADDRESS)
        x = [top[0], math.log1p(sum(e for e, _ in sums.values())), top[1], math.log1p(sum(n for _, n in sums.values())), math.log1p(address), top[2], math.log1p(hits), 100 * hits / len(found) if hits else 0.0]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights)) - model.weights[-1]))

    plain = ["stone", "river", "you", "said", '"', "the", "cloud,", "é"]
    bad = ["worthless", "worthles", "wrothless", "orthless", "idiot", "idito", "idio", "scum", "scam", "pathetical", "vorthles"]
    texts = [None, "", "idiot"] + [" ".join(rng.choices(plain, k=20) + rng.choices(bad, k=rng.randint(0, 2)) + rng.choices(plain, k=rng.choice([0, 3, 20]))) for _ in range(150)]
    out = toxicity.with_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in out.collect()}
    for i, t in enumerate(texts):
        assert abs(got[i][0] - score(t)) < 1e-9 and got[i][1] == (got[i][0] >= 0.7), t
