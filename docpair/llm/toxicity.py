"""Toxicity by a lexicon, with misspellings, and context windows.

The lexicon is learned: words and word beginnings of labelled documents, by their log odds between toxic and other
documents. A beginning is kept only if it finds more toxic documents than the sum over its words. It is a trie, walked
by a Levenshtein automaton: the product of both is made deterministic step by step, so a word costs a dictionary
look-up for each letter until no term is within reach. A hit's context window tells quotation (quotation marks around
it, verbs of reporting near it) from abuse (words of address near it). A logistic regression on the hits of each kind
gives the score.

What is learned comes from at most `sample` labelled rows, taken in the order of a hash of their ids; half of them give
the lexicon, half the regression. Both are bounded by the sample, whatever the corpus: a term is in at least a hundredth
of the sampled toxic documents, so there are at most a hundred times as many terms as such a document has on average.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

WORDS = re.compile(r"[^\W\d_]+")
#: Digits and signs that stand for letters inside a word.
SIGNS, LETTERS = "013457@$!", "oieastasi"
SIGN = re.compile(rf"[{SIGNS}]+(?=[^\W\d_])")
DISGUISED = re.compile(rf"(?<![^\W\d_])[^\W\d_]++(?:[{SIGNS}]++[^\W\d_]++)+")
READ = str.maketrans(SIGNS, LETTERS)
WINDOW = 60
#: Verbs of reporting and words of address, in the corpus's languages.
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes word words term dit disait écrit mot sagte sagt schrieb wort nannte dijo dice escribió palabra".split())
ADDRESS = frozenset("you your yours yourself u tu te toi vous ton votre du dich dir dein ihr euch tú ti usted vosotros".split())
QUOTES = "\"“”„«»‚‘’"
CACHED = 150_000


def held_out_of(id_col: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % mod == rest


class Lexicon:
    """Terms (text, whether any ending may follow, weight) in a trie, with a lazily built automaton.

    Words of 5 letters and more may differ by one edit, of 9 and more by two, at any letter; with `swaps`, exchanging
    two adjacent letters is one edit. Beginnings must match exactly.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], swaps: bool = False):
        self.swaps = swaps
        self.children: list[dict[str, int]] = [{}]
        self.before = [""]  # the letter that leads to a node's parent
        self.word: list[tuple[float, int] | None] = [None]
        self.stem: list[float] = [0.0]
        self.reach = [0]  # edits that some term below a node allows
        for text, open_end, weight in terms:
            edits = 0 if open_end else (len(text) >= 5) + (len(text) >= 9)
            at, last = 0, ""
            for c in text:
                self.reach[at] = max(self.reach[at], edits)
                at = self.children[at].setdefault(c, len(self.children))
                if at == len(self.word):
                    self.children.append({})
                    self.before.append(last)
                    self.word.append(None)
                    self.stem.append(0.0)
                    self.reach.append(0)
                last = c
            self.reach[at] = max(self.reach[at], edits)
            if open_end:
                self.stem[at] = max(self.stem[at], weight)
            else:
                self.word[at] = max(self.word[at] or (0.0, 0), (weight, edits))
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.hits: list[tuple[float, float]] = []
        self.dead, self.start = self._state(frozenset()), self._state(self._closed({(0, 0, 0.0)}))

    def _closed(self, states: set) -> frozenset:
        """With letters of a term left out; of the states at a node the least edits stay."""
        todo = list(states)
        while todo:
            node, edits, stem = todo.pop()
            if node >= 0 and edits < self.reach[node]:
                for child in self.children[node].values():
                    if (new := (child, edits + 1, stem)) not in states and edits + 1 <= self.reach[child]:
                        states.add(new)
                        todo.append(new)
        return frozenset(states)

    def _state(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            exact = max([s for *_, s in states] + [self.word[n][0] for n, e, _ in states if n >= 0 and e == 0 and self.word[n]] + [0.0])
            whole = {n for n, e, _ in states if e == 0}
            near = max([self.word[n][0] for n, e, _ in states if n >= 0 and n not in whole and self.word[n] and e <= self.word[n][1]] + [0.0])
            self.hits.append((exact, near))
        return self.ids[states]

    def _step(self, state: int, letter: str) -> int:
        out = set()
        for node, edits, stem in self.sets[state]:
            if node == -1:
                out.add((node, edits, stem))
                continue
            if node < 0:  # two letters exchanged, the first of them still to come
                if letter == self.before[-2 - node]:
                    out.add((-2 - node, edits, stem))
                continue
            child = self.children[node].get(letter)
            if child is not None:
                out.add((child, edits, stem))
                if edits == 0 and self.stem[child]:
                    out.add((-1, 0, self.stem[child]))  # whatever follows
            if edits < self.reach[node]:
                out.add((node, edits + 1, stem))  # a letter too many
                if self.swaps:
                    after = (self.children[other].get(letter) for c, other in self.children[node].items() if c != letter)
                    out.update((-2 - n, edits + 1, stem) for n in after if n is not None and edits + 1 <= self.reach[n])
                out.update((other, edits + 1, stem) for c, other in self.children[node].items() if c != letter and edits + 1 <= self.reach[other])
        self.steps[state][letter] = to = self._state(self._closed(out))
        return to

    def match(self, word: str) -> tuple[float, float]:
        """The highest weight of terms that match exactly, and of those within reach by edits."""
        if len(self.sets) > 50_000:
            self._reset()
        at = self.start
        for letter in word:
            to = self.steps[at].get(letter)
            at = self._step(at, letter) if to is None else to
            if at == self.dead:
                return (0.0, 0.0)
        return self.hits[at]


def readings(lower: str) -> list[tuple[int, int, str]]:
    """Start, end and reading of words with digits or signs inside, read as the letters they stand for."""
    if not any(m.start() and lower[m.start() - 1].isalpha() for m in SIGN.finditer(lower)):
        return []
    return [(m.start(), m.end(), m[0].translate(READ)) for m in DISGUISED.finditer(lower)]


def terms_of(text: str) -> set[tuple[str, bool]]:
    """Words, with readings of disguised ones, and their beginnings of 4 to 8 letters, each once."""
    lower = text.lower()
    words = {*WORDS.findall(lower), *(w for *_, w in readings(lower))}
    return {(w, False) for w in words} | {(w[:n], True) for w in words for n in range(4, min(len(w), 9))}


@dataclass
class Model:
    terms: list[tuple[str, bool, float]]
    weights: list[float] = field(default_factory=list)


def features(text: str, lexicon: Lexicon, cache: dict) -> list[float]:
    """Of hits outside quotations: highest and summed weight, the same for near hits, hits with address; of quoted ones the highest; hits a word."""
    lower = text.lower()
    words, disguised = WORDS.findall(lower), readings(lower)
    hit = False
    for w in words + [w for *_, w in disguised] if disguised else words:
        got = cache.get(w)
        if got is None:
            if len(cache) >= CACHED:
                cache.clear()
            got = cache[w] = lexicon.match(w)
        hit = hit or got[0] > 0 or got[1] > 0
    out = [0.0] * 8
    if not hit:
        return out
    seen: set[str] = set()
    hits = 0
    places = [(m.start(), m.end(), m[0]) for m in WORDS.finditer(lower)] + disguised
    for start, end, word in places:
        exact, near = cache.get(word) or lexicon.match(word)
        if not exact and not near:
            continue
        before, after = lower[max(0, start - WINDOW) : start], lower[end : end + WINDOW]
        around = {*WORDS.findall(before), *WORDS.findall(after)}
        quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES) or bool(REPORTING & around)
        hits += 1
        if quoted:
            out[5] = max(out[5], exact, near)
            continue
        out[0], out[2] = max(out[0], exact), max(out[2], near)
        if word not in seen:
            seen.add(word)
            out[1], out[3] = out[1] + exact, out[3] + near
        out[4] += bool(ADDRESS & around)
    return [out[0], np.log1p(out[1]), out[2], np.log1p(out[3]), np.log1p(out[4]), out[5], np.log1p(hits), 100 * hits / len(words)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled documents, of at most `sample` rows of labels.

    Null labels, null ids and documents that labels lacks don't count; neither do labels without a document. A repeated row,
    of labels or of documents, counts as often as it is there. Null texts are empty. Texts count whole, however long.
    Other columns don't matter. Without labels of both kinds one hit is enough for toxicity.
    """
    bounded_batches(docs.sparkSession)
    order = F.xxhash64(F.lit(7), F.col(id_col))
    rows = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__lid"), F.col(label_col).cast("int").alias("y"), (order % 2 == 0).alias("first")).orderBy(order, "y").limit(sample)
    known = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(rows), F.col("__id") == F.col("__lid")).select("t", "y", "first")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {1: Counter(), 0: Counter()}
            for t, y in zip(pdf["t"], pdf["y"], strict=True):
                found[y].update(terms_of(t))
            yield pd.DataFrame([(*k, found[1][k], found[0][k]) for k in {*found[1], *found[0]} if found[1][k]], columns=["term", "open_end", "pos", "neg"])
            # what no toxic document of the batch has counts only where another batch has it: see below

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = {k for k, *_ in picked}
        for pdf in batches:
            found: Counter = Counter()
            for t in pdf["t"]:
                found.update(wanted & terms_of(t))
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["term", "open_end", "neg"])

    totals = {(r["first"], r["y"]): r["count"] for r in known.groupBy("first", "y").count().collect()}
    n_pos, n_neg = totals.get((True, 1), 0), totals.get((True, 0), 0)
    pos = known.where("first and y = 1").mapInPandas(count, "term string, open_end boolean, pos long, neg long").groupBy("term", "open_end").agg(F.sum("pos").alias("pos"))
    least = max(3, n_pos // 100)
    rows = pos.where(F.col("pos") >= least).orderBy(F.col("pos").desc(), "term", "open_end").collect()
    picked = [((r["term"], r["open_end"]), r["pos"]) for r in rows]
    negs = known.where("first and y = 0").mapInPandas(against, "term string, open_end boolean, neg long").groupBy("term", "open_end").agg(F.sum("neg").alias("neg")).collect() if picked else []
    neg = {(r["term"], r["open_end"]): r["neg"] for r in negs}
    seen = dict(picked)
    odds = {k: np.log((p + 0.5) / (n_pos + 1)) - np.log((neg.get(k, 0) + 0.5) / (n_neg + 1)) for k, p in picked}
    kept = {k: float(w) for k, w in odds.items() if w >= 2.5 and not k[1]}  # whole words stay: only they allow edits
    whole: Counter = Counter()  # toxic documents that kept words with a beginning find
    for word, _ in kept:
        for n in range(4, min(len(word), 8) + 1):
            whole[word[:n]] += seen[word, False]
    for (term, open_end), weight in sorted(odds.items(), key=lambda x: (len(x[0][0]), x[0][0])):
        covered = any(kept.get((term[:n], True), 0) >= weight - 1 for n in range(4, len(term)))
        if open_end and weight >= 2.5 and not covered and seen[term, True] > whole[term]:
            kept[term, True] = float(weight)
    model = Model([(t, o, w) for (t, o), w in sorted(kept.items(), key=lambda x: (-x[1], x[0]))])
    found = scored(known.where("not first"), model, "t", "__f").select("__f", "y").collect()
    if found and len({r["y"] for r in found}) == 2:
        model.weights = _logistic(np.array([r["__f"] for r in found]), np.array([r["y"] for r in found], float)).tolist()
    else:  # too few labels: one hit is enough
        model.weights = [1.0, 0, 0.3, 0, 0, 0, 0, 0, -3.0]
    return model


def scored(docs: DataFrame, model: Model, text_col: str, feature_col: str) -> DataFrame:
    """Adds the features of each text; a null text has those of an empty one."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, cache = Lexicon(model.terms, swaps=True), {}
        for texts in parts:
            yield pd.Series([features(t or "", lexicon, cache) for t in texts], dtype=object)

    return docs.withColumn(feature_col, found(F.col(text_col)))


def with_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Adds score (double, 0 to 1) and predicted (int, 1 from the threshold on); columns of these names are replaced.

    Null and empty texts score as texts without a hit. Equal texts score alike; repeated rows stay. Texts are read whole,
    however long, and a word costs a step a letter. Other columns pass through, but for one named __f, which the operator
    uses itself. An empty table stays so.
    """
    dot = F.aggregate(F.zip_with("__f", F.array(*map(F.lit, model.weights[:-1])), lambda a, b: a * b), F.lit(float(model.weights[-1])), lambda a, b: a + b)
    out = scored(docs, model, text_col, "__f").withColumn("score", 1 / (1 + F.exp(-dot))).drop("__f")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
