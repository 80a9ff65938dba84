"""What rests on the counts of one text's words, runs and phrases, made in its row by Arrow-batched Python.

A text is handed over as its content tokens (or its phrases) in one string, so no row for each run is made or shuffled; a batch
holds a bounded number of bytes, and of it one text is counted at a time.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from math import floor, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Codes of digits, which are no terms, as in text.valid_term().
CODE = re.compile(r"[A-Za-z]?[0-9]+[a-z]?")


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark hand Python tasks at most BATCH_BYTES of rows at a time, unless the session sets a limit of its own. The setting stays, as frames are lazy."""
    spark.conf.set(BATCH_LIMIT, spark.conf.get(BATCH_LIMIT, BATCH_BYTES))


def grams(texts: str) -> Counter:
    """Counts of runs of 1 to 3 tokens; tokens stand between blanks, and no run crosses a newline."""
    counts: Counter = Counter()
    for line in texts.split("\n"):
        words = line.split(" ") if line else []
        counts.update(words)
        counts.update(map(" ".join, zip(words, words[1:])))
        counts.update(map(" ".join, zip(words, words[1:], words[2:])))
    return counts


def is_term(run: str) -> bool:
    """text.valid_term() for runs of up to 3 tokens."""
    return len(run) <= 48 and any(map(str.isalpha, run)) and not CODE.fullmatch(run)


def top_grams(content: Column, k: int) -> Column:
    """An array of rank, tok, tf, weight: of a text's runs the k most frequent terms, ties by term; weight is 1 + ln(tf), over the length of all runs' weights."""

    @F.arrow_udf("array<struct<rank:int,tok:string,tf:bigint,weight:double>>")
    def top(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            ranks, toks, tfs, weights, ends = [], [], [], [], [0]
            for text in texts.to_pylist():
                by_count = defaultdict(list)
                for tok, tf in grams(text or "").items():
                    by_count[tf].append(tok)
                size = sqrt(sum(len(of) * (1 + log(tf)) ** 2 for tf, of in by_count.items()))
                best = ((tf, tok) for tf in sorted(by_count, reverse=True) for tok in sorted(by_count[tf]) if is_term(tok))  # only the first runs are looked at
                for rank, (tf, tok) in enumerate(islice(best, k), 1):
                    ranks.append(rank), toks.append(tok), tfs.append(tf), weights.append((1 + log(tf)) / size)
                ends.append(len(toks))
            fields = [pa.array(ranks, pa.int32()), pa.array(toks, pa.string()), pa.array(tfs, pa.int64()), pa.array(weights, pa.float64())]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["rank", "tok", "tf", "weight"]))

    return top(content)


def gram_cosine(left: Column, right: Column) -> Column:
    """The cosine of two texts' runs, weighed 1 + ln(tf), times 1 + ln(3/2) for those of one text only; null if neither has any.

    The left's weights are kept for the next row, as pairs of one left text mostly follow each other.
    """
    alone = (1 + log(1.5)) ** 2
    weight = [0.0, *(1 + log(n) for n in range(1, 1000))]
    of = lambda n: weight[n] if n < 1000 else 1 + log(n)

    def counted(text: str | None) -> tuple[Counter, float]:
        counts = grams(text or "")
        return counts, sum(times * of(n) ** 2 for n, times in Counter(counts.values()).items())

    @F.arrow_udf("double")
    def cosine(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, kept = None, None
        for lefts, rights in parts:
            out: list[float | None] = []
            for a, b in zip(lefts.to_pylist(), rights.to_pylist(), strict=True):
                if a != last or kept is None:
                    last, kept = a, counted(a)
                (na, aa), (nb, bb) = kept, counted(b)
                if not na and not nb:
                    out.append(None)
                    continue
                ab = ca = cb = 0.0
                for g in na.keys() & nb.keys():
                    x, y = of(na[g]), of(nb[g])
                    ab, ca, cb = ab + x * y, ca + x * x, cb + y * y
                size = sqrt((alone * (aa - ca) + ca) * (alone * (bb - cb) + cb))
                out.append(min(ab / size, 1.0) if na and nb else 0.0)
            yield pa.array(out, pa.float64())

    return cosine(left, right)


def top_phrases(listed: Column, k: int) -> Column:
    """An array of rank, phrase, n, score: of phrases (joined by |) the k best of 2 to 40 characters, ties by phrase. A word scores the mean length of the
    phrases it stands in; a phrase scores the sum over its words, times its occurrences, to 4 places."""

    @F.pandas_udf("array<struct<rank:int,phrase:string,n:bigint,score:double>>")
    def top(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for text in texts:
                counts = Counter(text.split("|")) if text else {}
                lengths, times = defaultdict(int), defaultdict(int)
                for phrase, n in counts.items():
                    words = phrase.split(" ")
                    for w in words:
                        lengths[w] += len(words) * n
                        times[w] += n
                of = lambda phrase, n: floor(10000 * (sum(lengths[w] / times[w] for w in phrase.split(" ")) * n) + 0.5) / 10000  # noqa: E731, B023
                best = heapq.nsmallest(k, ((-of(p, n), p) for p, n in counts.items() if 2 <= len(p) <= 40))
                out.append([{"rank": i + 1, "phrase": p, "n": counts[p], "score": -score} for i, (score, p) in enumerate(best)])
            yield pd.Series(out, dtype=object)

    return top(listed)


def covered(tokens: Column, phrases: Column) -> Column:
    """How many of a text's tokens (between blanks) stand in one of its phrases (tokens between blanks, a phrase a line); a token counts once."""

    @F.pandas_udf("int")
    def count(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in parts:
            out = []
            for text, listed in zip(texts, lists, strict=True):
                words = text.split(" ") if text else []
                places, inside = defaultdict(list), set()
                for i, w in enumerate(words):
                    places[w].append(i)
                for phrase in filter(None, (listed or "").split("\n")):
                    run = phrase.split(" ")
                    for i in places.get(run[0], ()):
                        if words[i : i + len(run)] == run:
                            inside.update(range(i, i + len(run)))
                out.append(len(inside))
            yield pd.Series(out, dtype="int32")

    return count(tokens, phrases)


def walked(content: Column, reach: int, damping: float, rounds: int, close: float) -> Column:
    """An array of term, score: words ranked by a damped walk over the graph of words within `reach` of each other, over the greatest;
    null for fewer than 4 words. Words are numbers in the graph, so a long one takes its room once."""

    def walk(words: list[str]) -> list[dict] | None:
        names = sorted(set(words))
        number = {w: i for i, w in enumerate(names)}
        at, n = np.fromiter((number[w] for w in words), np.int64, len(words)), len(names)
        near = [(at[:-i], at[i:]) for i in range(1, min(reach, len(at) - 1) + 1)]
        a, b = (np.concatenate([x[side] for x in near]) if near else at[:0] for side in (0, 1))
        a, b = a[a != b], b[a != b]
        edges, times = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
        source, to = edges // n, edges % n
        met = np.unique(to)
        if len(met) < 4:
            return None
        share = times / np.bincount(source, times, n)[source]
        rank = np.zeros(n)
        rank[met] = 1 / len(met)
        for _ in range(rounds):
            new = damping * np.bincount(to, share * rank[source], n)
            new[met] += (1 - damping) / len(met)
            done = np.abs(new - rank).sum() < close
            rank = new
            if done:
                break
        scores = np.round(rank[met] / rank.max(), 6).tolist()
        return [{"term": names[i], "score": s} for i, s in zip(met.tolist(), scores, strict=True)]

    @F.pandas_udf("array<struct<term:string,score:double>>")
    def ranks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([walk(text.split(" ")) if text else None for text in texts], dtype=object)

    return ranks(content)
