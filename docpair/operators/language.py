"""Word classes, word groups, named things, lines and chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import let
from ..functions.text import EMAIL, TOKEN, URL, lemma, tokens
from .terms import STOP_WORDS

#: What a word of each class weighs.
TAG_WEIGHTS = {"PROPN": 1.0, "NOUN": 0.9, "ADJ": 0.5, "VERB": 0.4, "ADV": 0.2}
#: Patterns of named things.
NAMED = {"EMAIL": EMAIL, "URL": URL, "NUMBER": r"[0-9][0-9.,]*", "NAME": r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"}


def tag(word: Column) -> Column:
    """A word's class by list, shape and ending."""
    low = F.lower(word)
    return (
        F.when(low.isin(STOP_WORDS), "FUNC").when(word.rlike("^[0-9]"), "NUM").when(low.rlike("ly$"), "ADV").when(low.rlike("(ing|ed|ize|ise)$"), "VERB")
        .when(low.rlike("(ous|ful|able|ible|ive|al)$"), "ADJ").when(word.rlike(r"^\p{Lu}"), "PROPN").otherwise("NOUN")
    )


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word, lemma, tag: a row for each word; null texts have none."""
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "word"))
    return words.select("doc_id", "pos", "word", lemma(F.col("word")).alias("lemma"), tag(F.col("word")).alias("tag"))


def tag_counts(docs: DataFrame) -> DataFrame:
    return tagged(docs).groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def weighted_lemmas(docs: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, rank, lemma, weight: the k lemmas with the greatest sums of class weights, ties by lemma."""
    weight = F.coalesce(*[F.when(F.col("tag") == t, F.lit(w)) for t, w in TAG_WEIGHTS.items()], F.lit(0.0))
    sums = tagged(docs).groupBy("doc_id", "lemma", "tag").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "lemma").agg(F.round(F.sum(weight * F.col("n")), 4).alias("weight"))
    best = Window.partitionBy("doc_id").orderBy(F.col("weight").desc(), "lemma")
    return sums.where("weight > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def noun_chunks(docs: DataFrame, most_words: int = 6) -> DataFrame:
    """doc_id, chunk, n: runs of 2 words or more of nominal classes, in pieces of at most so many words."""
    in_order = Window.partitionBy("doc_id").orderBy("pos")
    rows = tagged(docs).withColumn("out", (~F.col("tag").isin("ADJ", "NOUN", "PROPN")).cast("int"))
    rows = rows.withColumn("island", F.sum("out").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).where("out = 0")
    rows = rows.withColumn("piece", F.floor((F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("pos")) - 1) / most_words))
    runs = rows.groupBy("doc_id", "island", "piece").agg(F.array_sort(F.collect_list(F.struct("pos", F.lower("word").alias("word")))).alias("ws")).where(F.size("ws") >= 2)
    return runs.groupBy("doc_id", F.array_join("ws.word", " ").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


def named(docs: DataFrame) -> DataFrame:
    """doc_id, label, key, first, n: distinct named things without regard to case, the number of the first among its label, occurrences."""

    def things(label: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x, i: F.struct(F.lit(label).alias("label"), F.lower(x).alias("key"), i.alias("pos")))

    rows = docs.select("doc_id", F.inline(F.concat(*[things(*named) for named in NAMED.items()])))
    return rows.groupBy("doc_id", "label", "key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))


def line_kinds(docs: DataFrame) -> DataFrame:
    """doc_id, n_noise, n_headings, n_bullets: lines that number pages, short lines mostly of capitals, lines that open with a bullet."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    letters = lambda x, kind: F.char_length(F.regexp_replace(x, rf"[^\p{{{kind}}}]", ""))
    count = lambda test: F.size(F.filter(lines, test)).cast("long")
    heading = lambda x: (F.char_length(x) <= 60) & (letters(x, "L") > 0) & (10 * letters(x, "Lu") >= 8 * letters(x, "L"))
    return docs.where("text is not null").select(
        "doc_id", count(lambda x: x.rlike("(?i)^page [0-9]+( of [0-9]+)?$")).alias("n_noise"), count(heading).alias("n_headings"), count(lambda x: x.rlike("^[-*•] ")).alias("n_bullets")
    )


def marked_blocks(docs: DataFrame, markers: dict[str, str]) -> DataFrame:
    """doc_id, block, n_lines, n_chars: each line belongs to the last marker at or before it (null before the first).

    markers maps a block's name to a pattern; a line that matches several opens the block named first.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    mark = F.coalesce(*[F.when(F.col("line").rlike(p), name) for name, p in markers.items()])
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("block", F.last(mark, ignorenulls=True).over(so_far))
    return filled.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


def ngrams(docs: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """doc_id, pos, n, surface: each run of so many tokens."""

    def runs(n: int) -> Column:
        places = F.when(F.size("ts") >= n, F.sequence(F.lit(1), F.size("ts") - n + 1))
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.array_join(F.slice("ts", i, n), " ").alias("surface")))

    ts = docs.select("doc_id", tokens(F.col("text")).alias("ts"))
    return ts.select("doc_id", F.inline(F.flatten(F.array_compact(F.array(*map(runs, sizes))))))


def longest_matches(docs: DataFrame, dictionary: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """doc_id, pos, n, surface: dictionary entries in texts that don't overlap: from the left, the longest at each place."""
    hits = ngrams(docs, sizes).join(dictionary, "surface", "left_semi")
    lists = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("n")).alias("less"), "n", "surface"))).alias("hits"))
    free = lambda kept, h: h["pos"] >= F.element_at(kept, -1)["pos"] + F.element_at(kept, -1)["n"]
    kept = F.aggregate(F.slice("hits", 2, 1 << 30), F.slice("hits", 1, 1), lambda a, h: F.when(free(a, h), F.concat(a, F.array(h))).otherwise(a))
    return lists.select("doc_id", F.inline_outer(kept)).drop("less")


#: Characters of a piece of text that a step looks into; a step's work is bounded by it, not by the text.
REACH = 1 << 15


def chunk_arrays(text: Column, most: int = 512, overlap: int = 64) -> Column:
    """Pieces of a text (start, chunk) of at most so many characters; each begins `overlap` characters before the end of the one before.

    A piece ends behind the last full stop before a blank, or the last newline, of its second half; else at the limit. The
    overlap must be less than half of `most`, so that each piece gets further. Null and empty texts have none. The text is
    cut into stretches of REACH characters first, and a piece is taken from the stretch where it begins and the next.
    """
    if not 0 <= overlap < most // 2:
        raise ValueError("overlap must be less than half of a piece")
    reach = max(REACH, most)
    size = F.char_length(text)
    none = F.array().cast("array<struct<start:int,chunk:string>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(whole: Column, s: Column) -> Column:
        k = (s["at"] / reach).cast("int")
        near = F.concat(F.get(whole["stretches"], k), F.coalesce(F.get(whole["stretches"], k + 1), F.lit("")))
        return let(F.substring(near, s["at"] % reach + 1, F.lit(most)), lambda window: taken(window, s, whole["size"]))

    def taken(window: Column, s: Column, size: Column) -> Column:
        tail = F.regexp_extract(window, r"(?s)^.*(?:\. |\n)", 0)
        marked = let(tail, lambda t: F.char_length(t) - t.endswith(" ").cast("int"))
        length = let(marked, lambda m: F.when(s["at"] + most >= size, size - s["at"]).when(m > most // 2, m).otherwise(most))
        return let(length, lambda n: F.struct(
            F.when(s["at"] + n >= size, size).otherwise(s["at"] + n - overlap).cast("int").alias("at"),
            F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), F.substring(window, F.lit(1), n).alias("chunk")))).alias("out"),
        ))

    steps = F.sequence(F.lit(1), (size / (most // 2 - overlap)).cast("int") + 1)
    cut = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{reach}}}"), F.lit(0)).alias("stretches"), size.alias("size"))  # made once, not at each step
    folded = let(cut, lambda whole: F.aggregate(steps, begin, lambda s, _: F.when(s["at"] >= whole["size"], s).otherwise(step(whole, s)), lambda s: s["out"]))
    return F.when(size > 0, folded)


def chunks(docs: DataFrame, most: int = 512, overlap: int = 64) -> DataFrame:
    """doc_id, chunk_no, start, chunk: a row for each piece of chunk_arrays()."""
    rows = docs.select("doc_id", F.posexplode_outer(chunk_arrays(F.col("text"), most, overlap)).alias("chunk_no", "c"))
    return rows.where("c is not null").select("doc_id", "chunk_no", "c.start", "c.chunk")
