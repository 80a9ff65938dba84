"""Keywords of pairs compared, and how much of a text its keywords cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counts import bounded_batches
from ..functions.counts import covered as covered_by
from ..functions.rows import held
from ..functions.text import tokens, valid_term
from .ranking import combined, graph_ranks
from .signals import key_phrases
from .terms import content_text, top_terms

#: Endings that a keyword may lose when it is looked for.
ENDINGS = ["s", "es", "ing", "ed", "er", "ion", "ment"]
LOW, HIGH = 0.05, 0.60


def three_rankings(docs: DataFrame, terms: int = 30, phrases: int = 20, words: int = 20) -> DataFrame:
    """doc_id, term, score, methods: the best terms (50 %), phrases (30 %) and words of the word graph (20 %), together."""
    ranked = lambda df, k, name: df.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col(name).alias("term"), "score"))), 1, k).alias("x")).select("doc_id", F.inline_outer("x")).select("doc_id", "term", "score")
    first = top_terms(docs, terms).select("doc_id", F.col("tok").alias("term"), "score")
    second = key_phrases(docs, phrases).select("doc_id", F.col("phrase").alias("term"), "score")
    return combined([("terms", 0.5, first), ("phrases", 0.3, second), ("words", 0.2, ranked(graph_ranks(docs), words, "term"))]).where(valid_term(F.col("term")))


def stems(term: Column) -> Column:
    """The term, and the term without each ending that leaves 4 letters or more."""
    cut = F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.when(F.endswith(term, e) & (F.char_length(term) - F.char_length(e) >= 4), F.substring(term, F.lit(1), F.char_length(term) - F.char_length(e))))
    return F.array_compact(F.concat(F.array(term), cut))


#: What may be left out of compared, as null.
FIELDS = ("occurrences", "importance")
COMPARED = "array<struct<term:string,score:double,found:boolean,occurrences:bigint,importance:double>>"


#: What stands between words of a left text.
BETWEEN = r"[^\p{L}\p{N}_]+"


def _spaced(text: Column, between: str) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, between, " ")), F.lit(" "))


def lower_forms(text: Column) -> tuple[Column, Column]:
    """A left text in lower case, and its words between blanks: made once for a document, not for each of its pairs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low, _spaced(low, BETWEEN)


def with_compared(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """rows of pairs with left_text, right_text, own (the left's keywords), ks (the right's: term and score), and left_content (content_text()), left_lower and left_words
    (those of lower_forms()) if they are at hand, get compared: an array of
    term, score, found, occurrences, importance, in the order of score (highest first), then term; null lists are empty.

    A keyword is found if the left's text holds it, if it is one of the left's keywords, or if one of its stems begins a word
    there. Importance weighs the score by the term's rarity in the pair. Keywords of several words that the right's text
    doesn't hold in one piece are left out. occurrences are the right's own. Of FIELDS those that aren't in fields are null.
    """
    made = "left_lower" in rows.columns and "left_words" in rows.columns
    lower = rows.withColumns({"__lt": F.col("left_lower") if made else F.lower(F.coalesce("left_text", F.lit(""))), "__rt": F.lower(F.coalesce("right_text", F.lit("")))})
    forms = F.struct(
        F.col("__lt").alias("lt"), F.col("__rt").alias("rt"), (F.col("left_words") if made else _spaced(F.col("__lt"), BETWEEN)).alias("lw"), _spaced(F.col("__rt"), r"\s+").alias("rw"),
        (F.concat(F.lit(" "), F.col("left_content") if "left_content" in rows.columns else content_text(F.col("__lt")), F.lit(" ")) if "importance" in fields else F.lit(None)).alias("lc"),
    )
    lower = lower.withColumn("__t", held(forms)).drop("__lt", "__rt")
    t = F.col("__t")

    def looked_up(k: Column) -> Column:
        term = k["term"]
        found = F.coalesce(F.array_contains("own", term), F.lit(False)) | F.contains(t["lt"], term) | F.contains(t["lw"], F.concat(F.lit(" "), F.array_min(stems(term))))  # stems begin the term, so the least begins all others
        idf = F.when((F.size(F.split(term, " ")) > 3) | F.contains(t["lc"], F.concat(F.lit(" "), term, F.lit(" "))), 1.0).otherwise(1 + F.log(F.lit(1.5)))
        occurs = ((F.char_length(t["rt"]) - F.char_length(F.replace(t["rt"], term, F.lit("")))) / F.char_length(term)).cast("long")
        made = {"occurrences": occurs, "importance": F.round(k["score"] * (1 + F.log(1 + idf)) / 3, 6)}
        more = [(made[n] if n in fields else F.lit(None).cast(kind)).alias(n) for n, kind in zip(FIELDS, ("long", "double"), strict=True)]
        return F.struct(term.alias("term"), k["score"].alias("score"), found.alias("found"), *more)

    whole = F.filter("ks", lambda k: ~F.contains(k["term"], F.lit(" ")) | F.contains(t["rw"], k["term"]))
    order = F.transform(F.array_sort(F.transform(whole, lambda k: F.struct((-k["score"]).alias("less"), k["term"].alias("term"), k["score"].alias("score")))), looked_up)
    return lower.withColumn("compared", held(F.coalesce(order, F.array().cast(COMPARED)))).drop("__t")


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, left_keywords: DataFrame, right_keywords: DataFrame) -> DataFrame:
    """pair_id, doc_id (the right's), term, score, found, occurrences, importance of with_compared(), for the keywords (doc_id, term, score) of two tables."""
    own = left_keywords.groupBy("doc_id").agg(F.collect_set("term").alias("own"))
    ks = right_keywords.groupBy("doc_id").agg(F.collect_list(F.struct("term", "score")).alias("ks"))
    lefts = left.join(own, "doc_id", "left").select(F.col("doc_id").alias("left_id"), F.col("text").alias("left_text"), "own")
    rights = right.join(ks, "doc_id", "left").select(F.col("doc_id").alias("right_id"), F.col("text").alias("right_text"), "ks")
    return compared_rows(with_compared(pairs.join(lefts, "left_id").join(rights, "right_id")))


def compared_rows(rows: DataFrame) -> DataFrame:
    """A row for each entry of compared."""
    return rows.select("pair_id", F.col("right_id").alias("doc_id"), F.inline_outer("compared")).where("term is not null")


def covered(compared: Column, k: int = 25, noise: Column | None = None) -> Column:
    """A struct of considered, found, coverage (null without keywords): of the k best keywords those that are found. Terms that are in
    noise (an array), or have a word that is, aren't considered."""
    best = F.slice(compared, 1, k)
    if noise is not None:
        best = F.filter(best, lambda x: ~F.arrays_overlap(F.concat(F.array(x["term"]), F.split(x["term"], " ")), noise))
    found = F.size(F.filter(best, lambda x: x["found"]))
    return F.struct(F.size(best).alias("considered"), found.alias("found"), F.when(F.size(best) > 0, F.round(found / F.size(best), 6)).alias("coverage"))


def coverage_of(rows: DataFrame, k: int = 25) -> DataFrame:
    """pair_id, considered, found, coverage of covered(), for rows of with_compared() that have keywords."""
    return rows.select("pair_id", held(covered(F.col("compared"), k)).alias("c")).where("c.considered > 0").select("pair_id", "c.*")


def keyword_cover(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """doc_id, covered, n, density, band: the share of a text's tokens that stand in one of its keywords (doc_id, term); a token counts once."""
    bounded_batches(docs.sparkSession)
    phrases = keywords.groupBy("doc_id").agg(F.array_join(F.transform(F.collect_set("term"), lambda t: F.array_join(tokens(t), " ")), "\n").alias("ps"))
    rows = docs.select("doc_id", held(tokens(F.col("text"))).alias("ts")).where("ts is not null").join(phrases, "doc_id", "left")
    rows = rows.select("doc_id", covered_by(F.array_join("ts", " "), F.col("ps")).alias("covered"), F.size("ts").alias("n"))
    return _with_band(rows)


def _with_band(rows: DataFrame) -> DataFrame:
    density = F.when(F.col("n") > 0, F.round(F.col("covered") / F.col("n"), 4)).otherwise(0.0)
    return rows.withColumn("density", density).withColumn("band", F.when(density < LOW, "under_optimized").when(density > HIGH, "over_optimized").otherwise("optimal"))


def with_density(rows: DataFrame, terms: Column) -> DataFrame:
    """rows (with text) with density and band of keyword_cover(), for keywords that are an array of a document's row."""
    bounded_batches(rows.sparkSession)
    phrases = F.array_join(F.array_distinct(F.transform(terms, lambda t: F.array_join(tokens(t), " "))), "\n")
    made = rows.withColumn("__ts", held(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))))
    made = made.withColumns({"covered": covered_by(F.array_join("__ts", " "), phrases), "n": F.size("__ts")})
    return _with_band(made).drop("__ts", "covered", "n")
