"""Document pairs: similarity, matched terms, scores and gaps. A pair is two documents, the left to be held against the right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counts import bounded_batches, gram_cosine
from ..functions.text import calibrated, grade, rounded
from .terms import content_rows, content_text, skills_of

WEIGHTS = {"keyword": 0.4, "skills": 0.4, "length": 0.2}


def _sided(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pair_id", F.floor(F.col("doc_id") / 2).cast("long")).withColumn("is_left", F.col("doc_id") % 2 == 0)


def cosine_of_texts(left: Column, right: Column) -> Column:
    """The cosine of two terms.content_text(), to 6 places: of 1 + ln(tf) of runs of 1 to 3 content tokens, times an idf over the two
    documents (1 for terms of both, else 1 + ln(3/2)). Null if neither has any."""
    return F.round(gram_cosine(left, right), 6)


def tfidf_cosine(docs: DataFrame) -> DataFrame:
    """pair_id, cosine of each even doc_id and the next. Both texts meet in one row; their runs are counted there."""
    bounded_batches(docs.sparkSession)
    sides = _sided(docs.select("doc_id", content_text(F.col("text")).alias("c")))
    of = lambda test, name: F.array_join(F.collect_list(F.when(test, F.col("c"))), "\n").alias(name)
    both = sides.groupBy("pair_id").agg(of(F.col("is_left"), "l"), of(~F.col("is_left"), "r"))
    return both.select("pair_id", cosine_of_texts(F.col("l"), F.col("r")).alias("cosine")).where("cosine is not null")


def cosine_of(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pair_id, cosine of given pairs (pair_id, left_id, right_id) of two tables (doc_id, text). The left is met last, so that its pairs follow each other."""
    bounded_batches(pairs.sparkSession)
    side = lambda docs, name: docs.select(F.col("doc_id").alias(f"{name}_id"), content_text(F.col("text")).alias(name))
    both = pairs.join(side(right, "right"), "right_id", "left").join(side(left, "left"), "left_id", "left")
    return both.select("pair_id", cosine_of_texts(F.col("left"), F.col("right")).alias("cosine")).where("cosine is not null")


def skill_match(docs: DataFrame) -> DataFrame:
    """pair_id, matched, missing, extra, recall, precision, f1, score: dictionary terms of the right found on the left."""
    sides = _sided(skills_of(docs)).groupBy("pair_id", "tok").agg(F.max(F.col("is_left").cast("int")).alias("l"), F.max((~F.col("is_left")).cast("int")).alias("r"))
    flags = sides.groupBy("pair_id").agg(*[F.sum(e).cast("long").alias(c) for c, e in (("matched", F.col("l") * F.col("r")), ("missing", (1 - F.col("l")) * F.col("r")), ("extra", F.col("l") * (1 - F.col("r"))))])
    recall = F.coalesce(F.try_divide(F.col("matched"), F.col("matched") + F.col("missing")), F.lit(0.0))
    precision = F.coalesce(F.try_divide(F.col("matched"), F.col("matched") + F.col("extra")), F.lit(0.0))
    out = flags.withColumn("recall", F.round(recall, 6)).withColumn("precision", F.round(precision, 6))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("matched"), 2 * F.col("matched") + F.col("missing") + F.col("extra")), F.lit(0.0))
    score = 100.0 * F.col("matched") / F.greatest(F.lit(1), F.col("matched") + F.col("missing"))
    return out.withColumn("f1", F.round(f1, 6)).withColumn("score", F.round(score, 4))


def missing_terms(docs: DataFrame, k: int = 10) -> DataFrame:
    """pair_id, tok, tf, severity: of the right's k most frequent content terms those that the left lacks."""
    counts = _sided(content_rows(docs)).groupBy("pair_id", "tok").agg(F.sum(F.col("is_left").cast("int")).alias("l"), F.sum((~F.col("is_left")).cast("int")).alias("tf")).where("tf > 0")
    best = Window.partitionBy("pair_id").orderBy(F.col("tf").desc(), "tok")
    ranked = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).where("l = 0")
    return ranked.select("pair_id", "tok", "tf", F.when(F.col("tf") >= 4, "high").when(F.col("tf") >= 2, "medium").otherwise("low").alias("severity"))


def pair_scores(docs: DataFrame) -> DataFrame:
    """pair_id, keyword, skills, length, overall, grade: weighted scores from 0 to 100."""
    sizes = _sided(docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"))).groupBy("pair_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    length = F.when(F.col("hi") > 0, 100.0 * F.col("lo") / F.col("hi")).otherwise(0.0)
    parts = sizes.join(tfidf_cosine(docs), "pair_id", "left").join(skill_match(docs).select("pair_id", "score"), "pair_id", "left")
    parts = parts.select("pair_id", rounded(100 * calibrated(F.coalesce("cosine", F.lit(0.0)), 0.2), 2).alias("keyword"), rounded(F.coalesce("score", F.lit(0.0)), 2).alias("skills"), rounded(length, 2).alias("length"))
    overall = rounded(sum(F.col(c) * w for c, w in WEIGHTS.items()), 1)
    return parts.withColumn("overall", overall).withColumn("grade", grade(F.col("overall")))


def vector_cosine(vectors: DataFrame) -> DataFrame:
    """pair_id, cosine of each even vec_id and the next, within 0 and 1; 0 where a vector has no length."""
    sides = vectors.select(F.floor(F.col("vec_id") / 2).cast("long").alias("pair_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 2 == 0).alias("is_left"))
    both = sides.groupBy("pair_id").agg(F.max(F.when(F.col("is_left"), F.col("v"))).alias("a"), F.max(F.when(~F.col("is_left"), F.col("v"))).alias("b")).where("a is not null and b is not null")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    size = F.sqrt(dot("a", "a") * dot("b", "b"))
    return both.select("pair_id", F.round(F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot("a", "b") / size))).otherwise(0.0), 6).alias("cosine"))
