"""Canonical terms, lists and gaps of pairs, and recommendations for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import _sided
from .signals import checks
from .terms import content_rows, skills_of

#: For each failed check its category, priority (1 first), impact and message.
ADVICE = {
    "extractable": ("format", 1, 9.0, "Add text that can be read"),
    "contact": ("contact", 1, 6.0, "Add an address"),
    "headings": ("structure", 2, 5.0, "Add headings"),
    "length": ("length", 2, 4.0, "Keep between 250 and 1500 words"),
    "charset": ("format", 3, 2.0, "Use plain characters"),
}


def canonical_names(aliases: DataFrame) -> DataFrame:
    """alias, canonical from (alias, canonical, ord): without regard to case; a canonical name is its own, else the first that claims an alias has it."""
    own = aliases.select(F.lower("canonical").alias("alias"), "canonical", F.lit(0).alias("kind"), "ord")
    rows = own.unionByName(aliases.select(F.lower("alias").alias("alias"), "canonical", F.lit(1).alias("kind"), "ord")).where("alias is not null")
    return rows.groupBy("alias").agg(F.min_by("canonical", F.struct("kind", "ord", "canonical")).alias("canonical"))


def canonicalized(terms: DataFrame, names: DataFrame, column: str = "tok") -> DataFrame:
    """Distinct rows with the canonical name of column in its place; unknown terms stay."""
    known = terms.join(names, F.lower(terms[column]) == names["alias"], "left")
    return known.withColumn(column, F.coalesce("canonical", column)).drop("alias", "canonical").distinct()


def skill_lists(docs: DataFrame) -> DataFrame:
    """pair_id, matched, missing, extra: sorted dictionary terms of both sides, of the right alone and of the left alone."""
    sides = _sided(skills_of(docs)).groupBy("pair_id", "tok").agg(F.bool_or("is_left").alias("l"), F.bool_or(~F.col("is_left")).alias("r"))
    listed = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("tok"))))
    return sides.groupBy("pair_id").agg(listed(F.col("l") & F.col("r")).alias("matched"), listed(~F.col("l")).alias("missing"), listed(~F.col("r")).alias("extra"))


def missing_skills(docs: DataFrame, k: int = 12) -> DataFrame:
    """pair_id, rank, tok, mentions, severity: the right's dictionary terms that the left lacks, most mentioned first."""
    skills = _sided(skills_of(docs)).groupBy("pair_id", "tok").agg(F.bool_or("is_left").alias("l")).where("not l").select("pair_id", "tok")
    mentions = _sided(content_rows(docs)).where("not is_left").groupBy("pair_id", "tok").agg(F.count(F.lit(1)).alias("mentions"))
    rows = skills.join(mentions, ["pair_id", "tok"]).withColumn("severity", F.when(F.col("mentions") >= 3, "high").when(F.col("mentions") == 2, "medium").otherwise("low"))
    best = Window.partitionBy("pair_id").orderBy(F.col("mentions").desc(), "tok")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def deduplicated(advice: DataFrame, key: str = "doc_id") -> DataFrame:
    """Advice (category, priority, impact, message) without repeats: of equal category and start of message, then of equal message, the first stays."""
    order = [F.col("priority"), F.col("impact").desc(), F.col("message"), F.col("category")]
    by = lambda *c: Window.partitionBy(key, *c).orderBy(*order)
    once = advice.withColumn("__n", F.row_number().over(by("category", F.substring("message", 1, 60)))).where("__n = 1")
    return once.withColumn("__n", F.row_number().over(by(F.substring("message", 1, 80)))).where("__n = 1").drop("__n")


def recommendations(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, rank, category, message: the k most urgent pieces of advice for each document."""
    rows = [
        F.when(F.col(c) == 0, F.struct(F.lit(cat).alias("category"), F.lit(prio).alias("priority"), F.lit(impact).alias("impact"), F.lit(text).alias("message"))) for c, (cat, prio, impact, text) in ADVICE.items()
    ]
    advice = deduplicated(checks(docs).select("doc_id", F.inline(F.array_compact(F.array(*rows)))))
    first = Window.partitionBy("doc_id").orderBy("priority", F.col("impact").desc(), "message")
    return advice.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("doc_id", "rank", "category", "message")
