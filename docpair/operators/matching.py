"""Skills of pairs: exact, fuzzy and semantic matches, metrics, groups and gaps.

Each document's skills become one row, once, whatever the number of its pairs; a pair is one row with both lists, in which
all is decided; a row for each skill is made last.

pairs: pair_id, left_id, right_id. left and right: doc_id, skill, category, each skill of a document once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import alike
from ..functions.rows import held, let


def skill_lists(skills: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, skills: an array of key (the name in lower case), skill, category and more columns, sorted, each key once."""
    once = skills.groupBy("doc_id", F.lower("skill").alias("key")).agg(F.min("skill").alias("skill"), F.min("category").alias("category"), *[F.min(c).alias(c) for c in more])
    return once.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("key", "skill", "category", *more))).alias("skills"))


def skills_in_row(listed: Column, more: tuple[str, ...] = ()) -> Column:
    """The array of skill_lists(), of an array of skill, category and more columns in a document's row."""
    fields = ("skill", "category", *more)
    keyed = F.sort_array(F.transform(listed, lambda x: F.struct(F.lower(x["skill"]).alias("key"), *[x[c].alias(c) for c in fields])))
    least = lambda of, c: F.array_min(F.transform(of, lambda x: x[c])).alias(c)
    once = lambda xs, keys: F.transform(keys, lambda k: let(F.filter(xs, lambda x: x["key"] == k), lambda of: F.struct(k.alias("key"), *[least(of, c) for c in fields])))
    return let(keyed, lambda xs: let(F.array_distinct(F.transform(xs, lambda x: x["key"])), lambda keys: F.when(F.size(keys) == F.size(xs), xs).otherwise(once(xs, keys))))


def paired(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs with lefts and rights: the lists of skill_lists() of both documents; empty ones where a document has no skills."""
    side = lambda lists, of, name: lists.select(F.col("doc_id").alias(of), F.col("skills").alias(name))
    rows = pairs.join(side(left, "left_id", "lefts"), "left_id", "left").join(side(right, "right_id", "rights"), "right_id", "left")
    kinds = dict(rows.dtypes)
    return rows.withColumns({n: F.coalesce(n, F.array().cast(kinds[n])) for n in ("lefts", "rights")})


def _partly(names: list[str], wanted: list[str], vectors: dict, fuzzy: float | None, semantic: float) -> list[tuple]:
    """Of one pair the wanted skills that are alike one of names: (wanted, name, similarity, match_type)."""
    rows, used, open_ = [], set(), []
    for skill in wanted:
        scores = [(-1.0 if i in used else alike(skill, other)) for i, other in enumerate(names)] if fuzzy is not None else []
        best = int(np.argmax(scores)) if scores else -1
        if best >= 0 and scores[best] >= fuzzy:
            used.add(best)
            rows.append((skill, names[best], round(scores[best] / 100, 4), "fuzzy"))
        else:
            open_.append(skill)
    free = [i for i in range(len(names)) if i not in used and names[i] in vectors]
    for skill in open_ if free else []:
        if skill not in vectors:
            continue
        a, b = np.array(vectors[skill], float), np.array([vectors[names[i]] for i in free], float)
        size = np.linalg.norm(a) * np.linalg.norm(b, axis=1)
        cosine = np.divide(b @ a, size, out=np.zeros(len(free)), where=size > 0).clip(0, 1)
        best = int(cosine.argmax())
        if cosine[best] >= semantic:
            rows.append((skill, names[free[best]], round(float(cosine[best]), 4), "semantic"))
    return rows


def match_lists(rows: DataFrame, fuzzy: float | None = 85.0, vectors: DataFrame | None = None, semantic: float = 0.72) -> DataFrame:
    """rows of paired() with matches: an array of skill, status, other, similarity, match_type, category, as skill_matches() says."""
    keys = lambda c: F.transform(c, lambda x: x["key"])
    rows = rows.withColumn("__both", held(F.array_intersect(keys("lefts"), keys("rights"))))
    alone = lambda c: F.filter(c, lambda x: ~F.array_contains("__both", x["key"]))
    rows = rows.withColumns({"__l": held(alone("lefts"))}).withColumns({"__r": held(alone("rights"))})
    if fuzzy is None and vectors is None:
        rows = rows.withColumn("__partly", F.array().cast(PARTLY))
    else:
        rows = _with_partly(rows, fuzzy, vectors, semantic)

    def entry(x: Column, status: str, other: Column | None = None, similarity: Column | None = None, kind: Column | None = None, category: Column | None = None) -> Column:
        blank = lambda v, t: F.lit(None).cast(t) if v is None else v
        return F.struct(
            x["skill"].alias("skill"), F.lit(status).alias("status"), blank(other, "string").alias("other"), blank(similarity, "double").alias("similarity"), blank(kind, "string").alias("match_type"),
            (x["category"] if category is None else category).alias("category"),
        )

    mate = lambda x: F.filter("lefts", lambda y: y["key"] == x["key"])[0]
    exact = F.transform(F.filter("rights", lambda x: F.array_contains("__both", x["key"])), lambda x: let(mate(x), lambda y: entry(x, "matched", y["skill"], F.lit(1.0), F.lit("exact"), F.least(x["category"], y["category"]))))
    of = lambda x: F.get(F.filter("__partly", lambda p: p["r"] == x["skill"]), F.lit(0))
    wanted = F.transform("__r", lambda x: let(of(x), lambda p: F.when(p.isNull(), entry(x, "missing")).otherwise(entry(x, "partial", p["other"], p["similarity"], p["match_type"]))))
    extra = F.transform(F.filter("__l", lambda x: ~F.exists("__partly", lambda p: p["other"] == x["skill"])), lambda x: entry(x, "extra"))
    return rows.withColumn("matches", held(F.concat(exact, wanted, extra))).drop("__both", "__l", "__r", "__partly")


PARTLY = "array<struct<r:string,other:string,similarity:double,match_type:string>>"


def _with_partly(rows: DataFrame, fuzzy: float | None, vectors: DataFrame | None, semantic: float) -> DataFrame:
    """Adds __partly, of the skills of __l and __r, which no skill of the other side equals."""
    if vectors is not None:  # of each side the vectors, as a map by skill
        tagged = rows.select("pair_id", F.explode(F.array_distinct(F.transform(F.concat("__l", "__r"), lambda x: x["skill"]))).alias("skill")).join(vectors.select("skill", F.col("vector").cast("array<double>").alias("vector")), "skill")
        rows = rows.join(tagged.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("skill", "vector"))).alias("__v")), "pair_id", "left")
    else:
        rows = rows.withColumn("__v", F.lit(None).cast("map<string,array<double>>"))
    names = lambda c: F.transform(c, lambda x: x["skill"])

    @F.pandas_udf(PARTLY)
    def partly(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lefts, rights, maps in parts:
            found = [_partly(list(a), list(b), dict(v) if v is not None else {}, fuzzy, semantic) for a, b, v in zip(lefts, rights, maps, strict=True)]
            yield pd.Series([[dict(zip(("r", "other", "similarity", "match_type"), row, strict=True)) for row in rows] for rows in found])

    some = (F.size("__l") > 0) & (F.size("__r") > 0)
    empty = F.array().cast("array<string>")
    return rows.withColumn("__partly", partly(F.when(some, names("__l")).otherwise(empty), F.when(some, names("__r")).otherwise(empty), F.col("__v"))).drop("__v")


def matches_of(rows: DataFrame) -> DataFrame:
    """pair_id, skill, status, other, similarity, match_type, category: a row for each entry of match_lists()."""
    return rows.select("pair_id", F.inline_outer("matches")).where("skill is not null")


def skill_matches(pairs: DataFrame, left: DataFrame, right: DataFrame, fuzzy: float | None = 85.0, vectors: DataFrame | None = None, semantic: float = 0.72) -> DataFrame:
    """pair_id, skill, status (matched, partial, missing or extra), other, similarity, match_type, category.

    A skill of the right is matched if the left has it, without regard to case. One that is left over, in the order of
    names, is partly matched by the most alike unused skill of the left, from `fuzzy` on, the first of equal ones; that one is
    used up. What is still left over is partly matched by the nearest vector (skill, vector) of a left skill that fuzzy
    matches didn't use, from `semantic` on; several may share one. Else it is missing. Skills of the left that nothing used are extra.
    """
    return matches_of(match_lists(paired(pairs, skill_lists(left), skill_lists(right)), fuzzy, vectors, semantic))


def metrics_of(matched: Column, partial: Column, missing: Column, extra: Column) -> Column:
    """A struct of the four counts, recall, precision, f1 and score. A partial match counts half. Without skills on the right
    the score is 100 if the left has any, else 0."""
    got, wanted = matched + 0.5 * partial, matched + partial + missing
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, q = ratio(got, matched + partial + extra), ratio(got, wanted)
    score = F.when(wanted > 0, F.least(F.lit(100.0), 100 * got / wanted)).otherwise(F.when(extra > 0, 100.0).otherwise(0.0))
    counts = [c.cast("long").alias(n) for n, c in (("matched", matched), ("partial", partial), ("missing", missing), ("extra", extra))]
    return F.struct(*counts, F.round(q, 4).alias("recall"), F.round(p, 4).alias("precision"), F.round(ratio(2 * p * q, p + q), 4).alias("f1"), F.round(score, 2).alias("score"))


def with_metrics(rows: DataFrame) -> DataFrame:
    """rows of match_lists() with metrics: the struct of metrics_of()."""
    count = lambda s: F.size(F.filter("matches", lambda m: m["status"] == s))
    return rows.withColumn("metrics", metrics_of(*map(count, ("matched", "partial", "missing", "extra"))))


def skill_metrics(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """pair_id and the fields of metrics_of(), of rows of skill_matches(); zeros for pairs without any."""
    names = ("matched", "partial", "missing", "extra")
    rows = pairs.select("pair_id").join(matches.groupBy("pair_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in names]), "pair_id", "left").na.fill(0)
    return rows.select("pair_id", metrics_of(*map(F.col, names)).alias("m")).select("pair_id", "m.*")


def by_category(matches: DataFrame) -> DataFrame:
    """pair_id, status, category, skills: matched and missing skills of each category, sorted without regard to case."""
    lists = matches.where("status in ('matched', 'missing')").groupBy("pair_id", "status", F.coalesce("category", F.lit("other")).alias("category"))
    return lists.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("skill").alias("k"), "skill"))), lambda x: x["skill"]).alias("skills"))


def gaps_of(matches: Column, rights: Column) -> Column:
    """Missing skills: an array of rank, skill, category, importance, mentions. Required ones (kind) come first, then those that blocks
    don't tell, then preferred ones; of each the most mentioned, then by name. rights are skill_lists() with kind and n."""
    of = lambda m: F.get(F.filter(rights, lambda x: x["skill"] == m["skill"]), F.lit(0))
    order = lambda kind: F.when(kind == "required", 0).when(kind == "preferred", 2).otherwise(1)
    entry = lambda m, x: F.struct(order(x["kind"]).alias("order"), (-F.greatest(F.coalesce(x["n"], F.lit(1)), F.lit(1))).cast("long").alias("less"), m["skill"].alias("skill"), F.coalesce(m["category"], F.lit("other")).alias("category"))
    found = F.transform(F.filter(matches, lambda m: m["status"] == "missing"), lambda m: let(of(m), lambda x: entry(m, x)))
    importance = lambda o: F.when(o == 0, "high").when(o == 2, "low").otherwise("medium")
    return F.transform(F.array_sort(found), lambda x, i: F.struct((i + 1).alias("rank"), x["skill"].alias("skill"), x["category"].alias("category"), importance(x["order"]).alias("importance"), (-x["less"]).alias("mentions")))


def skill_gaps(rows: DataFrame) -> DataFrame:
    """pair_id and the fields of gaps_of(), a row for each; rows are those of match_lists()."""
    return rows.select("pair_id", F.inline_outer(gaps_of(F.col("matches"), F.col("rights")))).where("skill is not null")
