"""Mixing sources to target weights.

Words are summed for each source; targets come from the weights, none above a multiple of its source; a source's rate
is its target over its words. A document is emitted floor(rate) times, plus one copy drawn by a Bernoulli trial with
the rate's fraction as its probability, seeded by a hash of the document's id.

So that a few long documents don't leave a small source far off its target, a source's trials are balanced by size. Its
documents are put into bins of like size (an eighth of a power of two). A bin's number of copies is what the running product of
fraction and documents, from a start that is a hash of the source, passes by whole numbers; the copies go to the documents of the bin
with the smallest hashes. Over all hashes each document has just the stated probability, whatever its source's size; but
trials of one source aren't independent. A draw is told by one number a bin, so texts aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, running_total, words_in

SEED = "mix-3"
CIRCLE = 1 << 52
MOST_BROADCAST = 100_000  # bins of sources, of which one row each may be broadcast
D = "decimal(19,0)"


def _level(ranked: DataFrame, most: int) -> tuple[int, int]:
    """The common target for a weight of 1, as a fraction, once what exceeds the caps is shared again by weight.

    Sources are capped in the order of their words for a weight; running totals tell what the others share once all before one
    are capped, and the first that it needn't cap gives the level. One row comes to the driver.
    """
    ratio = [(F.col("source_size") / F.col("__weight")).alias("ratio"), F.col("source").asc_nulls_last()]
    rows = running_total(ranked.select("source", "source_size", "__weight"), ratio, F.col("source_size"), "__size_before", "__total")
    rows = cut(running_total(rows, ratio, F.col("__weight"), "__weight_before", "__weights"))
    left, weights = (F.col("__total") - most * F.col("__size_before")).cast(D), (F.col("__weights") - F.col("__weight_before")).cast(D)
    open_ = most * F.col("source_size").cast(D) * weights >= F.col("__weight").cast(D) * left
    first = rows.where(open_).agg(F.min_by(F.struct(left.alias("num"), weights.alias("den")), "__weight_before")).first()[0]
    return (int(first["num"]), int(first["den"])) if first else (0, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """From columns source and size: source, source_size (long), target (double), one row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_total(totals, [F.col("source").asc_nulls_last()], F.lit(1), "__rank")
    ranked = ranked.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")))
    ranked = cut(ranked)
    num, den = _level(ranked, most)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("__weight") * F.lit(float(num)) / F.lit(float(den)))
    return ranked.select("source", "source_size", target.alias("target"))


def _place(key: Column) -> Column:
    """A place on the circle, 0 to CIRCLE - 1, from a hash of a key; a null key hashes as an empty string."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def _bin(size: Column) -> Column:
    """The bin of a size: its length in bits, and its first three bits. Larger sizes have no smaller bin."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0)))).cast("int")


def _cutoffs(sizes: DataFrame, rates: DataFrame, by_source) -> DataFrame:
    """__of, __bin, __cutoff: up to which place the documents of each bin with copies of their own get one more."""
    counts = sizes.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(by_source(rates.select("__source", "__part")), F.col("source").eqNullSafe(F.col("__source")))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    passed = lambda n: F.floor((F.col("__part").cast("decimal(20,0)") * n.cast("decimal(18,0)") + _place(F.concat(F.lit("source:"), F.coalesce("source", F.lit("")))).cast(D)) / F.lit(CIRCLE).cast("decimal(17,0)")).cast("long")
    drawn = counts.withColumn("__upto", F.sum("n").over(upto))
    drawn = drawn.withColumn("k", passed(F.col("__upto")) - passed(F.col("__upto") - F.col("n"))).where("k > 0").select(F.col("source").alias("__s"), F.col("bin").alias("__b"), "k")
    order = [F.col("source").asc_nulls_last(), F.col("bin"), F.col("place")]
    ranked = cut(running_total(sizes.select("source", "bin", "place"), order, F.lit(1), "__rank"))
    first = ranked.groupBy(F.col("source").alias("__s2"), F.col("bin").alias("__b2")).agg(F.min("__rank").alias("__first"))
    ends = drawn.join(first, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__b") == F.col("__b2"))).select(F.col("__s").alias("__of"), F.col("__b").alias("__bin"), (F.col("__first") + F.col("k") - 1).alias("__at"))
    return ranked.join(ends, F.col("__rank") == F.col("__at")).select("__of", "__bin", F.col("place").alias("__cutoff"))


def _with_plan(docs: DataFrame, weights: tuple[int, ...], most: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Adds to docs: __size, __source_size, __target, __copies."""
    sizes = docs.select(_place(F.col(id_col)).alias("place"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    sizes = cut(sizes.withColumn("bin", _bin(F.col("size"))))
    targets = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rates = cut(targets.withColumn("__rate", rate).select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.floor("__rate").cast("int").alias("__whole"),
        F.floor((F.col("__rate") - F.floor("__rate")) * F.lit(float(CIRCLE))).alias("__part"),
    ))
    small = lambda df, rows: F.broadcast(df) if rows <= MOST_BROADCAST else df
    n_rates = rates.count()
    cutoffs = cut(_cutoffs(sizes, rates, lambda df: small(df, n_rates)))
    planned = docs.withColumn("__size", words_in(F.col(text_col))).join(small(rates, n_rates), F.col(source_col).eqNullSafe(F.col("__source")))
    planned = planned.join(small(cutoffs, cutoffs.count()), F.col(source_col).eqNullSafe(F.col("__of")) & (_bin(F.col("__size")) == F.col("__bin")), "left")
    return planned.withColumn("__copies", F.col("__whole") + F.coalesce(_place(F.col(id_col)) <= F.col("__cutoff"), F.lit(False)).cast("int"))


def copies_by_document(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Returns id_col, the source, size, source_size, target, copies and taken, a row for each document.

    Null texts have size 0. Sources are in order of code points, null last, and weigh by the weights in turn. Documents
    that tie in size are told apart by their ids; rows that repeat an id and a size share one trial, and so do null ids. No
    row gets more than `most` copies. Sources without words get a target of 0 and no copies. Very long texts are counted
    whole. Other columns are left out. An empty table gives no rows.
    """
    columns = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__in"), F.col(text_col).alias("__text"))
    out = _with_plan(columns, weights, most, "__id", "__text", "__in")
    return out.select(
        F.col("__id").alias(id_col), F.col("__in").alias(source_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__copies").alias("copies"), (F.col("__size") * F.col("__copies")).cast("long").alias("taken"),
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Returns docs with each row repeated as often as copies_by_document() says; rows without a copy go. Texts aren't shuffled.

    Nulls, ties, repeated rows and empty tables: as there. All columns stay, but none may be named like the plan's own (__copies,
    __size and so on): these are an error.
    """
    planned = _with_plan(docs, weights, most, id_col, text_col, source_col).where(F.col("__copies") > 0)
    return planned.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
