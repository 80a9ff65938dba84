"""Audit of how far the sources of a language are apart in the terms they use.

Documents become exact sparse vectors by CountVectorizer, with a minimum of documents and the largest integer as the size
of the vocabulary, so that nothing is cut off. A term is counted with its language before it, so one fit gives each
language a vocabulary of its own. As a fit passes its vocabulary through the driver, terms are dealt into slices by hash,
so many that a slice holds about SLICE terms at most, whatever the input; each slice has a fit of its own. The lists of
terms are dealt and written by slice, so all fits together read them once.

Vectors are summed by group (language and source) as sparse entries, with partial sums first. Pairs of groups are evaluated
in cells: a block of a language's terms against all its groups, where only entries that are not 0 are looked at, and the
rest of a pair follows from how many there are. Each cell returns one sum for each pair.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, cut, discarded, shared_folder, stored

#: A term, as a regular expression that Java, DuckDB and Python read alike: letters A-Z, a-z and all that is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: By byte: A-Z become a-z, and ASCII that parts terms a blank.
PLAIN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
#: Distinct terms of a slice, about (rare ones, which a fit drops before the driver sees them, included); entries of a cell, about; groups of a strip of a cell.
SLICE, CELL, STRIP = 3_000_000, 65_536, 512
#: Of the terms, one in so many by hash is kept apart and counted to tell how many there are.
ONE_IN = 64
LARGEST = 2**31 - 1
SCALE = 1_000_000_000
#: Between a language and a term; no term holds it.
MARK = "\x00"


def group_of(lang: Column, source: Column, salt: int) -> Column:
    """A number for a group; audit() takes a salt with which no two groups share one."""
    return F.xxhash64(lang, source, F.lit(salt))


def term_lists(docs: DataFrame, salt: int = 0, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """group, terms (array), some (array): null values are empty texts; each term has its language and MARK before it.

    some holds one in ONE_IN of the distinct terms of a batch of rows, told by hash, in the batch's first row.
    """
    lang, source, text = (F.coalesce(F.col(c), F.lit("")) for c in (lang_col, source_col, text_col))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            _, offsets, data = text.buffers()  # all that parts terms is ASCII, so bytes can be looked at one by one
            text = pa.StringArray.from_buffers(len(text), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(PLAIN)), offset=text.offset)
            parts = pc.ascii_split_whitespace(text)
            words = parts.flatten()
            full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(parts).to_numpy(zero_copy_only=False))[full]
            terms = pc.binary_join_element_wise(batch.column("before").take(pa.array(row)), words.filter(pa.array(full)), "").cast(pa.string())
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            distinct = terms.unique()
            chosen = distinct.filter(pa.array(pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False) % ONE_IN == 0))
            first = np.append(0, np.full(batch.num_rows, len(chosen)))
            lists = [pa.ListArray.from_arrays(at.astype(np.int32), held) for at, held in ((ends, terms), (first, chosen))]
            yield pa.RecordBatch.from_arrays([batch.column("group"), *lists], ["group", "terms", "some"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(group_of(lang, source, salt).alias("group"), F.concat(lang, F.lit(MARK)).alias("before"), text.alias("text"))
    return rows.mapInArrow(taken, "group long, terms array<string>, some array<string>")


def _slices(lists: DataFrame) -> int:
    return 1 + lists.select(F.explode("some").alias("term")).agg(F.countDistinct("term")).first()[0] * ONE_IN // SLICE


def _dealt(lists: DataFrame, slices: int) -> DataFrame:
    """Each list's terms by slice: slice, group, terms (a slice that has none of a list's terms gets no row)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms").flatten().dictionary_encode()
            of_term = np.array([zlib.crc32(t.encode()) % slices for t in terms.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
            place = row * slices + (of_term[terms.indices.to_numpy()] if len(terms) else 0)
            order = np.argsort(place, kind="stable")
            kept, first = np.unique(place[order], return_index=True)
            lists_ = pa.ListArray.from_arrays(np.append(first, len(order)).astype(np.int32), terms.take(pa.array(order)).cast(pa.string()))
            rows = pa.array(kept // slices)
            yield pa.RecordBatch.from_arrays([pa.array((kept % slices).astype(np.int32)), batch.column("group").take(rows), lists_], ["slice", "group", "terms"])

    bounded_batches(lists.sparkSession)
    return lists.mapInArrow(deal, "slice int, group long, terms array<string>")


def _fitted(lists: DataFrame, min_docs: int, path: str) -> tuple[DataFrame, DataFrame]:
    """One slice's vectors (group, vector) and its vocabulary (index, lang, term)."""
    spark = lists.sparkSession
    # a fit needs some term, so MARK alone, which is no term, comes in enough documents of its own
    filler = spark.range(min_docs).select(F.lit(0).cast("long").alias("group"), F.array(F.lit(MARK)).alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=LARGEST).fit(lists.unionByName(filler))
    model.write().save(path)
    words = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("index", "word")).where(F.col("word") != MARK)
    term = F.substring_index("word", MARK, -1)
    words = words.select("index", F.expr(f"substring(word, 1, char_length(word) - char_length(substring_index(word, '\\u0000', -1)) - {len(MARK)})").alias("lang"), term.alias("term"))
    return model.transform(lists).select("group", "vector"), words


def group_sums(vectors: DataFrame) -> DataFrame:
    """group, index, n: vectors summed by group, entries that are not 0 only."""
    sparse = F.unwrap_udt("vector")
    entry = F.explode(F.arrays_zip(sparse["indices"].alias("index"), sparse["values"].alias("n")))
    return vectors.select("group", entry.alias("e")).groupBy("group", F.col("e.index").alias("index")).agg(F.sum(F.col("e.n").cast("long")).alias("n"))


def smoothed(n: str, whole: str) -> Column:
    """1 + floor(SCALE * (n + 1) / whole) of SQL expressions, in two steps that stay within a long for all counts below 9e13."""
    first, second = 100_000, SCALE // 100_000
    high = f"({first}L * ({n} + 1))"
    return F.expr(f"1 + {second} * ({high} div {whole}) + ({second} * ({high} % {whole})) div {whole}")


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _cell(key, groups: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """lang, source, item, value: the sums over a cell's terms, for each group of the strip and each other group."""
    groups = groups.sort_values("source").reset_index(drop=True)
    names, none = groups["source"], groups["none"].to_numpy(np.int64)
    at = pd.Series(groups.index, names)
    row = at.loc[entries["source"]].to_numpy() if len(entries) else np.zeros(0, np.int64)
    terms, column = np.unique(entries["term_id"].to_numpy(np.int64), return_inverse=True)
    order = np.argsort(row, kind="stable")
    row, column, q = row[order], column[order], entries["p"].to_numpy(np.int64)[order]
    first = np.searchsorted(row, np.arange(len(names)))
    ends = np.searchsorted(row, np.arange(len(names)), "right")
    some = first < ends

    def by_group(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), np.int64)
        if some.any():
            out[some] = np.add.reduceat(values, first[some])
        return out

    out = []
    for a in np.flatnonzero(groups["strip"].to_numpy() == key[2]):
        mine = slice(first[a], ends[a])
        held = np.zeros(len(terms), bool)
        held[column[mine]] = True
        p = np.full(len(terms), none[a])
        p[column[mine]] = q[mine]
        shared = held[column]
        total = by_group(_gap(p[column], q))  # terms of the other group
        total += _gap(q[mine][:, None], none[None]).sum(0) - by_group(np.where(shared, _gap(p[column], none[row]), 0))  # terms of this group only
        both = by_group(shared.astype(np.int64))
        total += (len(terms) - (ends[a] - first[a]) - (ends - first) + both) * _gap(none[a], none)  # terms of neither
        out.append(pd.DataFrame({"lang": groups["lang"].iloc[0], "source": names[a], "item": names, "value": total})[np.arange(len(names)) != a])
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: for each group and each other group of its language, the sum over the language's terms."""
    sizes = groups.groupBy("lang").agg(F.sum("held").alias("held"), F.count(F.lit(1)).alias("groups"))
    sizes = sizes.select("lang", (F.lit(1) + F.floor(F.col("held") / CELL)).cast("int").alias("blocks"), (F.lit(1) + F.floor((F.col("groups") - 1) / STRIP)).cast("int").alias("strips"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = groups.withColumn("strip", F.floor(number / STRIP).cast("int")).join(sizes, "lang").withColumn("block", each("blocks")).withColumn("part", each("strips"))
    dealt = entries.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term_id"), F.col("blocks")).cast("int")).withColumn("part", each("strips"))
    keys = ["lang", "block", "part"]
    left = cells.select(*keys, "source", "none", "strip").groupBy(*keys)
    right = dealt.select(*keys, "source", "term_id", "p").groupBy(*keys)
    found = left.cogroup(right).applyInPandas(_cell, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, most_terms: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Returns lang, source, part, item, value, rank.

    A group is a language and a source that occur together. With the V terms that at least min_docs documents of a language hold, a
    group's share of a term is p = 1 + floor(SCALE * (count + 1) / (N + V)), N the group's count of kept terms; a language's likewise.
    f = floor((p - q)^2 / q). Part 'pair': for each other source of the language, the sum of f over its kept terms, q that source's
    share; 0 without kept terms. Part 'term': kept terms of the group with p above the language's share q, with f; the first most_terms.
    Ranks go from 1 for each group and part, larger values first, ties by UTF-8 order of the item.

    Null languages, sources and texts are empty ones. Each row is a document, also if it repeats another. Very long texts are
    read whole. Other columns play no part. An empty table gives no rows. Sums are 64-bit integers and hold for counts below 9e13.
    """
    spark = docs.sparkSession
    names = cut(docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))]).distinct())
    salt, n_groups = 0, names.count()
    while names.select(group_of(F.col("lang"), F.col("source"), salt)).distinct().count() < n_groups:
        salt += 1
    lists, lists_path = stored(term_lists(docs, salt, lang_col, source_col, text_col))
    slices, lists = _slices(lists), lists.drop("some")
    folder = f"{shared_folder(spark)}/vocabulary-{uuid.uuid4().hex}"
    tables, paths = [], [lists_path]
    if slices > 1:
        paths.append(f"{folder}/lists")
        _dealt(lists, slices).write.partitionBy("slice").parquet(paths[-1])
    for k in range(slices):
        mine = lists if slices == 1 else spark.read.schema("group long, terms array<string>, slice int").parquet(paths[1]).where(F.col("slice") == k).drop("slice")
        vectors, words = _fitted(mine, min_docs, f"{folder}/{k}")
        sums, path = stored(group_sums(vectors))
        term_id = F.lit(k << 32) + F.col("index")
        tables.append((sums.withColumn("term_id", term_id).drop("index"), words.withColumn("term_id", term_id).drop("index")))
        paths.append(path)
    sums, words = (reduce(DataFrame.unionByName, x) for x in zip(*tables, strict=True))

    sizes = words.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    held = sums.groupBy("group").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"))
    groups = names.withColumn("group", group_of(F.col("lang"), F.col("source"), salt)).join(held, "group", "left")
    groups = groups.join(sizes, "lang", "left").na.fill(0, ["n", "held", "v"])
    groups = groups.withColumn("whole", F.col("n") + F.col("v")).withColumn("lang_whole", F.sum("n").over(Window.partitionBy("lang")) + F.col("v"))
    groups = cut(groups.withColumn("none", F.when(F.col("v") > 0, smoothed("0", "greatest(whole, 1)")).otherwise(F.lit(1).cast("long"))))
    held = sums.withColumn("lang_n", F.sum("n").over(Window.partitionBy("term_id"))).join(groups.select("group", "lang", "source", "whole", "lang_whole"), "group")
    held = held.select("lang", "source", "term_id", smoothed("n", "whole").alias("p"), smoothed("lang_n", "lang_whole").alias("q"))
    held, _ = stored(held)
    pairs, _ = stored(_pairs(held, groups))
    above = held.where("p > q").join(words.select("term_id", F.col("term").alias("item")), "term_id")
    above = above.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    out = ranked(pairs, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= most_terms))
    discarded(spark, *paths)
    return out
