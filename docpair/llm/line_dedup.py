"""Line dedup with DataFrame functions only.

Lines are exploded, stripped and hashed; distinct documents are counted for each hash; lines of a hash found in enough
documents go, except in the largest document that holds it; the rest is reassembled by position.

A slim row (16 bytes of hash, id, position) for each long line is written once and read twice. It is shuffled as distinct
(line, document) for the counts and once more to meet the lines that go. A line that a third of the corpus holds is
pre-aggregated, first to distinct (line, document), then to partial counts. Where its occurrences are looked up, it
would land in one task. So lines in more documents than one COMMONth of all slim rows, which are fewer than COMMON
whatever the input, meet their occurrences by a broadcast, and all others by a join. The texts are shuffled once, by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, cut, discarded, stored

COMMON = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends, A-Z in lower case; other letters stay."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.char_length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns docs with text_col rewritten, and the columns n_lines and n_dropped (long).

    A null or empty text is one empty line and comes back empty. A null id counts as one document, smaller than any
    other. Rows that repeat an id are one document; each row is rewritten by its own lines. Lines that tie keep their
    places. Other columns pass through; n_lines and n_dropped replace columns of these names. An empty table stays so.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]
    texts = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("__id"), F.xxhash64(texts).alias("__text_id"), F.posexplode(F.split(texts, "\n")).alias("__pos", "__line"))
    keyed = split.withColumn("__key", line_key(F.col("__line"))).where(F.char_length("__key") >= min_chars)
    keyed, keyed_path = stored(keyed.select("__id", "__text_id", "__pos", F.unhex(F.md5("__key")).alias("__hash")))

    found = keyed.select("__hash", "__id").distinct().groupBy("__hash").agg(F.count(F.lit(1)).alias("__docs"), F.max("__id").alias("__last"))
    found = cut(found.where(F.col("__docs") >= min_docs))
    common = found.where(F.col("__docs") * COMMON > keyed.count()).select("__hash", "__last")
    seldom = keyed.join(F.broadcast(common.select("__hash")), "__hash", "left_anti").join(found.select("__hash", "__last"), "__hash")
    met = keyed.join(F.broadcast(common), "__hash").unionByName(seldom)
    gone = met.where(~F.col("__id").eqNullSafe(F.col("__last")))
    gone, _ = stored(gone.groupBy(F.col("__id").alias("__gid"), F.col("__text_id").alias("__gtext")).agg(F.collect_set("__pos").alias("__gone")))
    discarded(docs.sparkSession, keyed_path)

    whole = docs.select(F.col(id_col).alias("__id"), texts.alias("__text"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(others)])
    whole = whole.withColumn("__text_id", F.xxhash64("__text"))
    joined = whole.join(gone, F.col("__id").eqNullSafe(F.col("__gid")) & (F.col("__text_id") == F.col("__gtext")), "left")
    joined = joined.withColumn("__lines", F.split("__text", "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(places, lambda p: F.col("__lines")[p]), "\n")
    out = {id_col: F.col("__id"), text_col: F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(kept)} | {c: F.col(f"__o{i}") for i, c in enumerate(others)}
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*[out[c].alias(c) for c in order], F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
