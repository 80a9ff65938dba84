"""The table of past analyses (id, created_at, overall_score, grade): pages, retention, aggregates; and intervals."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import grade


def analyses(events: DataFrame) -> DataFrame:
    """A history made of the events table: the value is the score."""
    score = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("value"))), 1)
    return events.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", "event_type", score.alias("overall_score"), grade(score).alias("grade"))


def page(history: DataFrame, number: int, size: int) -> DataFrame:
    """One page, newest first, ties by id; empty past the end."""
    return history.orderBy(F.col("created_at").desc(), "id").offset((number - 1) * size).limit(size)


def keyset_page(history: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """One page behind a cursor, newest first, ties by id: the rows of the page with n, pages (of all rows), next_at and next_id.

    after is the (created_at, id) of the last row of the page before, which next_at and next_id give; None for the first page.
    The rows before the cursor are filtered, not sorted, so a page costs the same wherever it is. size is held within 1 and
    100. The next cursor is null on a page that isn't full; a page past the end has no rows.
    """
    size = min(100, max(1, size))
    order = [F.col("created_at").desc(), F.col("id")]
    behind = history
    if after is not None:
        at, id_ = F.lit(after[0]).cast(dict(history.dtypes)["created_at"]), F.lit(after[1])
        behind = history.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > id_)))
    rows = behind.orderBy(*order).limit(size)
    last = rows.agg(F.count(F.lit(1)).alias("__rows"), F.max_by(F.struct("created_at", "id"), F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), "id")).alias("__last"))
    whole = history.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(last))  # one row each
    whole = whole.select("n", F.ceil(F.col("n") / size).cast("long").alias("pages"), F.when(F.col("__rows") == size, F.col("__last")).alias("__next"))
    return rows.join(F.broadcast(whole)).select(*history.columns, "n", "pages", F.col("__next.created_at").alias("next_at"), F.col("__next.id").alias("next_id"))


def retained(history: DataFrame, days: int) -> DataFrame:
    """Rows not older than so many days before the newest row; all if days is 0 or less."""
    if days <= 0:
        return history
    newest = history.agg(F.max("created_at").alias("__newest"))
    return history.join(F.broadcast(newest), F.col("created_at") >= F.col("__newest") - F.expr(f"interval {days} days")).drop("__newest")


def totals(history: DataFrame) -> DataFrame:
    s = F.col("overall_score")
    return history.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 2).alias("avg_score"), F.max(s).alias("max_score"), F.min(s).alias("min_score"))


def by_grade(history: DataFrame) -> DataFrame:
    return history.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


def admissions(history: DataFrame, limit: int = 1) -> DataFrame:
    """user_id, hour, n, rejected: requests of each user in each hour, and those beyond the limit."""
    counts = history.groupBy("user_id", F.date_trunc("hour", "created_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rejected", F.greatest(F.lit(0), F.col("n") - limit).cast("long"))


def merged_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, first, last, parts, months: overlapping or touching intervals of a key joined, and the months they touch, both ends included."""
    ahead = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    islands = marked.withColumn("__island", F.sum("__new").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(key, "__island").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count(F.lit(1)).alias("parts")).drop("__island")
    if dict(rows.dtypes)[start] != "date":
        return out
    return out.withColumn("months", (F.year("last") - F.year("first")) * 12 + F.month("last") - F.month("first") + 1)


def sections(docs: DataFrame, most_chars: int = 40) -> DataFrame:
    """doc_id, heading_no, n_lines, n_chars: lines up to the next short line, which opens a section; 0 is what stands before the first."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    head = (F.char_length("line") <= most_chars) & (F.col("line") != "")
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("heading_no", F.sum(head.cast("int")).over(so_far))
    return numbered.groupBy("doc_id", "heading_no").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


def lookup(history: DataFrame, key: object, column: str = "id") -> DataFrame:
    """The row of a key; empty if there is none."""
    return history.where(F.col(column) == F.lit(key))


def projected(history: DataFrame, column: str, shape: str, most: int = 6) -> DataFrame:
    """Fields of a JSON column in its place; lists keep their first entries. Broken JSON gives nulls."""
    fields = history.withColumn("__j", F.from_json(column, shape))
    cut = [F.slice(f"__j.{f.name}", 1, most).alias(f.name) if f.dataType.typeName() == "array" else F.col(f"__j.{f.name}") for f in fields.schema["__j"].dataType.fields]
    return fields.select(*[c for c in history.columns if c != column], *cut)


def top_values(history: DataFrame, values: str, k: int = 8) -> DataFrame:
    """value, n: the k most frequent non-empty entries of a list column, ties by value."""
    rows = history.select(F.explode(values).alias("value")).select(F.trim("value").alias("value")).where("value <> ''")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


def score_ranks(history: DataFrame, key: str = "user_id") -> DataFrame:
    """id, percentile: the share of a key's rows with a lower score, in percent; a key's rows are first counted by score."""
    counts = history.groupBy(key, "overall_score").agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy(key).orderBy("overall_score").rowsBetween(Window.unboundedPreceding, -1))
    of_all = F.sum("n").over(Window.partitionBy(key))
    ranks = counts.select(key, "overall_score", F.round(100.0 * F.coalesce(below, F.lit(0)) / of_all, 2).alias("percentile"))
    return history.join(ranks, [key, "overall_score"]).select("id", "percentile")


def rehydrated(history: DataFrame, column: str, shape: str) -> DataFrame:
    """history with a JSON column as a struct of a declared shape, besides its other columns; unknown fields are left out, missing ones are
    null, and so is the struct of broken JSON."""
    parsed = F.from_json(column, shape, {"mode": "PERMISSIVE"})
    broken = F.col(column).isNull() | F.try_parse_json(column).isNull()
    return history.withColumn(column, F.when(~broken, parsed))


def without_expired(history: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and rows to delete, which are more than so many days older than the newest; none if days is 0 or less."""
    if days <= 0:
        return history, history.limit(0)
    newest = history.agg(F.max("created_at").alias("__newest"))
    marked = history.join(F.broadcast(newest)).withColumn("__old", F.col("created_at") < F.col("__newest") - F.expr(f"interval {days} days"))
    return marked.where("not __old").drop("__newest", "__old"), marked.where("__old").drop("__newest", "__old")


def saved(batch: DataFrame, path: str, batch_id: int) -> None:
    """Writes a batch of history as partitions by day and batch; a batch that is written again replaces itself, so a rerun leaves equal rows.

    For foreachBatch of a stream, and for jobs that may be repeated. Only the batch's own partitions are replaced; one
    that had rows on another day before must first be taken out by without_batch().
    """
    rows = batch.withColumns({"day": F.to_date("created_at"), "batch": F.lit(batch_id).cast("long")})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def _partitions(spark: SparkSession, path: str, depth: int) -> list:
    """The folders of partitions, as Hadoop paths."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*" + "/*" * (depth - 1))
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return [f.getPath() for f in found if f.isDirectory()]


def _removed(spark: SparkSession, paths: list) -> int:
    for p in paths:
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def without_batch(spark: SparkSession, path: str, batch_id: int) -> int:
    """Deletes a batch's partitions; how many there were."""
    return _removed(spark, [p for p in _partitions(spark, path, 2) if p.getName() == f"batch={batch_id}"])


def purged(spark: SparkSession, path: str, days: int, today: str) -> int:
    """Deletes whole days that are more than so many days before today, without reading a row; how many days went. None if days is 0 or less.

    It may run at any time and again: a day that is gone stays gone.
    """
    if days <= 0:
        return 0
    limit = date.fromisoformat(today) - timedelta(days=days)
    old = lambda name: name.startswith("day=") and name != "day=__HIVE_DEFAULT_PARTITION__" and date.fromisoformat(name[4:]) < limit
    return _removed(spark, [p for p in _partitions(spark, path, 1) if old(p.getName())])
