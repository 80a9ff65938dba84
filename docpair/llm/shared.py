"""Helpers of the operators in this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The blanks that separate words and are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
#: A word, as a regular expression that Java, DuckDB and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Where that is unset, a temporary one on one machine, an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder that all executors share and reads it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Like cut(), as compressed Parquet, for larger tables; also the path, for discarded()."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def discarded(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing will read again."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of tables that were cut and of which nothing refers to the plan any more.

    Spark deletes them once the driver has collected its garbage, which by itself it may do only every half hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark hand Python tasks at most BATCH_BYTES of rows at a time, unless the session sets a limit of its own.

    Spark's default is 10,000 rows, whatever their size. The setting stays in the session, as frames are lazy.
    """
    spark.conf.set(BATCH_LIMIT, spark.conf.get(BATCH_LIMIT, BATCH_BYTES))


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, order: list[Column], amount: Column, name: str, whole: str | None = None) -> DataFrame:
    """Adds the sum of amount over all rows that come before a row in the global order.

    Rows are dealt into ranges of the order and written once, so that ranges stay as they are; a sum for each range
    (one row a partition) is broadcast. No task sees more than its range. Rows that tie in the whole order may come in
    any order, so order must tell rows apart. whole, if given, names a column that gets the sum over all rows.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__amount", amount)).withColumn("__place", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__range", F.shiftright("__place", 33))
    sums = ranged.groupBy("__range").agg(F.sum("__amount").alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"), F.sum("__sum").over(Window.partitionBy()).alias("__whole"))
    inside = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("__inside", F.coalesce(F.sum("__amount").over(inside), F.lit(0))).join(F.broadcast(sums), "__range")
    out = out.withColumn(name, F.col("__inside") + F.col("__offset"))
    if whole:
        out = out.withColumn(whole, F.col("__whole"))
    return out.drop("__amount", "__place", "__range", "__inside", "__offset", "__sum", "__whole")
