"""Admission of requests on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admission_counts(requests: DataFrame, limit: int = 10, width: str = "1 minute", late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """key, start, n, rejected: requests of each key in each window, and those beyond the limit; works on batches and streams.

    Rows that come later than `late` behind the newest don't count on a stream. State is one count for each open window and key.
    """
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counts = timed.groupBy(key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - limit).cast("long").alias("rejected"))
