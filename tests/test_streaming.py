from datetime import datetime

from docpair.streaming.admission import admission_counts


def test_stream_counts_as_the_batch_does(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, s)) for s in (1, 2, 3)] + [(1, datetime(2024, 1, 1, 0, 1)), (2, datetime(2024, 1, 1))], "user_id long, ts timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    stream = admission_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), limit=2)
    stream.writeStream.format("memory").queryName("admitted").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(60)
    got = {tuple(r) for r in spark.table("admitted").collect()}
    assert got == {tuple(r) for r in admission_counts(rows, limit=2).collect()} and sorted(r[3] for r in got) == [0, 0, 1]
