"""Blocks of the top-k search."""

import numpy as np
from pyspark.sql import functions as F

from docpair.llm import topk


def test_no_task_takes_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "ROW_BLOCK", 3)  # many small blocks, some without rows
    rng = np.random.default_rng(2)
    x = rng.integers(-4, 5, (60, 6))
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 7 == 0, k=4)
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
    got = sorted(map(tuple, found.collect()))
    want = [(q, r + 1, c, s) for q in range(0, 60, 7) for r, (s, c) in enumerate(sorted(((int(x[q] @ x[c]), c) for c in range(60) if c != q), key=lambda p: (-p[0], p[1]))[:4])]
    assert got == want
