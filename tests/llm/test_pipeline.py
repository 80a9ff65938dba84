"""The pipeline's stages on odd tables, and each against a plain version of its rule."""

from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline


def test_last_stage_decodes_its_ids(spark):
    docs = spark.createDataFrame([(0, "s", "en", "some words\n and  é 😀"), (1, "s", "en", ""), (2, None, None, None)], "doc_id long, source string, lang string, text string")
    out = corpus_pipeline.to_tokens(spark, docs, SF).join(docs.select("doc_id", "text"), "doc_id")
    assert out.where(F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)).count() == 3
    assert out.where("n_tokens > 0").count() == 1


def test_stages_take_odd_tables(spark):
    shape = spark.read.parquet(f"{SF}/documents.parquet").schema
    line = "a line that many documents share"
    rows = [(i, f"{line}\nown words of {i} " + " ".join(f"w{i}x{k}" for k in range(30)), "en", "a", 9) for i in range(6)]
    rows += [(6, None, None, None, None), (7, "", "en", "b", 0), (None, "no id here at all, my friend", "en", "b", 5), (8, rows[0][1], "en", "a", 9), (8, rows[0][1], "en", "a", 9), (9, line, "en", "b", 3)]
    for some in (rows, rows[6:7], []):
        docs = spark.createDataFrame(some, shape)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            got = [tuple(r) for r in out.collect()]
            if name == "toxicity":  # nothing toxic here
                assert sorted(map(str, got)) == sorted(map(str, some))
            if name == "line_dedup" and some == rows:
                kept = {(r[0], r[1]) for r in got}
                assert (9, line) in kept and (0, rows[0][1].split("\n")[1]) in kept and (6, "") in kept and len(got) == len(rows)
                assert all(r[4] == len(r[1]) for r in got)
            if name == "near_dedup" and some == rows:  # 8 is a copy of 0
                assert sorted(map(str, (r[0] for r in got))) == sorted(map(str, [0, 1, 2, 3, 4, 5, 6, 7, None, 9]))
            if name == "mixing":
                assert set(map(str, got)) <= set(map(str, some))
        assert len(corpus_pipeline.to_tokens(spark, docs, SF).collect()) == len(some)
