from pyspark.sql import functions as F

from docpair.functions import text as T
from docpair.operators import history, pairs, signals


def test_text_functions(spark):
    df = spark.createDataFrame([("a\x00 \t b\n\n\n\nc ",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(T.collapsed(F.col("text"))).collect()] == ["a b\n\nc", "", None]
    one = spark.createDataFrame([("Hi there. Now 5 p.m. (ok)! Fine",)], "text string")
    assert one.select(T.sentences(F.col("text"))).first()[0] == ["Hi there.", "Now 5 p.m.", "(ok)!", "Fine"]


def test_intervals_that_touch_are_joined(spark):
    rows = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 7, 8), (2, 1, 9), (2, 2, 3)], "k int, s int, e int")
    got = {tuple(r) for r in history.merged_intervals(rows, "k", "s", "e").collect()}
    assert got == {(1, 1, 5, 2), (1, 7, 8, 1), (2, 1, 9, 2)}


def test_equal_pair_has_cosine_one(spark):
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "beta alpha"), (2, None), (3, "x y"), (4, "alpha beta"), (5, "the alpha beta")], "doc_id long, text string")
    # of 0 and 1 the words agree, but not their runs of two: 2 / (2 + (1 + ln 1.5) ** 2)
    assert {r["pair_id"]: r["cosine"] for r in pairs.tfidf_cosine(docs).collect()} == {0: 0.503103, 2: 1.0}


def test_page_past_the_end_is_empty(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6)], "id long, created_at int")
    assert history.page(rows, 3, 10).count() == 0


def test_signals_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "red fox, the red fox and a dog"), (3, "red dog")], "doc_id long, text string")
    assert [r[0] for r in docs.orderBy("doc_id").select(signals.truncated(F.col("text"), 5)).collect()] == [None, "", "red…", "red…"]
    got = {(r["doc_id"], r["phrase"]): (r["n"], r["score"]) for r in signals.key_phrases(docs).collect()}
    assert got == {(2, "red fox"): (2, 8.0), (2, "dog"): (1, 1.0), (3, "red dog"): (1, 4.0)}
    assert {r["doc_id"]: r["score"] for r in signals.checks(docs).collect()} == dict.fromkeys(range(4), 11.1)
    assert [tuple(r) for r in signals.coverage(docs).collect()] == [(1, 2, 2, 1.0)]
