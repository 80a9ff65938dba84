import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from docpair.functions import text as T
from docpair.operators import history, language, ranking, report
from docpair.sources import files


def test_cleaning(spark):
    df = spark.createDataFrame([("Café – ex-\nam ple , b0x ★",), (None,)], "t string")
    assert [r[0] for r in df.select(T.cleaned(F.col("t"))).collect()] == ["Cafe - exam ple, box", None]
    words = spark.createDataFrame([("cities",), ("Walking",), ("glass",), ("cars",), ("red",)], "w string")
    assert [r[0] for r in words.select(T.lemma(F.col("w"))).collect()] == ["city", "walk", "glass", "car", "red"]
    assert spark.range(1).select(T.titled(F.lit("the art of iOS in MAY"))).first()[0] == "The Art of iOS in MAY"


def test_chunks_cover_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    last, seen = {}, set()
    for r in language.chunks(docs, 100, 10).orderBy("doc_id", "start").collect():
        end = r["start"] + len(r["chunk"])
        assert whole[r["doc_id"]][r["start"] : end] == r["chunk"] and len(r["chunk"]) <= 100
        assert r["start"] == (last[r["doc_id"]] - 10 if r["doc_id"] in last else 0)
        last[r["doc_id"]] = end
        seen.add(r["doc_id"])
    assert {i: len(whole[i]) for i in seen} == last and all(not whole[i] for i in set(whole) - seen)


def test_graph_ranks_are_those_of_a_dense_walk(spark):
    text = "stone river stone cloud meadow river stone forest"
    docs = spark.createDataFrame([(1, text), (2, "one two three"), (3, None)], "doc_id long, text string")
    words = text.split()
    names = sorted(set(words))
    m = np.zeros((len(names), len(names)))
    for i, a in enumerate(words):
        for b in words[i + 1 : i + 4]:
            if a != b:
                m[names.index(a), names.index(b)] += 1
                m[names.index(b), names.index(a)] += 1
    m /= m.sum(1, keepdims=True)
    want = np.linalg.solve(np.eye(len(names)) - 0.85 * m.T, np.full(len(names), 0.15 / len(names)))
    got = {r["term"]: r["score"] for r in ranking.graph_ranks(docs).collect()}
    assert set(got) == set(names) and np.allclose([got[n] for n in names], want / want.max(), atol=1e-4)


def test_longest_match_wins(spark):
    docs = spark.createDataFrame([(1, "a b c d b c"), (2, None)], "doc_id long, text string")
    entries = spark.createDataFrame([("a b",), ("a b c",), ("c d",), ("b c",)], "surface string")
    assert [(r["pos"], r["n"], r["surface"]) for r in language.longest_matches(docs, entries).orderBy("pos").collect()] == [(1, 3, "a b c"), (5, 2, "b c")]


def test_advice_is_given_once(spark):
    rows = spark.createDataFrame([(1, "a", 1, 2.0, "m"), (1, "a", 2, 9.0, "m"), (1, "b", 1, 1.0, "m"), (1, "b", 1, 1.0, "n")], "doc_id long, category string, priority int, impact double, message string")
    assert {(r["category"], r["message"]) for r in report.deduplicated(rows).collect()} == {("a", "m"), ("b", "n")}


def test_broken_json_gives_nulls(spark):
    rows = spark.createDataFrame([(1, '{"m": ["a", "b", "c"], "s": 2}'), (2, "{broken"), (3, None)], "id long, j string")
    got = {r["id"]: (r["m"], r["s"]) for r in history.projected(rows, "j", "m array<string>, s int", 2).collect()}
    assert got == {1: (["a", "b"], 2), 2: (None, None), 3: (None, None)}


def test_files(spark, tmp_path):
    for name, content in {"a.txt": "né".encode(), "b.md": "né".encode("latin-1"), "c.pdf": b"%PDF-1", "d.pdf": b"no", "f.exe": b"x", "g.txt": b"%PDF-", "h.txt": b"y" * 300}.items():
        (tmp_path / name).write_bytes(content)
    read = files.read_files(spark, str(tmp_path), 200)
    assert {r["name"]: r["problem"] for r in files.checked(read, 200).collect()} == {"a.txt": None, "b.md": None, "c.pdf": None, "d.pdf": "signature", "f.exe": "kind", "g.txt": "signature", "h.txt": "size"}
    got = files.texts(read.where("name < 'c'"))
    assert {tuple(r) for r in got.collect()} == {("a.txt", "né", "plain_text", 1), ("b.md", "né", "plain_text", 1)}
    assert [d.count() for d in files.parted_by_length(got, 2)] == [2, 0]
    files.save_results(got, f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    (tmp_path / "d.json").write_text('{"k":\n {"A": ["x", "y"], "B": []}}')
    assert {tuple(r) for r in files.dictionary(spark, f"{tmp_path}/d.json").collect()} == {("k", "A", "x"), ("k", "A", "y"), ("k", "B", None)}
