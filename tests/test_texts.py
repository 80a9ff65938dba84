"""Words in sentences, plain forms, contacts, vectors, pages and stored history: edge rows and plain versions."""

import random
import re
import sys
import time
import unicodedata
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from docpair.functions import normal
from docpair.functions.text import titled
from docpair.operators import comparing, dates, grammar, history, language, matching, sections, similarity, spans, stages, terms


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def tokenisers(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count(r"[\p{L}\p{N}]+")


def test_the_tokeniser_is_in_the_plan_once(spark):
    assert tokenisers(terms.bigram_counts(docs_of(spark, "a"))) == 1
    rows = {r["doc_id"]: tuple(r)[1:] for r in terms.bigram_counts(docs_of(spark, "red blue red blue", "alone", None, "the of")).collect()}
    assert rows == {0: (3, 2)}


def test_sections_of_null_and_repeated_ids(spark):
    rows = [(None, "Skills\nred"), (1, "Skills\nblue"), (1, "Education\nschool"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["name"], r["text"]) for r in sections.sections(docs).collect()) == [("1", "education", "school"), ("1", "skills", "blue"), ("None", "skills", "red")]
    assert dates.with_experience(docs, "2020-01-01").count() == 4 and dates.with_degrees(docs).count() == 4
    plan = dates.with_degrees(dates.with_experience(docs, "2020-01-01"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def plain_relations(tags, words):
    """The rules word by word."""
    verb = [i for i, (t, w) in enumerate(zip(tags, words, strict=True)) if t == "VERB" and not w.lower().endswith("ing")] or [i for i, t in enumerate(tags) if t == "VERB"]
    root = (verb or [i for i, t in enumerate(tags) if t in ("NOUN", "PROPN", "PRON", "ADJ", "NUM")] or [0])[0]
    out, subject, opened = [], False, None
    for i, (t, w) in enumerate(zip(tags, words, strict=True)):
        noun = next((j for j in range(i + 1, min(i + 4, len(tags))) if tags[j] in ("NOUN", "PROPN")), root)
        if i == root:
            out.append(("ROOT", root))
        elif t == "PUNCT":
            out.append(("punct", root))
        elif t == "AUX":
            out.append(("aux", root))
        elif w.lower() in ("not", "n't"):
            out.append(("neg", root))
        elif t in ("DET", "ADJ", "NUM"):
            out.append(({"DET": "det", "ADJ": "amod"}.get(t, "amod" if i < root else "nummod"), noun))
            opened = None if t == "ADJ" and i > root else opened
        elif t == "ADP":
            out.append(("prep", root))
            opened = i if i > root else opened
        elif t == "ADV":
            out.append(("advmod", root))
        elif i < root:
            if t in ("NOUN", "PROPN", "PRON") and not subject:
                subject = True
                out.append(("nsubj", root))
            else:
                out.append(("compound", root - 1) if t in ("NOUN", "PROPN") else ("advcl", root) if t == "VERB" else ("dep", root))
        elif t == "CCONJ":
            out.append(("cc", root))
        elif t in ("NOUN", "PROPN", "PRON"):
            out.append(("pobj", opened) if opened is not None else ("dobj", root))
        else:
            out.append(("conj" if opened is None else "pcomp", root) if t == "VERB" else ("dep", root))
    return out


def test_relations_against_plain_python(spark):
    rng = random.Random(3)
    kinds = ["NOUN", "PROPN", "PRON", "VERB", "AUX", "DET", "ADJ", "NUM", "ADP", "ADV", "CCONJ", "PUNCT", "X"]
    sentences = [[(rng.choice(kinds), rng.choice(["a", "not", "going", "of"])) for _ in range(rng.randint(1, 14))] for _ in range(150)]
    rows = [(k % 7, k, i, w, t) for k, s in enumerate(sentences) for i, (t, w) in enumerate(s)]
    got: dict = {}
    for r in grammar.with_relations(spark.createDataFrame(rows, "doc_id long, sent int, pos int, word string, tag string")).orderBy("sent", "pos").collect():
        got.setdefault(r["sent"], []).append((r["dep"], r["head"]))
    for k, s in enumerate(sentences):
        assert got[k] == plain_relations([t for t, _ in s], [w for _, w in s]), s


def test_tags_lemmas_and_their_context(spark):
    docs = docs_of(spark, "The design was to design NASA's well-made engines. He running quickly, stopped 3 boxes; the cities' Berlin-based children", None, "", "Well?")
    words = grammar.with_lemmas(grammar.with_tags(grammar.words(docs), grammar.lexicon(spark)), grammar.irregular(spark))
    got = {(r["doc_id"], r["sent"], r["pos"]): (r["word"], r["tag"], r["lemma"]) for r in words.collect()}
    assert got[0, 0, 1] == ("design", "NOUN", "design")  # behind a determiner
    assert got[0, 0, 4][:2] == ("design", "VERB") and got[0, 0, 5][1:] == ("NOUN", "nasa'") or got[0, 0, 5][0] == "NASA's"
    flat = {w: (t, lemma) for w, t, lemma in got.values()}
    assert flat["running"] == ("VERB", "run") and flat["stopped"] == ("VERB", "stop") and flat["boxes"] == ("NOUN", "box") and flat["children"] == ("NOUN", "child")
    assert flat["quickly"] == ("ADV", "quickly") and flat["3"] == ("NUM", "3") and flat["well-made"][0] == "ADJ" and flat["Well"] == ("ADV", "well")
    assert not any(k[0] in (1, 2) for k in got)
    own = grammar.lexicon(spark, {"VERB": ["program"], "NOUN": ["walk"]})
    tags = [r["tag"] for r in grammar.with_tags(grammar.words(docs_of(spark, "we can walk program")), own).orderBy("pos").collect()]
    assert tags == ["NOUN", "NOUN", "VERB", "VERB"]


def test_pipeline_is_saved_and_loaded(spark, tmp_path):
    docs = spark.createDataFrame([(0, "She led two new teams. The team grew.", [(0, 2, "a"), (1, 3, "b"), (5, 1, "c")])], "doc_id long, text string, spans array<struct<first:int,n:int,label:string>>")
    pipeline = Pipeline(stages=[stages.SpanMerger(spansCol="spans"), stages.Words(keep=["spans"]), stages.Tagger(entries=["grew=VERB", "a=b=NOUN"]), stages.Lemmatizer(forms=["grew=grow"]), stages.Relations()])
    model = pipeline.fit(docs)
    pipeline.write().overwrite().save(f"{tmp_path}/p")
    model.write().overwrite().save(f"{tmp_path}/m")
    want = sorted(map(str, model.transform(docs).collect()))
    assert want == sorted(map(str, PipelineModel.load(f"{tmp_path}/m").transform(docs).collect())) == sorted(map(str, Pipeline.load(f"{tmp_path}/p").fit(docs).transform(docs).collect()))
    row = model.transform(docs).where("word = 'grew'").first()
    assert (row["tag"], row["lemma"], row["dep"], [s["label"] for s in row["spans"]]) == ("VERB", "grow", "ROOT", ["b", "c"])
    assert stages.text_pipeline().fit(docs).transform(docs.limit(0)).count() == 0


def test_longest_spans_against_plain_python(spark):
    rng = random.Random(2)
    lists = [[(rng.randrange(12), rng.randint(1, 4)) for _ in range(rng.randint(0, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "id int, spans array<struct<first:int,n:int>>")
    for r in grammar.with_longest_spans(df).collect():
        if r["id"] == len(lists):
            assert r["spans"] is None
            continue
        kept = []
        for a, n in sorted(lists[r["id"]], key=lambda s: (-s[1], s[0])):
            if all(b + m <= a or a + n <= b for b, m in kept):
                kept.append((a, n))
        assert [tuple(s) for s in r["spans"]] == sorted(kept)


def test_plain_forms_equal_the_character_database(spark):
    letters = [chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["中" * 3 + "".join(letters[i : i + 400]) for i in range(0, len(letters), 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").where(F.lit(True)).select("i", normal.compatible(F.col("t")).alias("x"))
    for r in df.collect():
        want = "".join("".join(x for x in unicodedata.normalize("NFKD", "".join(normal.SIGNS.get(y, y) for y in unicodedata.normalize("NFKC", c))) if not unicodedata.combining(x)) for c in texts[r["i"]])
        assert r["x"] == want, r["i"]
    cases = {"naïve ﬁt…": "naive fit...", "a" * 95 + "中" * 5: "a" * 95, "a" * 94 + "中" * 6: "a" * 94 + "中" * 6, "é" * 10: "e" * 10, "": "", "plain": "plain"}
    for text, want in cases.items():
        assert one(spark, text, normal.compatible) == want
    assert one(spark, None, normal.compatible) is None


def test_contacts_are_taken_out_in_order(spark):
    text = "Ann@X.example, see HTTPS://a.example/b). also github.com/ann, +1 (555) 010-2000; ann@x.example 12345 node.js 12345678901234567890 555 010 2000"
    got = one(spark, text, normal.contacts_of)
    assert (got["emails"], got["urls"], got["phones"]) == (["ann@x.example"], ["https://a.example/b", "github.com/ann"], ["+1 (555) 010-2000", "555 010 2000"])
    assert re.sub(" +", " ", got["text"]) == " , see also , ; 12345 node.js 12345678901234567890 "
    rows = {r["doc_id"]: r for r in normal.cleaned_documents(docs_of(spark, "C++ ﬁrst ☃ w0rd , here:there\x07\n\n\n\n ann@x.example  End. Next one", None, "  ")).collect()}
    assert rows[0]["text"] == "C++ first word, here: there\n\nEnd. Next one" and rows[0]["sentences"] == ["C++ first word, here: there", "End.", "Next one"] and rows[0]["n_words"] == 8
    assert rows[1]["text"] == rows[2]["text"] == "" and rows[1]["emails"] == [] and rows[2]["lines"] == []


def test_titles_with_acronyms(spark):
    assert one(spark, "senior sql clerk of iT", lambda t: titled(t, {"sql": "SQL", "it": "IT"})) == "Senior SQL Clerk of IT"


@pytest.mark.parametrize("block", [7, 2048])
def test_similar_vectors_against_all_products(spark, block):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    x[7], x[9] = x[3], 2 * x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, [0.0] * 6), (51, None), (52, [float("nan")] * 6), (None, [1.0] * 6), (53, [1e200] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    y = {i: np.array(v) / np.abs(v).max() for i, v in rows if i is not None and v and np.isfinite(v).all() and any(v)}
    y = {i: v / np.linalg.norm(v) for i, v in y.items()}
    got = {(r["left_id"], r["right_id"]): r["cosine"] for r in similarity.pairs_above(df, 0.5, block_rows=block).collect()}
    want = {(a, b): float(y[a] @ y[b]) for a in y for b in y if a < b and y[a] @ y[b] >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and got[3, 7] == pytest.approx(1.0)
    best = sorted((r["left_id"], r["rank"], r["right_id"]) for r in similarity.nearest(df, 3, block_rows=block).collect())
    assert best == sorted((a, k + 1, b) for a in y for k, (_, b) in enumerate(sorted((-round(float(y[a] @ y[b]), 9), b) for b in y if b != a)[:3]))
    assert similarity.pairs_above(df.limit(0), 0.5).count() == 0


def test_pages_by_cursor(spark):
    rng = random.Random(1)
    rows = [(i, datetime(2024, 1, rng.randint(1, 5))) for i in range(57)]
    table = spark.createDataFrame(rows, "id long, created_at timestamp")
    want, seen, cursor = sorted(rows, key=lambda r: (-r[1].timestamp(), r[0])), [], None
    for _ in range(9):
        got = history.keyset_page(table, 10, cursor).orderBy(F.col("created_at").desc(), "id").collect()
        if not got:
            break
        assert all((r["n"], r["pages"]) == (57, 6) for r in got)
        seen += [(r["id"], r["created_at"]) for r in got]
        if got[0]["next_id"] is None:
            assert len(got) == 7
            break
        cursor = (got[0]["next_at"], got[0]["next_id"])
        assert cursor == (got[-1]["created_at"], got[-1]["id"])
    assert seen == want
    assert history.keyset_page(table, 0).count() == 1 and history.keyset_page(table.limit(0), 5).count() == 0


def test_history_is_saved_once_and_purged(spark, tmp_path):
    path = f"{tmp_path}/history"
    day = lambda k: datetime(2024, 3, 1) + timedelta(days=k)
    batch = lambda ids: spark.createDataFrame([(i, day(i)) for i in ids], "id long, created_at timestamp")
    rows = lambda: sorted(r["id"] for r in spark.read.parquet(path).collect())
    history.saved(batch([0, 1, 2]), path, 1)
    history.saved(batch([2, 3]), path, 2)
    history.saved(batch([0, 1, 2]), path, 1)  # again, as after a lost acknowledgement
    assert rows() == [0, 1, 2, 2, 3]
    assert history.purged(spark, path, 0, "2024-03-09") == 0 and history.purged(spark, path, 5, "2024-03-07") == 1 and history.purged(spark, path, 5, "2024-03-07") == 0
    assert rows() == [1, 2, 2, 3]
    assert history.without_batch(spark, path, 1) == 2 and rows() == [2, 3]

    source = f"{tmp_path}/in"
    batch([5]).write.parquet(source)
    batch([6]).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda name: stream.writeStream.foreachBatch(lambda df, k: history.saved(df, path, 100 + k)).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    run("a")
    run("b")  # the same batches with the same numbers
    assert rows() == [2, 3, 5, 6]


def test_ladders_of_names(spark):
    people = {"CV\nName: Ann-Marie O'Neil\nx": "Ann-marie O'neil", "Senior Clerk\nAnn Lee\nBob Ray": "Ann Lee", "resume\nwrite to bo.derek@x.example": "Bo Derek", "write to clerk.team@x.example": None, "nothing 12": None}
    got = {r["doc_id"]: r["person"] for r in spans.person(docs_of(spark, *people, None)).collect()}
    assert got == dict(enumerate(people.values()))
    firms = {"Company: Red Bolts\nJoin Acme": "Red Bolts", "Come and join Acme Tools today": "Acme Tools", "Acme is hiring": "Acme", "made by Bright Lamps Ltd here": "Bright Lamps Ltd", "Join Us": None, "none": None}
    assert {t: one(spark, t, spans.employer_of) for t in firms} == firms


def test_long_texts_are_cut_in_linear_time(spark):
    text = "one two three. " * 100_000  # 1.5 MB
    began = time.time()
    got = docs_of(spark, text).select(language.chunk_arrays(F.col("text")).alias("c")).select(F.size("c"), F.element_at("c", -1)["start"]).first()
    assert got[0] > 3000 and got[1] > len(text) - 600 and time.time() - began < 60
    blocks = docs_of(spark, "Requirements:\n" + "a line\n" * 30_000).select(spans.blocks_of(F.col("text")).alias("b")).select(F.char_length("b.required")).first()
    assert blocks[0] == 7 * 30_000 - 1


def test_coverage_without_noise(spark):
    rows = spark.createDataFrame([(1, 1, "red bolt", "acme bolt blue", ["x"], [("acme", 0.9), ("bolt", 0.8), ("blue", 0.7)])], "pair_id long, right_id long, left_text string, right_text string, own array<string>, ks array<struct<term:string,score:double>>")
    found = comparing.with_compared(rows).select(comparing.covered(F.col("compared")).alias("a"), comparing.covered(F.col("compared"), noise=F.array(F.lit("acme"))).alias("b")).first()
    assert tuple(found["a"]) == (3, 1, round(1 / 3, 6)) and tuple(found["b"]) == (2, 1, 0.5)


def test_pairs_of_documents_without_skills(spark):
    pairs = spark.createDataFrame([(1, 1, 1), (2, 2, 1)], "pair_id long, left_id long, right_id long")
    none = spark.createDataFrame([], "doc_id long, skill string, category string")
    one_ = spark.createDataFrame([(1, "Go", None)], "doc_id long, skill string, category string")
    assert matching.skill_matches(pairs, none, none).count() == 0
    assert sorted((r["pair_id"], r["status"]) for r in matching.skill_matches(pairs, one_, one_, None).collect()) == [(1, "matched"), (2, "missing")]


def test_dates_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "Jan 2010 - Feb 2011", date(2000, 1, 1))], "doc_id long, text string, start date")
    assert dates.with_experience(docs, "2020-01-01").select("start", "months").first() == (date(2000, 1, 1), 14)
