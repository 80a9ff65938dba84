"""Rules that keep work in proportion to the input, and results that don't hang on rounding or on the order of ties."""

from pyspark.sql import functions as F

from docpair.functions import text as T
from docpair.operators import history, spans


def test_scores_round_as_their_sql_does(spark):
    rows = spark.createDataFrame([(0.7, 0.0, 74.35), (10.67, 9.09, 33.73)], "k double, s double, l double")
    overall = F.col("k") * 0.4 + F.col("s") * 0.4 + F.col("l") * 0.2
    # Spark's own round gives 15.1 and 14.6: it goes by the number as it is written
    assert [r[0] for r in rows.select(T.rounded(overall, 1)).collect()] == [15.2, 14.7]


def test_a_line_of_a_posting_is_made_bare_once(spark):
    docs = spark.createDataFrame([(1, "Requirements:\nred bolt\nNice to have\nblue rod\nBenefits\npay")], "doc_id long, text string")
    blocks = spans.requirement_blocks(docs)
    assert [tuple(r) for r in blocks.collect()] == [(1, "red bolt", "blue rod")]
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9") == 1


def test_tied_intervals_stay_in_one_island(spark):
    rows = spark.createDataFrame([(1, s, s + 60) for s in (0, 0, 30, 100, 100, 100) for _ in range(3)], "k int, s int, e int")
    assert {tuple(r) for r in history.merged_intervals(rows, "k", "s", "e").collect()} == {(1, 0, 90, 9), (1, 100, 160, 9)}


def test_terms_and_phrases_are_counted_in_their_rows(spark):
    from docpair.operators import pairs, ranking, signals, terms

    docs = spark.createDataFrame([(0, "red fox red fox a1 1b x1y"), (1, "red fox and blue"), (2, None), (3, "")], "doc_id long, text string")
    for df in (terms.top_terms(docs), signals.key_phrases(docs), ranking.graph_ranks(docs)):
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["rank"], r["tok"], r["tf"]) for r in terms.top_terms(docs, 3).collect()} == {(0, 1, "fox", 2), (0, 2, "red", 2), (0, 3, "red fox", 2), (1, 1, "blue", 1), (1, 2, "fox", 1), (1, 3, "fox blue", 1)}
    assert "tok" not in pairs.tfidf_cosine(docs)._jdf.queryExecution().executedPlan().toString()


def test_terms_in_python_are_those_of_expressions(spark):
    from docpair.functions import counts

    words = ["a1", "1b", "12", "é", "x1y", "A12b", "b" * 49, "b" * 48, "two words", "1 2", "中", "²", "٣", "ⅷ", "1 b"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.valid_term(F.col("w")).alias("v")).collect()
    assert [(r["w"], r["v"]) for r in got] == [(w, counts.is_term(w)) for w in words]


def test_a_long_word_takes_its_room_once(spark):
    from docpair.functions import counts

    # as an array of equal widths, the words of this text took 4 bytes for each letter of the longest word, each time
    text = " ".join(["x" * 20_000, *(f"w{i % 500}" for i in range(5_000))])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ranks = counts.walked(F.col("text"), 3, 0.85, 50, 1e-7)
    assert docs.select(F.size(ranks)).first()[0] == 501


def test_hits_of_a_document_meet_once(spark):
    words = spark.createDataFrame([(w, w, "c", "any") for w in ("red bolt", "bolt", "blue rod", "rod holder big")], "surface string, canonical string, category string, policy string")
    docs = spark.createDataFrame([(1, "red bolt blue rod holder big bolts"), (2, "a rod")], "doc_id long, text string")
    kept = spans.greedy(spans.hits(docs, words))
    assert {(r["doc_id"], r["first"], r["surface"]) for r in kept.collect()} == {(1, 0, "red bolt"), (1, 3, "rod holder big"), (1, 6, "bolt")}
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()


def test_only_lines_that_may_head_are_looked_at(spark):
    from docpair.operators import sections

    known = sections.aliases()
    lines = ["Work Experience", "1EXPERIENCE:", "tools|technologies", "• about me", "red bolts", "", "experienced clerk", "é-skills"]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", sections._may_head(F.col("x"), known).alias("may")).collect()
    assert [r["x"] for r in rows if r["may"]] == ["Work Experience", "1EXPERIENCE:", "tools|technologies", "• about me", "é-skills"]
    # a name of a heading without letters a-z leaves all lines in
    assert spark.range(1).select(sections._may_head(F.lit("red bolts"), [("опыт", "experience")])).first()[0] is True


def test_studies_are_told_as_before(spark):
    from docpair.operators import dates

    texts = ["B.Sc. 1990", "xba 1990", "an MBA, 1990", "M. S. C", "class of 1990", "thegraduate", "post-graduate", "Ph. D.", "red 1990", "honours", "specialization in bolts", "b tech"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(dates.STUDIES).alias("a"), F.col("t").rlike(dates.STUDIES_AT).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and {r["a"] for r in rows} == {True, False}


SKILL_WORDS = [(w, w.lower(), c, "any") for w, c in (("red bolt", "x"), ("Bolt", "y"), ("blue rod", None), ("rod", "z"))]


def test_skills_are_counted_in_a_documents_row(spark):
    words = spark.createDataFrame(SKILL_WORDS, "surface string, canonical string, category string, policy string")
    docs = spark.createDataFrame([(1, "red bolt\nRequirements:\nbolt and blue rod\nNice to have:\nrod, bolts, blue rods"), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = spans.posting_skills(docs, words)
    assert {tuple(r) for r in found.collect()} == {(1, "red bolt", "x", 1, "required"), (1, "bolt", "y", 2, "required"), (1, "blue rod", None, 2, "required"), (1, "rod", "z", 1, "preferred")}
    of = spans.profile_skills(spark.createDataFrame([(1, "Ann\nSkills\nrod rod\nEducation\nbolt"), (2, "Skills\nnone\nAwards\nred bolt"), (3, None)], "doc_id long, text string"), words)
    assert {tuple(r) for r in of.collect()} == {(1, "rod", "z", 2), (2, "red bolt", "x", 1)}
    for df in (found, of):
        # one key a document, nothing sorted to be counted
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "skill" not in "".join(x for x in plan.split("\n") if "Aggregate [" in x)


def test_skills_of_a_row_have_each_key_once(spark):
    from docpair.operators import matching

    rows = spark.createDataFrame([([("Rod", "b"), ("rod", None), ("Bolt", "a")],), ([],), (None,)], "x array<struct<skill:string,category:string>>")
    lists = [r[0] and [tuple(s) for s in r[0]] for r in rows.select(matching.skills_in_row(F.col("x"))).collect()]
    assert lists == [[("bolt", "Bolt", "a"), ("rod", "Rod", "b")], [], None]


def test_what_rests_on_one_document_is_made_once_for_it(spark):
    from docpair.operators import comparing
    from docpair.plans import features

    words = spark.createDataFrame(SKILL_WORDS, "surface string, canonical string, category string, policy string")
    docs = spark.createDataFrame([(1, "Red bolts, red rods.\nSkills\nbolts"), (2, "Blue rod")], "doc_id long, text string")
    left = features.profile_features(docs, words, "2002-01-01", (features.KEYWORDS,))
    assert "sections" not in left.columns
    assert {r["doc_id"]: r["left_words"] for r in left.collect()} == {1: " red bolts red rods skills bolts ", 2: " blue rod "}
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id long, left_id long, right_id long")
    rows = features.pair_rows(pairs, left, features.posting_features(docs, words, (features.KEYWORDS,)), (features.KEYWORDS,))
    made = {(r["term"], r["found"]) for r in comparing.compared_rows(rows).collect()}
    assert made == {("blue", False), ("rod", True), ("blue rod", False)}
    both = features.profile_features(docs, words, "2002-01-01", (features.FACTS, features.SECTION_WORDS)).where("doc_id = 1").first()
    assert dict(zip((s["name"] for s in both["sections"]), both["section_words"], strict=True)) == {"contact": ["red", "bolts", "rods"], "skills": ["bolts"]}


def test_a_block_of_vectors_meets_each_other_once(spark):
    import numpy as np
    from docpair.operators import similarity

    x = np.random.default_rng(5).normal(size=(300, 4))
    x[200:] = x[:100]  # ties, which go to the smaller id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    blocks, n = similarity._blocks(df, "vec_id", "embedding", 60)
    assert n == 5 and similarity._blocks(df, "vec_id", "embedding", None)[1] == 1
    met = similarity._met(blocks, n, lambda a, b: similarity.pd.DataFrame({"left_id": a["block"], "right_id": b["block"], "cosine": [0.0]}) if len(a) and len(b) else similarity.pd.DataFrame({"left_id": [], "right_id": [], "cosine": []}))
    assert sorted((r[0], r[1]) for r in met.collect()) == [(i, j) for i in range(5) for j in range(i, 5)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    np.fill_diagonal(scores, -2)
    want = {(i, r + 1, int(j)) for i in range(300) for r, j in enumerate(np.lexsort((np.arange(300), -scores[i]))[:4])}
    for rows in (None, 60):
        assert {(r["left_id"], r["rank"], r["right_id"]) for r in similarity.nearest(df, 4, block_rows=rows).collect()} == want


ODD_SENTENCES = [
    "The design was to design NASA's well-made engines. He running quickly, stopped 3 boxes; the cities' Berlin-based children", None, "", " \t ", "Well?", "A 3D Ally relied. ALLY-2 X A-B É-é Éa résumés ²x",
    "the plan to plan is planned\n\nISTANBUL İstanbul ΑΣ ß glasses buses-ed re-ify NATION-ABLE happier biggest tried dying sees", "Ending ABLE Nationally Wolfing x-y-fully passes studies' it's not n't going THE Make", "?! ... 中文 字 ٣x \U0001f600 ok",
]


def test_words_in_a_sentences_row_are_those_of_rows_of_words(spark):
    from docpair.operators import grammar as G
    from docpair.operators import stages

    docs = spark.createDataFrame([*enumerate(ODD_SENTENCES), (1, "Again she led teams.")], "doc_id long, text string")
    words = ["the", "plan", "Design", "be", "of", "x", "going"]
    for classes in (None, {"DET": words[:1], "VERB": words[1:4], "OWN": words[4:], "NOUN": ["make", "x"]}):
        rows = G.related_sentences(G.lemmatized_sentences(G.tagged_sentences(G.sentence_rows(docs), classes)))
        got = G.word_rows(rows)
        want = G.with_relations(G.with_lemmas(G.with_tags(G.words(docs.where("text <> 'Again she led teams.' or text is null")), G.lexicon(spark, classes)), G.irregular(spark)))
        mine = [tuple(r) for r in got.select(*want.columns).collect()]
        assert sorted(r for r in mine if r[0] != 1) == sorted(map(tuple, want.collect()))
        assert len([r for r in mine if r[0] == 1]) == 5
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan  # no word is shuffled
    # stages go on rows of words, too, as Relations makes them
    model = lambda *s: stages.Pipeline(stages=list(s)).fit(docs).transform(docs)
    last = model(stages.Words(), stages.Tagger(), stages.Relations(), stages.Lemmatizer())
    assert sorted(map(str, last.select("word", "tag", "lemma", "dep", "head").collect())) == sorted(map(str, stages.text_pipeline().fit(docs).transform(docs).select("word", "tag", "lemma", "dep", "head").collect()))


def test_relations_of_sentences_in_a_batch_are_those_of_each(spark):
    import numpy as np
    from docpair.operators import grammar as G
    from test_texts import plain_relations

    rng = np.random.default_rng(1)
    words = {0: "a", G.ING: "going", G.NOT: "not"}
    lengths = rng.integers(0, 15, 400)
    tags, marks = rng.integers(0, len(G.CLASSES) + 1, lengths.sum()), rng.choice(list(words), lengths.sum())
    dep, head = G.relations(tags + marks, np.cumsum(lengths))
    names, at = [*G.CLASSES, "X"], 0
    for n in lengths.tolist():
        want = plain_relations([names[t] for t in tags[at : at + n]], [words[m] for m in marks[at : at + n]]) if n else []
        assert [(G.RELATIONS[d], h) for d, h in zip(dep[at : at + n], head[at : at + n], strict=True)] == want
        at += n
    assert G.relations(tags[:0], np.zeros(3, int))[0].size == 0


def test_frequent_runs_meet_without_a_row_each(spark):
    import random

    from docpair.operators import frequent, language

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "c", "dé", "e5", "f"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, None), (61, ""), (62, "one"), (1, "a b c"), (3, texts[3])], "doc_id long, text string")
    for sizes, least in (((2, 3), 3), ((1, 2, 4), 7)):
        surfaces = language.ngrams(docs, sizes).select("doc_id", "surface").distinct().groupBy("surface").count().where(f"count >= {least}").select("surface")
        want = sorted(tuple(r) for r in language.longest_matches(docs, surfaces, sizes).select("doc_id", "pos", "n", "surface").collect())
        for chunk_bytes in (100, 1 << 20):
            got = frequent.frequent_matches(docs, sizes, least, chunk_bytes)
            assert sorted(tuple(r) for r in got.select("doc_id", "pos", "n", "surface").collect()) == want
        assert "surface" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
    assert frequent.frequent_matches(docs.limit(0)).count() == 0


def test_each_step_of_cleaning_is_made_once(spark):
    from docpair.functions import normal

    texts = ["Büro ﬁt… 中文 ½ at a@b.com, see www.x.org; tel 030 1234 5678", "plain | text rn l0w", "é" * 9 + "​ ﷺ", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = normal.cleaned_documents(docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\brn\b") == 1 and plan.count(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]") == 1
    got = {r["doc_id"]: (r["text"], r["emails"], r["urls"], r["phones"]) for r in rows.collect()}
    assert got[0] == ("Buro fit... 中文 1 2 at , see tel", ["a@b.com"], ["www.x.org"], ["030 1234 5678"])
    assert got[1][0] == "plain text m low" and got[3] == got[4] == ("", [], [], [])


def _plain_similarities(texts):
    """Of lists of chunks, each a string of content words: cosines of each text but the last with the last one, by a plain decomposition."""
    import numpy as np

    chunks = [w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] for t in texts for w in map(str.split, t)]
    names = sorted({t for c in chunks for t in c})
    n = len(chunks)
    tf = np.array([[c.count(t) for t in names] for c in chunks], float).reshape(n, len(names))
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (np.log((1 + n) / (1 + (tf > 0).sum(0))) + 1)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)
    x = unit(x)
    if n >= 2 and len(names) >= 2:
        k = max(2, min(max(8, min(192, max(16, n // 2), n - 1)), len(names) - 1, n - 1))
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        x = np.where((tf.sum(1) > 0)[:, None], unit(u[:, :k] * s[:k]), 0)
    ends = np.cumsum([len(t) for t in texts])
    v = unit(np.array([x[e - len(t) : e].mean(0) if t else np.zeros(x.shape[1]) for t, e in zip(texts, ends, strict=True)]))
    return (v[:-1] @ v[-1]).clip(0, 1).tolist()


def test_a_side_of_latent_similarity_is_counted_once(monkeypatch):
    import random

    from docpair.operators import semantic

    rng = random.Random(8)
    chunk = lambda: " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30)))
    text = lambda most: [chunk() for _ in range(rng.randint(0, most))]
    lefts = [[["w1 w2"]], [[]], [[""]], [["w1"], ["w1"]], *([text(25) for _ in range(rng.randint(1, 5))] for _ in range(6))]
    rights = [["w1"], [], [""], ["w2 w1"], *(text(3) for _ in range(6))]
    side = lambda texts: "".join("".join(c + "\n" for c in t) + "\f" for t in texts)
    groups = [(l, r) for l in lefts for r in rights]  # noqa: E741
    for kept in (1 << 20, 400):  # all are kept; some are forgotten on the way
        monkeypatch.setattr(semantic, "KEPT", kept)
        sides = semantic._Sides()
        got = semantic._batch_similarities(sides, [side(g[0]) for g in groups], [side([g[1]]) for g in groups])
        assert kept < 1000 or len(sides) == len({side(x) for x in lefts} | {side([x]) for x in rights})
        for (l, r), found in zip(groups, got, strict=True):  # noqa: E741
            want = _plain_similarities([*l, r])
            assert len(found) == len(want) and all(abs(a - b) < 2e-6 for a, b in zip(found, want, strict=True)), (l, r)


def test_latent_similarity_tokenises_documents_before_they_meet(spark):
    from docpair.operators import semantic

    docs = spark.createDataFrame([(0, "red fox, blue rod. The old mill"), (1, "blue rod"), (2, None), (3, "the of")], "doc_id long, text string")
    pairs = spark.createDataFrame([(10 * l + r, l, r) for l in range(4) for r in range(4)], "pair_id long, left_id long, right_id long")  # noqa: E741
    sections = docs.selectExpr("doc_id", "'whole' as name", "text").unionByName(docs.selectExpr("doc_id", "'again' as name", "text"))
    for df in (semantic.pair_similarity(pairs, docs, docs), semantic.section_similarity(pairs, sections, docs)):
        got = {(r["pair_id"], *([r["name"]] if "name" in df.columns else [])): r["similarity"] for r in df.collect()}
        assert all(0 <= v <= 1 for v in got.values()) and all(v == 0 for k, v in got.items() if k[0] % 10 > 1)
        assert len(got) == (24 if "name" in df.columns else 16) and {k[1:] for k in got} <= {(), ("whole",), ("again",)}
        tree = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in tree[: tree.index("Join")]  # not for each pair


def test_skills_of_a_small_dictionary_are_found_in_the_row_as_by_joins(spark, monkeypatch):
    words = spark.createDataFrame([*SKILL_WORDS, ("Rod end cap", "cap", "w", "any"), ("Go", "go", "v", "exact"), ("rings", "ring", None, "drop"), ("a b c d e", "long", "u", "any")], "surface string, canonical string, category string, policy string")
    texts = ["Red bolt's blue rod end caps; go, Go go rings red", "Requirements:\n- go\nMust-have: x\nRod. Rod end\ncap\n\nNice-to-have!\n- Go a b c d e\nAbout us\nbolts", "ÉRod rod# red bolts", "", " \n ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = lambda: [spans.posting_skills(docs, words), spans.profile_skills(docs, words), spans.skills(docs, words)]
    of = lambda dfs: [sorted((tuple(r) for r in df.collect()), key=str) for df in dfs]
    in_rows = queries()
    for df in in_rows:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "Repartition" not in plan
    got = of(in_rows)
    monkeypatch.setattr(spans, "IN_ROW", 0)
    assert got == of(queries()) and (0, "go", "v", 1) in got[2] and (1, "cap", "w", 1, "required") in got[0] and all(got)


def test_the_sentence_of_a_degree_begins_at_its_own_line(spark):
    from docpair.operators import dates

    docs = spark.createDataFrame([(1, "We pay well\nBachelor degree required."), (2, "A. An MBA (Bachelor) is\nfine, preferred"), (3, "mabachelor, required")], "doc_id long, text string")
    assert {r["doc_id"]: r["phrase"] for r in dates.asked_degree(docs).collect()} == {1: "Bachelor degree required.", 2: "An MBA (Bachelor) is", 3: None}


def test_a_query_has_only_the_features_it_needs(spark):
    from docpair.plans import analysis

    rows = analysis._gap_rows(spark, "/root/testdata/sf0.001")
    assert {"years", "required_years", "level", "degree_phrase"} <= set(rows.columns) and not {"matches", "compared", "cosine", "n_verbs", "employer"} & set(rows.columns)


def test_recommendations_rest_on_the_whole_method(spark):
    """Latent similarities of texts and sections, fuzzy matches, certificates and density, where other measures and fixed values stood; equal to the queries that give each."""
    from docpair.operators import comparing
    from docpair.plans import analysis, derived, features

    sf = "/root/testdata/sf0.001"
    made = analysis._advised(spark, sf).select("pair_id", "left_id", "similarity", "own_sections", "section_similarity", "partial", "certificates", "asked_certificates", "density", "density_band")
    rows = {r["pair_id"]: r for r in made.collect()}
    latent = {r["pair_id"]: r["similarity"] for r in analysis.QUERIES["latent_similarity"](spark, sf).collect()}
    assert len(latent) == len(rows) and all(abs(latent[k] - r["similarity"]) < 2e-6 for k, r in rows.items())
    sections = {(r["pair_id"], r["name"]): r["similarity"] for r in analysis.QUERIES["latent_section_similarity"](spark, sf).collect()}
    own = {(k, s["name"]): s["similarity"] for k, r in rows.items() for s in r["own_sections"] if s["present"]}
    assert own.keys() == sections.keys() and all(abs(own[k] - sections[k]) < 2e-6 for k in own)
    assert all(r["section_similarity"] == own.get((k, "experience"), 0.0) for k, r in rows.items())
    partly: dict = {}
    for r in analysis.QUERIES["fuzzy_skill_matches"](spark, sf).where("status = 'partial' and similarity < 0.98").collect():
        partly.setdefault(r["pair_id"], set()).add(f"'{r['other']}' -> '{r['skill']}'")
    assert partly and {k: set(r["partial"]) for k, r in rows.items() if r["partial"]} == partly
    by_left = {r["left_id"]: r for r in rows.values()}
    assert {n for r in by_left.values() for n in r["certificates"]} >= {"Certified fork lift driver", "Best clerk", "priority clerk"}
    assert all(r["certificates"] == ["Certified fork lift driver"] for k, r in by_left.items() if k % 3 == 0)
    profiles = features.written(derived.profiles(spark, sf))
    cover = {r["doc_id"]: (r["density"], r["band"]) for r in comparing.keyword_cover(profiles, comparing.top_terms(profiles).select("doc_id", F.col("tok").alias("term"))).collect()}
    assert all(cover[k] == (r["density"], r["density_band"]) for k, r in by_left.items())


def test_names_are_found_in_the_row_as_by_joins(spark, monkeypatch):
    names = spark.createDataFrame([("red bolt",), ("red",), ("bolt ring",), ("Rod",)], "surface string")
    docs = spark.createDataFrame([(1, "Rods, red bolt ring; RED. rod"), (2, "none"), (3, None)], "doc_id long, text string")
    of = lambda: {r["doc_id"]: r["names"] or [] for r in spans.with_mentions(docs, F.col("text"), names).collect()}
    assert of() == {1: ["Rod", "red bolt", "red"], 2: [], 3: []}
    monkeypatch.setattr(spans, "IN_ROW", 0)
    assert of() == {1: ["Rod", "red bolt", "red"], 2: [], 3: []}


def test_soft_skills_are_found_in_the_row_as_by_joins(spark, monkeypatch):
    words = spark.createDataFrame([("team work", "teamwork"), ("Teamwork", "teamwork"), ("communication", "communication"), ("look for  people", "recruiting"), ("red", "none")], "surface string, canonical string")
    docs = spark.createDataFrame([(1, "Dreamteam\nworkers commune"), (2, "We look for people, teams"), (3, None), (4, "red")], "doc_id long, text string")
    df = spans.soft_skills(docs, words)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    got = {tuple(r) for r in df.collect()}
    assert got == {(1, "teamwork"), (1, "communication"), (2, "recruiting"), (2, "teamwork")}
    monkeypatch.setattr(spans, "SOFT_IN_ROW", 0)
    assert {tuple(r) for r in spans.soft_skills(docs, words).collect()} == got


def test_checks_of_a_profile_are_made_once_for_it(spark):
    from docpair.plans import analysis

    rows = analysis._advised(spark, "/root/testdata/sf0.001")
    plan = rows.select("pair_id", "failed")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in plan.lower() and "RegExpCount" not in plan
    of = {r["doc_id"]: [n for n, w in scoring_checks() if w > 1 and n != "keyword_density" and not r[n]] for r in analysis.QUERIES["profile_checks"](spark, "/root/testdata/sf0.001").collect()}
    assert all([f["name"] for f in r["failed"] if f["name"] != "keyword_density"] == of[r["left_id"]] for r in rows.select("left_id", "failed").collect())


def scoring_checks():
    from docpair.operators import scoring

    return scoring.CHECKS.items()
