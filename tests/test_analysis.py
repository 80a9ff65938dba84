"""Operators on profiles and postings: edge rows and brute-force versions."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from docpair.functions import fuzzy
from docpair.operators import advising, comparing, dates, history, language, matching, scoring, sections, semantic, spans
from docpair.sources import files


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sections(spark):
    text = "Ann Lee\n\nSKILLS:\nred bolts\nskills\n2 blue rods\nWork  Experience\nclerk\nSkills\none\nskills summary\na b c d e f\nEducation / Certifications\n- skills\n2012 skills"
    rows = {(r["doc_id"], r["name"]): r for r in sections.sections(docs_of(spark, text, "no headings here at all", None, "  ", "Skills\nReferences:")).collect()}
    assert {k: r["text"] for k, r in rows.items()} == {
        (0, "contact"): "Ann Lee", (0, "skills"): "red bolts\n2 blue rods\na b c d e f", (0, "experience"): "clerk", (0, "certifications"): "- skills\n2012 skills",
        (1, "unstructured"): "no headings here at all", (4, "skills"): "", (4, "references"): "", (4, "unstructured"): "Skills\nReferences:",
    }
    first = rows[0, "skills"]  # the second block has fewer words and goes, the third has more and is appended
    assert (first["heading"], first["confidence"], first["n_lines"], first["n_words"]) == ("skills summary", 0.97, 3, 11)
    assert (rows[0, "contact"]["confidence"], rows[1, "unstructured"]["confidence"], rows[0, "certifications"]["heading"]) == (0.5, 0.2, "Education / Certifications")
    kinds = {r["doc_id"]: (r["detected"], r["missing"]) for r in sections.presence(docs_of(spark, text, None)).collect()}
    assert kinds == {0: (["certifications", "contact", "experience", "skills"], ["education", "summary"]), 1: ([], ["education", "experience", "skills", "summary"])}


def test_periods_and_years(spark):
    texts = [
        "Jan 2010 - Mar 2011, Sept. 2010 to May 2012; 2020 - 2018 | clerk, 1950 - 2001", "Dec 2019 – present", "2012 - 2016 graduated with honours", "6+ years of work, 2 yrs", None, "",
        "Education\nat the college of the town, the long way, 2001 - 2005\nExperience\n2006 - 2006",
    ]
    got = {r["doc_id"]: [(p["start"], p["end"]) for p in r["periods"]] for r in dates.periods(docs_of(spark, *texts), "2021-03-01").where("text is not null").collect()}
    assert got[0] == [(date(2010, 1, 1), date(2011, 3, 1)), (date(2010, 9, 1), date(2012, 5, 1)), (date(2018, 1, 1), date(2020, 1, 1))]
    assert got[1] == [(date(2019, 12, 1), date(2021, 3, 1))] and got[2] == got[3] == got[5] == [] and 4 not in got
    years = {r["doc_id"]: (r["months"], r["years"]) for r in dates.years_of_experience(docs_of(spark, *texts), "2021-03-01").collect()}
    assert years == {0: (29 + 25, 4.5), 1: (16, 1.3), 2: (0, None), 3: (0, 6.0), 5: (0, None), 6: (1, 0.1)}
    asked = {r["doc_id"]: (r["min_years"], r["phrase"]) for r in dates.asked_years(docs_of(spark, "3-5 years of experience, or 7+ years in trade; 50 years experience", "open for 3 years", "none", None)).collect()}
    assert asked == {0: (7.0, "7+ years"), 1: (None, "3 years"), 2: (None, None)}


def test_degrees(spark):
    texts = ["EDUCATION\nB.Sc. in Physics\nBachelor of Science\nMBA, finance", "MASTER OF SCIENCE HERE", "nothing", None]
    got = {r["doc_id"]: (r["degrees"], r["level"]) for r in dates.degrees(docs_of(spark, *texts)).collect()}
    assert got == {0: (["B.Sc. in Physics", "Bachelor of Science", "MBA in Finance"], "master"), 1: ([], None), 2: ([], None)}


def test_spans(spark):
    words = spark.createDataFrame([("red bolt", "Red Bolt", "a", "any"), ("bolt", "Bolt", "b", "exact"), ("red bolt ring", "Ring", "a", "any"), ("go", "Go", "c", "drop"), ("c++", "C++", "c", "any")], "surface string, canonical string, category string, policy string")
    docs = docs_of(spark, "Red bolts, red-bolt ring and bolt; a Bolt, go C++", None, "", "bolt's Bolt's")
    kept = sorted((r["doc_id"], r["first"], r["canonical"]) for r in spans.greedy(spans.hits(docs, words)).collect())
    assert kept == [(0, 0, "Red Bolt"), (0, 2, "Ring"), (0, 8, "Bolt"), (0, 10, "C++"), (3, 1, "Bolt")]
    assert sorted((r["doc_id"], r["first"], r["canonical"]) for r in spans.leftmost(spans.hits(docs, words)).collect()) == kept


def test_greedy_against_plain_python(spark):
    rng = random.Random(3)
    surfaces = {" ".join(rng.choices("abc", k=n)) for n in (1, 2, 2, 3, 3, 4) for _ in range(4)}
    words = spark.createDataFrame([(s, s, "x", "any") for s in surfaces], "surface string, canonical string, category string, policy string")
    texts = [" ".join(rng.choices("abcd", k=25)) for _ in range(20)]
    got = sorted((r["doc_id"], r["first"], r["canonical"]) for r in spans.greedy(spans.hits(docs_of(spark, *texts), words)).collect())
    want = []
    for i, t in enumerate(texts):
        ts, taken = t.split(), []
        hits = [(-len(s), k, len(s.split()), s) for s in surfaces for k in range(len(ts)) if ts[k : k + len(s.split())] == s.split()]
        for _, k, n, s in sorted(hits):
            if all(b <= k or k + n <= a for a, b in taken):
                taken.append((k, k + n))
                want.append((i, k, s))
    assert got == sorted(want)


def test_likeness_of_strings():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(max(out[-1], row[j + 1], row[j] + (x == y)))
        return out

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab c", k=rng.randint(0, 9))) for _ in range(2))
        assert fuzzy.common(a, b) == lcs(a, b)
    assert fuzzy.token_sets("red bolt", "bolt red") == 100.0 and fuzzy.token_sets("red bolt", "red") == 100.0 and fuzzy.token_sets("", "x") == 0.0
    assert fuzzy.best_part("bolt", "red bolts") == 100.0 and fuzzy.best_part("abcd", "abxd") == 75.0
    assert round(fuzzy.token_sets("data science", "data analysis"), 2) == round(max(100 - 100 * (15 - 2 * fuzzy.common("science", "analysis")) / 25, 100 - 800 / 16), 2)


def test_skill_matches_in_stages(spark):
    pairs = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (2, 9, 9)], "pair_id long, left_id long, right_id long")
    side = lambda *rows: spark.createDataFrame(rows, "doc_id long, skill string, category string")
    left = side((0, "Python", "a"), (0, "Postgres SQL", "b"), (0, "Cooking", "c"), (1, "Rowing", "c"))
    right = side((0, "python", "a"), (0, "PostgreSQL", "b"), (0, "Sewing", "c"), (0, "Welding", "d"))
    vectors = spark.createDataFrame([("Cooking", [1.0, 0.0]), ("Sewing", [0.9, 0.1]), ("Welding", [0.0, 1.0])], "skill string, vector array<double>")
    found = matching.skill_matches(pairs, left, right, 80.0, vectors)
    got = {(r["pair_id"], r["skill"]): (r["status"], r["other"], r["match_type"]) for r in found.collect()}
    assert got == {(0, "python"): ("matched", "Python", "exact"), (0, "PostgreSQL"): ("partial", "Postgres SQL", "fuzzy"), (0, "Sewing"): ("partial", "Cooking", "semantic"), (0, "Welding"): ("missing", None, None), (1, "Rowing"): ("extra", None, None)}
    rated = {r["pair_id"]: tuple(r)[1:] for r in matching.skill_metrics(pairs, found).collect()}
    assert rated == {0: (1, 2, 1, 0, 0.5, 0.6667, 0.5714, 50.0), 1: (0, 0, 0, 1, 0.0, 0.0, 0.0, 100.0), 2: (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)}
    assert {(r["status"], r["category"]): r["skills"] for r in matching.by_category(found).collect()} == {("matched", "a"): ["python"], ("missing", "d"): ["Welding"]}


def test_fuzzy_matches_against_plain_python(spark):
    rng = random.Random(8)
    names = ["".join(rng.choices("abcde ", k=rng.randint(3, 8))).strip() for _ in range(60)]
    pick = lambda: sorted(set(rng.choices(names, k=9)))
    lefts, rights = [pick() for _ in range(12)], [pick() for _ in range(12)]
    table = lambda x: spark.createDataFrame([(i, s, "c") for i, names_ in enumerate(x) for s in names_], "doc_id long, skill string, category string")
    pairs = spark.createDataFrame([(i, i, i) for i in range(12)], "pair_id long, left_id long, right_id long")
    got = {(r["pair_id"], r["skill"], r["other"]) for r in matching.skill_matches(pairs, table(lefts), table(rights), 60.0).where("status = 'partial'").collect()}
    want = set()
    for i, (ls, rs) in enumerate(zip(lefts, rights, strict=True)):
        free = [s for s in ls if s not in rs]
        for skill in [s for s in rs if s not in ls]:
            best = max(free, key=lambda o: fuzzy.alike(skill, o), default=None)
            if best and fuzzy.alike(skill, best) >= 60:
                free.remove(best)
                want.add((i, skill, best))
    assert got == want


def test_weights_and_scores(spark):
    assert scoring.normal_weights({"a": -1.0, "b": 0.0}) == {"a": 0.5, "b": 0.5} and scoring.normal_weights({"a": 1.0, "b": -1.0, "c": 3.0}) == {"a": 0.25, "b": 0.0, "c": 0.75}
    shape = "pair_id long, tfidf_cosine double, coverage double, similarity double, skill_score double, years double, required_years double, titles array<string>, title string, section_similarity double, n_verbs int, n_quantities int, level string, degrees array<string>, degree_phrase string, has_education boolean"
    rows = [
        (0, 0.0, 0.0, 0.0, 0.0, None, None, None, None, None, 0, 0, None, None, None, False), (1, 1e9, 1.0, 1e9, 100.0, 9.0, 3.0, ["Senior Clerk"], "senior clerk", 1.0, 10, 10, "phd", ["Ph.D. in Physics"], "Master in physics", True),
        (2, 0.2, 0.5, 0.15, 50.0, 1.0, 4.0, ["clerk"], "of it", 0.5, 1, 1, "bachelor", ["B.S. in Design"], "master in physics required", True),
    ]
    got = {r["pair_id"]: tuple(r)[1:] for r in scoring.full_scores(spark.createDataFrame(rows, shape)).collect()}
    e = 100 * (1 - np.exp(-1.0))
    assert got[0] == (0.0, 0.0, 0.0, 28.75, 45.0, 7.4, "F") and got[1] == (100.0, 100.0, 100.0, 100.0, 100.0, 100.0, "A")
    assert got[2][:5] == (round(0.45 * e + 27.5, 2), round(e, 2), 50.0, round(0.55 * 25 + 10 + 7.5 + 2, 2), 62.0)
    unknown = scoring.full_scores(spark.createDataFrame(rows[1:2], shape), {"skill_match": 1.0, "no such": 3.0}).first()
    assert unknown["overall"] == 25.0


def test_checks(spark):
    good = "Ann, ann@x.example\n- a\n- b\n- c\n2010 - 2012 " + "word " * 260
    docs = docs_of(spark, good, None, "😀 a    b\nc    d\ne    f\ng    h").withColumn("n_contacts", F.lit(1)).withColumn("names", F.array(*map(F.lit, ["experience", "education", "skills"])))
    got = {r["doc_id"]: r.asDict() for r in scoring.document_checks(docs).collect()}
    assert got[0]["passed"] == 13 and got[0]["score"] == 100.0
    assert [n for n in scoring.CHECKS if not got[1][n]] == ["text_extractable", "word_count", "bullet_points", "parseable_dates"]
    assert got[2]["clean_charset"] == 0 and got[2]["single_column"] == 0 and got[2]["score"] == round(100 * 12 / 23, 1)


def test_recommendations(spark):
    names = "required open preferred extra high medium partial degrees certificates asked_certificates".split()
    row = {n: None for n in names} | {"pair_id": 1, "n_extra": 9, "n_matched": 2, "coverage": 0.2, "experience_gap": None, "education_gap": "Too low.", "years": None, "n_quantities": 1, "has_summary": False, "weak": [("skills", 10.0)], "failed": [("single_column", False), ("text_extractable", True)], "density_band": "under_optimized", "scanned": False, "n_words": 100}
    row |= {d: s for d, s in zip(advising.DIMENSIONS, (50.0, 60.0, 40.0, 90.0, 80.0), strict=True)} | {"required": ["x", "y"], "extra": ["q"]}
    shape = ", ".join(f"{n} array<string>" for n in names) + ", pair_id long, n_extra long, n_matched long, coverage double, experience_gap string, education_gap string, years double, n_quantities int, has_summary boolean, weak array<struct<section:string,score:double>>, failed array<struct<name:string,is_error:boolean>>, density_band string, scanned boolean, n_words int, "
    shape += ", ".join(f"{d} double" for d in advising.DIMENSIONS)
    order = [c.strip().split(" ")[0] for c in shape.replace("struct<section:string,score:double>", "s").replace("struct<name:string,is_error:boolean>", "s").split(",")]
    got = advising.recommendations(spark.createDataFrame([tuple(row[c] for c in order)], shape)).orderBy("rank").collect()
    assert [(r["priority"], r["category"], r["impact"]) for r in got[:5]] == [(1, "missing_skills", 92.0), (1, "overall_alignment", 85.0), (1, "section_improvement", 65.0), (1, "ats_formatting", 60.0), (1, "score_dimension", 59.0)]
    assert sorted((r["priority"], r["category"], r["impact"]) for r in got[5:]) == [
        (2, "content_depth", 46.0), (2, "education", 58.0), (2, "experience", 60.0), (2, "formatting", 50.0), (2, "impact", 60.0),
        (3, "ats_formatting", 30.0), (3, "education", 38.0), (3, "keyword_density", 28.0), (3, "skill_focus", 25.0),
    ]


def test_latent_vectors_are_those_of_a_plain_decomposition():
    rng = random.Random(4)
    chunks = [[rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 9))] for _ in range(40)]
    names = sorted({t for c in chunks for t in c})
    tf = np.array([[c.count(t) for t in names] for c in chunks], float)
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (np.log((1 + len(chunks)) / (1 + (tf > 0).sum(0))) + 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    k = max(2, min(max(8, min(20, len(chunks) - 1)), len(names) - 1, len(chunks) - 1))
    want = u[:, :k] * s[:k]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = semantic.latent(chunks)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-8)


def test_similarity_of_texts(spark):
    long = " ".join(f"stone{i % 37} river{i % 11}" for i in range(400))
    left, right = docs_of(spark, long, "alpha beta", None, "meadow lark"), docs_of(spark, long, "beta alpha", "alpha", "granite cliff")
    pairs = spark.createDataFrame([(i, i, i) for i in range(4)], "pair_id long, left_id long, right_id long")
    got = {r["pair_id"]: r["similarity"] for r in semantic.pair_similarity(pairs, left, right).collect()}
    assert got[0] == 1.0 and got[1] > 0.3 and got[2] == 0.0 and got[3] < 0.01


def test_compared_keywords(spark):
    pairs = spark.createDataFrame([(0, 0, 0)], "pair_id long, left_id long, right_id long")
    left, right = docs_of(spark, "We deploy Pipelines daily"), docs_of(spark, "pipeline deployment. rare stone, daily rare")
    words = spark.createDataFrame([(0, "pipeline", 0.9), (0, "deployment", 0.8), (0, "rare stone", 0.7), (0, "daily rare", 0.6), (0, "deployment rare", 0.5), (0, "owned", 0.4)], "doc_id long, term string, score double")
    own = spark.createDataFrame([(0, "owned")], "doc_id long, term string")
    got = {r["term"]: (r["found"], r["occurrences"]) for r in comparing.compared(pairs, left, right, own, words).collect()}
    assert got == {"pipeline": (True, 1), "deployment": (True, 1), "rare stone": (False, 1), "daily rare": (False, 1), "owned": (True, 0)}


@pytest.mark.parametrize("overlap", [0, 20, 49])
def test_chunks_get_further(spark, overlap):
    docs = docs_of(spark, "x" * 350, "one. " * 70, None, "", "a\n" * 120)
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    ends = {}
    for r in language.chunks(docs, 100, overlap).orderBy("doc_id", "chunk_no").collect():
        assert whole[r["doc_id"]][r["start"] : r["start"] + len(r["chunk"])] == r["chunk"] and 0 < len(r["chunk"]) <= 100
        assert r["start"] == (ends[r["doc_id"]] - overlap if r["doc_id"] in ends else 0)
        ends[r["doc_id"]] = r["start"] + len(r["chunk"])
    assert ends == {i: len(t) for i, t in whole.items() if t}
    with pytest.raises(ValueError):
        language.chunks(docs, 100, 60)


def test_history_of_json(spark):
    rows = spark.createDataFrame([(1, '{"s": 2, "x": {"a": ["p"]}, "new": 1}', date(2020, 1, 9)), (2, "{broken", date(2020, 1, 5)), (3, None, date(2020, 1, 1))], "id long, j string, created_at date")
    got = {r["id"]: r["j"] and r["j"].asDict(True) for r in history.rehydrated(rows, "j", "s int, x struct<a: array<string>>, gone string").collect()}
    assert got == {1: {"s": 2, "x": {"a": ["p"]}, "gone": None}, 2: None, 3: None}
    keep, drop = history.without_expired(rows, 5)
    assert [sorted(r["id"] for r in d.collect()) for d in (keep, drop)] == [[1, 2], [3]]
    assert history.without_expired(rows, 0)[1].count() == 0


def test_kinds_of_files(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t><w:br/><w:t>three</w:t></w:p></w:document>")
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "c.txt").write_bytes("“q” €".encode("cp1252"))
    (tmp_path / "d.md").write_bytes(b"\x81x")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 /Type /Page /Encrypt 1 %%EOF")
    read = files.read_files(spark, str(tmp_path))
    got = {r["name"]: (r["text"], r["method"], r["problem"]) for r in files.texts(read, True).collect()}
    assert got["a.docx"] == ("One\nTwo\nthree", "docx", None) and got["b.docx"] == (None, "docx", "corrupt")
    assert got["c.txt"] == ("“q” €", "plain_text", None) and got["d.md"][0] == "\x81x" and got["e.pdf"][:2] == (None, "pdf")
    assert files.texts(read).count() == 3
    pdf = spark.createDataFrame([(bytearray(b"%PDF-1.4 /Type /Page /Encrypt 1 %%EOF"),), (bytearray(b"%PDF-1.4"),), (bytearray(b"%PDF-1.4 /Type/Pages %%EOF"),)], "c binary")
    assert [r[0] for r in pdf.select(files.pdf_problem(F.col("c"))).collect()] == ["encrypted", "structure", None]
    names = spark.createDataFrame([("../a b/c?d.txt",), ("",), ("x" * 200,), ("..",)], "n string")
    assert [r[0] for r in names.select(files.clean_name(F.col("n"))).collect()] == ["c_d.txt", "upload", "x" * 180, "upload"]
    default = spark.createDataFrame([("k", "A", "x")], "category string, canonical string, alias string")
    assert files.dictionary(spark, f"{tmp_path}/none.json", default).count() == 1
    assert {tuple(r) for r in files.surfaces(default.union(spark.createDataFrame([("k", "Go", "golang"), ("k", "Next", None)], default.schema)), ["next"], ["go"]).collect()} == {("golang", "Go", "k", "any"), ("Go", "Go", "k", "exact"), ("Next", "Next", "k", "drop")}
