"""Feature tables: all that the analysis of pairs needs of a document, one row a document, and the row of a pair made of two of them.

A document's text is read once, whatever the number of its pairs. Everything that rests on one text is an expression
within its row; only dictionary terms and keywords are exploded, and come back as arrays of the same row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.counts import bounded_batches
from ..functions.rows import held
from ..operators import comparing as CP
from ..operators import dates as DT
from ..operators import matching as M
from ..operators import pairs as P
from ..operators import scoring as SC
from ..operators import sections as X
from ..operators import semantic as SM
from ..operators import spans as SP
from ..operators import terms as K

#: What a feature table may hold beside the text; a query asks for what it needs.
FACTS, SKILLS, KEYWORDS, COSINE, SECTION_WORDS = "facts", "skills", "keywords", "cosine", "section_words"
#: Parts of FACTS that may be asked for alone: years and degrees of both sides, the posting's employer and place.
YEARS, DEGREES, PLACES = "years", "degrees", "places"
#: What latent similarities of texts and of sections rest on; the density of a profile's own keywords and its failed checks, which rest on FACTS and KEYWORDS.
LATENT, DENSITY = "latent", "density"
#: Lines of a profile that name an occupation, as the derived profiles have them.
OCCUPATION = r"\| (.* clerk)"


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the folder that all executors share (spark.checkpoint.dir), read again; only on one machine a temporary one takes its place."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-features-")
    path = f"{folder}/features-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _with_terms(rows: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """rows with content (the content tokens) if the cosine or keywords are asked for, and keywords (the top terms with their scores, null without any)."""
    if COSINE not in parts and KEYWORDS not in parts:
        return rows
    bounded_batches(rows.sparkSession)
    rows = rows.withColumn("content", K.content_text(F.col("text")))
    if KEYWORDS not in parts:
        return rows
    rows = rows.withColumn("keywords", K.best_terms(F.col("content")))
    return rows.withColumn("keywords", F.when(F.size("keywords") > 0, F.transform("keywords", lambda x: F.struct(x["tok"].alias("term"), x["score"].alias("score")))))


def profile_features(docs: DataFrame, dictionary: DataFrame, today: str, parts: tuple[str, ...] = (FACTS, SKILLS, KEYWORDS)) -> DataFrame:
    """A row for each profile: doc_id, text, and by parts its sections and facts, skills (array) and keywords (array). Sections are made only where a part rests on them."""
    rows = docs.where("text is not null")
    text = F.col("text")
    need = lambda *names: not {FACTS, *names}.isdisjoint(parts)
    if need(YEARS, DEGREES, SKILLS, SECTION_WORDS, LATENT):
        rows = X.with_sections(rows)
    if need(YEARS):
        rows = DT.with_experience(rows, today).drop("periods")
    if need(DEGREES):
        rows = DT.with_degrees(rows)
    if need(DEGREES, SECTION_WORDS):
        rows = rows.withColumns({"detected": X.detected_in(F.col("sections")), "n_quantities": F.regexp_count(text, F.lit(T.QUANTITY))})
    if FACTS in parts:
        rows = rows.withColumns({
            "n_verbs": F.size(SP.verbs_in(text)), "n_words": F.regexp_count(text, F.lit(r"\S+")),
            "titles": F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(OCCUPATION), F.lit(1)))), "n_contacts": F.regexp_count(text, F.lit(T.EMAIL)) + F.regexp_count(text, F.lit(T.PHONE)),
            "n_bytes": F.octet_length("text"),
        })
    if SKILLS in parts:
        rows = SP.with_profile_skills(rows, dictionary).withColumn("skills", M.skills_in_row(F.col("listed"))).drop("listed")
    if SECTION_WORDS in parts:
        rows = rows.withColumn("section_words", held(F.transform("sections", lambda s: F.array_distinct(K.content_tokens(s["text"])))))
    if LATENT in parts:
        present = F.array_sort(F.transform(F.filter("sections", lambda s: s["text"] != ""), lambda s: F.struct(s["name"].alias("name"), s["text"].alias("text"))))
        rows = rows.withColumn("__s", held(present)).withColumns({"latent_names": F.col("__s.name"), "latent_sections": F.array_join(F.transform("__s", lambda s: SM.words_of(s["text"])), ""), "latent_left": SM.words_of(text)}).drop("__s")
    if not need(SECTION_WORDS, LATENT):
        rows = rows.drop("sections")
    if KEYWORDS in parts:
        lower, words = CP.lower_forms(text)
        rows = rows.withColumns({"left_lower": lower, "left_words": words})
    rows = _with_terms(rows, parts)
    if DENSITY in parts:
        rows = CP.with_density(rows, F.transform("keywords", lambda k: k["term"])).withColumnRenamed("band", "density_band")
        rows = rows.withColumn("failed", held(SC.failed_of(SC.checks_of({c: F.col(of) for c, of in {"text": "text", "n_contacts": "n_contacts", "n_bytes": "n_bytes", "names": "detected", "density": "density"}.items()}))))
    return rows


def posting_features(docs: DataFrame, dictionary: DataFrame, parts: tuple[str, ...] = (FACTS, SKILLS, KEYWORDS)) -> DataFrame:
    """A row for each posting: doc_id, text, and by parts its facts, skills (with kind and n) and keywords."""
    rows = docs.where("text is not null")
    need = lambda name: FACTS in parts or name in parts
    if need(PLACES):
        rows = SP.with_posting_facts(rows).drop(*(() if FACTS in parts else ("title", "pay")))
    if need(YEARS):
        rows = DT.with_asked_years(rows)
    if need(DEGREES):
        rows = DT.with_asked_degree(rows)
    if SKILLS in parts:
        rows = SP.with_posting_skills(rows, dictionary).withColumn("skills", M.skills_in_row(F.col("listed"), ("kind", "n"))).drop("listed")
    if SECTION_WORDS in parts:
        rows = rows.withColumn("right_words", held(F.array_distinct(K.content_tokens(F.col("text")))))
    if LATENT in parts:
        rows = rows.withColumn("latent_right", SM.words_of(F.col("text")))
    return _with_terms(rows, parts)


def pair_rows(pairs: DataFrame, left: DataFrame, right: DataFrame, parts: tuple[str, ...] = (FACTS, SKILLS, KEYWORDS, COSINE), fuzzy: float | None = None, fields: tuple[str, ...] = CP.FIELDS) -> DataFrame:
    """A row for each pair of two feature tables: the features of both, and by parts matches and metrics of skills, compared keywords (with these fields) and
    coverage, the cosine of terms, and latent similarities of the texts and of the left's sections (section_latent, in the order of latent_names). Both tables are met once."""
    named = lambda df, of, names: df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns if c != "doc_id"], F.col("doc_id").alias(of))
    kinds = dict(right.dtypes)
    lefts = named(left, "left_id", {"text": "left_text", "skills": "lefts", "keywords": "own", "content": "left_content"})
    rights = named(right, "right_id", {"text": "right_text", "skills": "rights", "keywords": "ks", "content": "right_content"})
    # the left, which many pairs have, last: its features aren't shuffled with each pair; a merge join leaves its pairs in a row
    rows = pairs.join(rights, "right_id").join(lefts.hint("merge") if COSINE in parts or LATENT in parts else lefts, "left_id")
    if SKILLS in parts:
        left_kind = dict(left.dtypes)["skills"]
        rows = rows.withColumns({"lefts": F.coalesce("lefts", F.array().cast(left_kind)), "rights": F.coalesce("rights", F.array().cast(kinds["skills"]))})
        rows = M.with_metrics(M.match_lists(rows, fuzzy))
    if KEYWORDS in parts:
        rows = CP.with_compared(rows.withColumn("own", F.transform("own", lambda k: k["term"])), fields)
        rows = rows.withColumn("cover", held(CP.covered(F.col("compared"))))
    if COSINE in parts:
        bounded_batches(rows.sparkSession)
        rows = rows.withColumn("cosine", F.coalesce(P.cosine_of_texts(F.col("left_content"), F.col("right_content")), F.lit(0.0)))
    if LATENT in parts:
        bounded_batches(rows.sparkSession)
        rows = rows.withColumns({"latent": SM.similarities_of(F.col("latent_left"), F.col("latent_right"))[0], "section_latent": SM.similarities_of(F.col("latent_sections"), F.col("latent_right"))})
    return rows
