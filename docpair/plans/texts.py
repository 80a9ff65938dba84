"""Queries on words in sentences, cleaned texts, vectors and pages of history, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal as N
from ..operators import comparing as CP
from ..operators import grammar as G
from ..operators import history as H
from ..operators import scoring as SC
from ..operators import similarity as SI
from ..operators import spans as SP
from ..operators import stages
from . import analysis as A
from . import derived as D
from . import features as FT

QUERIES, ORACLE = {}, {}


def query(sql: str | None, name: str):
    """Registers a function of (spark, table) under its name, with its SQL (None where SQL can't express it)."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _listed(rows: dict[str, list[str]]) -> str:
    seen: dict[str, str] = {}
    for name, words in rows.items():
        for w in words:
            seen.setdefault(w, name)
    return ", ".join(f"('{w}', '{n}')" for w, n in seen.items())


def _ending_sql(low: str) -> str:
    rules = sorted(((e, n, tag) for tag, endings in G.ENDINGS.items() for e, n in endings), key=lambda r: (-len(r[0]), r[0]))
    return "case " + " ".join(f"when suffix({low}, '{e}') and length({low}) >= {len(e) + n} then '{tag}'" for e, n, tag in rules) + " end"


CAPITALS = r"^\p{Lu}[\p{Lu}\p{N}-]+$"
WORDS = rf"""sents as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) +([\p{{Lu}}0-9"(])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as ss from documents where text is not null),
sent as (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) - 1 as sent from sents), lists as (select doc_id, sent, regexp_extract_all(s, '{G.WORD.replace("'", "''")}') as ws from sent),
words as (select doc_id, sent::int as sent, (generate_subscripts(ws, 1) - 1)::int as pos, unnest(ws) as word from lists), known as (select * from (values {_listed(G.LEXICON)}) k(w, known)),
first_pass as (select *, lower(word) as low, {_ending_sql("lower(word)")} as ending, {_ending_sql("string_split(lower(word), '-')[-1]")} as tail from words left join known on w = lower(word)),
second_pass as (select *, lag(low) over s as low_before, lag(known) over s as known_before from first_pass window s as (partition by doc_id, sent order by pos)),
tagged as (select doc_id, sent, pos, word, low, case when known is null then case when not regexp_matches(word, '[\p{{L}}\p{{N}}]') then 'PUNCT' when regexp_matches(word, '^\p{{N}}') then 'NUM' when regexp_matches(word, '{CAPITALS}') then 'PROPN'
    when pos > 0 and regexp_matches(word, '^\p{{Lu}}') then case when length(low) > 6 then coalesce(ending, 'PROPN') else 'PROPN' end when ending is not null then ending when contains(low, '-') then coalesce(tail, 'ADJ') else 'NOUN' end
  when known = 'VERB' and known_before = 'DET' then 'NOUN' when known = 'NOUN' and low_before in ({", ".join(f"'{w}'" for w in G.BEFORE_VERBS)}) then 'VERB' else known end as tag from second_pass)"""


def _sentences(docs: DataFrame) -> DataFrame:
    return G.tagged_sentences(G.sentence_rows(docs))


@query(f"with {WORDS} select doc_id, tag, count(*) as n from tagged group by all", "documents")
def context_tag_counts(docs):
    return _sentences(docs).select("doc_id", F.explode("tags").alias("tag")).groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))


UNDOUBLED = lambda x: f"case when length({x}) > 1 and right({x}, 1) = left(right({x}, 2), 1) and right({x}, 1) not in ('a', 'e', 'i', 'o', 'u') then left({x}, length({x}) - 1) else {x} end"
LESS = lambda n: f"left(low, length(low) - {n})"
CUT = lambda n: f"case when length({UNDOUBLED(LESS(n))}) >= 3 then {UNDOUBLED(LESS(n))} else {LESS(n)} || 'e' end"
NOUN = f"case when length(low) <= 3 or not suffix(low, 's') or regexp_matches(low, '(ss|us|is|as|os)$') then low when suffix(low, 'ies') and length(low) > 4 then {LESS(3)} || 'y' when regexp_matches(low, '(ch|sh|x|z|ss)es$') then {LESS(2)} else {LESS(1)} end"
LEMMAS = f"""{WORDS}, forms as (select * from (values {_listed(G.IRREGULAR)}) f(form, irregular)),
lemmas as (select doc_id, sent, pos, tag, case when regexp_matches(word, '{CAPITALS}') then word when irregular is not null then irregular when tag in ('NOUN', 'PROPN') then {NOUN}
  when tag = 'VERB' then case when suffix(low, 'ied') and length(low) > 4 then {LESS(3)} || 'y' when suffix(low, 'ing') and length(low) > 5 then {CUT(3)} when suffix(low, 'ed') and length(low) > 4 then {CUT(2)} else {NOUN} end
  when tag = 'ADJ' then case when suffix(low, 'er') and length(low) > 5 then {UNDOUBLED(LESS(2))} when suffix(low, 'est') and length(low) > 5 then {UNDOUBLED(LESS(3))} else low end else low end as lemma from tagged left join forms on form = low)"""


@query(f"with {LEMMAS} select tag, lemma, count(*) as n from lemmas group by all", "documents")
def lemma_counts(docs):
    return G.word_rows(G.lemmatized_sentences(_sentences(docs))).groupBy("tag", "lemma").agg(F.count(F.lit(1)).alias("n"))


RELATIONS = f"""{WORDS}, rooted as (select *, coalesce(min(pos) filter (tag = 'VERB' and not suffix(low, 'ing')) over s, min(pos) filter (tag = 'VERB') over s, min(pos) filter (tag in ('NOUN', 'PROPN', 'PRON', 'ADJ', 'NUM')) over s, 0) as r
  from tagged window s as (partition by doc_id, sent)),
ev as (select *, case when pos > r and tag = 'ADP' then pos when pos > r and tag = 'ADJ' then -1 end as ev, min(pos) filter (pos < r and tag in ('NOUN', 'PROPN', 'PRON')) over (partition by doc_id, sent) as subject,
  min(case when tag in ('NOUN', 'PROPN') then pos end) over (partition by doc_id, sent order by pos rows between 1 following and 3 following) as noun from rooted),
op as (select *, nullif(last_value(ev ignore nulls) over (partition by doc_id, sent order by pos rows between unbounded preceding and 1 preceding), -1) as o from ev),
related as (select doc_id, sent, pos, case when pos = r then 'ROOT' when tag = 'PUNCT' then 'punct' when tag = 'AUX' then 'aux' when low in ('not', 'n''t') then 'neg' when pos < r and tag in ('NOUN', 'PROPN', 'PRON') and pos = subject then 'nsubj'
    when pos < r and tag in ('NOUN', 'PROPN') then 'compound' when tag = 'DET' then 'det' when tag in ('ADJ', 'NUM') and (pos < r or tag = 'ADJ') then 'amod' when tag = 'NUM' then 'nummod' when tag = 'ADP' then 'prep' when pos > r and tag = 'CCONJ' then 'cc'
    when pos > r and tag in ('NOUN', 'PROPN', 'PRON') then case when o is not null then 'pobj' else 'dobj' end when tag = 'ADV' then 'advmod' when pos < r and tag = 'VERB' then 'advcl' when tag = 'VERB' then case when o is null then 'conj' else 'pcomp' end else 'dep' end as dep,
  case when pos = r or tag in ('PUNCT', 'AUX') or low in ('not', 'n''t') or (pos < r and pos = subject and tag in ('NOUN', 'PROPN', 'PRON')) then r when pos < r and tag in ('NOUN', 'PROPN') then r - 1 when tag in ('DET', 'ADJ', 'NUM') then coalesce(noun, r)
    when pos > r and tag in ('NOUN', 'PROPN', 'PRON') and o is not null then o else r end as head from op)"""


@query(f"with {RELATIONS} select doc_id, dep, count(*) as n, sum(head)::bigint as heads from related group by all", "documents")
def relation_counts(docs):
    return G.word_rows(G.related_sentences(_sentences(docs))).groupBy("doc_id", "dep").agg(F.count(F.lit(1)).alias("n"), F.sum("head").alias("heads"))


@query(f"with {LEMMAS}, {RELATIONS.removeprefix(WORDS + ', ')} select dep, tag, count(*) as n, count(distinct lemma) as n_lemmas from lemmas join related using (doc_id, sent, pos) group by all", "documents")
def pipeline_stages(docs):
    """The same words by a pyspark.ml Pipeline of all stages."""
    words = stages.text_pipeline().fit(docs).transform(docs)
    return words.groupBy("dep", "tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lemma").alias("n_lemmas"))


UNIT = "v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null), c as (select a.vec_id as left_id, b.vec_id as right_id, list_cosine_similarity(a.e, b.e) as cosine from v a join v b on a.vec_id <> b.vec_id)"


@query(f"with {UNIT} select left_id, right_id, round(cosine, 6) as cosine from c where left_id < right_id and cosine >= 0.4", "embeddings")
def similar_vectors(vectors):
    return SI.pairs_above(vectors, 0.4).withColumn("cosine", F.round("cosine", 6))


@query(f"with {UNIT}, r as (select *, row_number() over (partition by left_id order by round(cosine, 9) desc, right_id)::int as rank from c) select left_id, rank, right_id, round(cosine, 6) as cosine from r where rank <= 3", "embeddings")
def nearest_vectors(vectors):
    return SI.nearest(vectors, 3).withColumn("cosine", F.round("cosine", 6))


RE = lambda p: p.replace("'", "''")
ONCE = lambda xs: f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"
HARVEST = rf"""m as (select doc_id, text, regexp_replace(text, '{RE(N.EMAIL)}', ' ', 'g') as t1 from documents), u as (select *, regexp_replace(t1, '{RE(N.ADDRESS)}', ' ', 'g') as t2 from m),
d as (select *, regexp_replace(t2, '{RE(N.DOMAIN)}', ' ', 'g') as t3 from u),
h as (select doc_id, list_transform(regexp_extract_all(text, '{RE(N.EMAIL)}'), lambda x: lower(rtrim(x, '.,;:'))) as emails, list_transform(list_concat(regexp_extract_all(t1, '{RE(N.ADDRESS)}'), regexp_extract_all(t2, '{RE(N.DOMAIN)}')), lambda x: lower(rtrim(x, '.,;:)'))) as urls,
  list_transform(regexp_extract_all(t3, '{RE(N.NUMBER)}'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) as phones, regexp_replace(t3, '{RE(N.NUMBER)}', ' ', 'g') as rest from d)"""


@query(f"with {HARVEST} select doc_id, array_to_string({ONCE('emails')}, ' ') as emails, array_to_string({ONCE('urls')}, ' ') as urls, array_to_string({ONCE('phones')}, ';') as phones, md5(rest) as rest_md5 from h where rest is not null", "documents")
def harvested_contacts(docs):
    rows = docs.where("text is not null").select("doc_id", F.explode_outer(F.array(N.contacts_of(F.col("text")))).alias("c"))
    return rows.select("doc_id", F.array_join("c.emails", " ").alias("emails"), F.array_join("c.urls", " ").alias("urls"), F.array_join("c.phones", ";").alias("phones"), F.md5("c.text").alias("rest_md5"))


@query(None, "documents")
def cleaned_documents(docs):
    rows = N.cleaned_documents(docs)
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.size("emails").alias("n_emails"), F.size("urls").alias("n_urls"), F.size("phones").alias("n_phones"), F.size("sentences").alias("n_sentences"), F.size("lines").alias("n_lines"), "n_words", "n_chars")


@query(
    """with h as (select event_id as id, ts as created_at from events), c as (select created_at, id from h order by created_at desc, id limit 1 offset 39),
p as (select h.id, h.created_at from h, c where h.created_at < c.created_at or (h.created_at = c.created_at and h.id > c.id) order by created_at desc, id limit 20),
l as (select created_at as next_at, id as next_id from p order by created_at, id desc limit 1)
select p.id, p.created_at, (select count(*) from h) as n, (select ceil(count(*) / 20.0)::bigint from h) as pages, next_at, next_id from p, l""",
    "events",
)
def history_keyset_page(events):
    """The third page, by the cursor of the second, which is that of the first."""
    rows = H.analyses(events).select("id", "created_at")
    cursor = None
    for _ in range(2):
        first = H.keyset_page(rows, 20, cursor).select("next_at", "next_id").first()
        cursor = (first["next_at"], first["next_id"])
    return H.keyset_page(rows, 20, cursor)


def coverage_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A._rows(FT.KEYWORDS, FT.PLACES, fields=())(spark, sf_dir).select("pair_id", "compared", SC.noise_of(F.col("employer"), F.col("place")).alias("noise"))
    return rows.select("pair_id", F.explode_outer(F.array(CP.covered(F.col("compared"), 25, F.col("noise")))).alias("c")).where("c.considered > 0").select("pair_id", "c.*")


QUERIES["coverage_without_noise"] = coverage_without_noise
ORACLE["coverage_without_noise"] = A.ORACLE["missing_keywords"].rsplit("m as (", 1)[0] + """
q as (select pair_id, found from ranked r where rank <= 25 and not exists (select 1 from noise n where n.doc_id = r.doc_id and (n.term = r.term or list_contains(string_split(r.term, ' '), n.term))))
select pair_id, count(*)::int as considered, (count(*) filter (found))::int as found, round((count(*) filter (found))::double / count(*), 6) as coverage from q group by pair_id"""


def posting_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with a sentence that names an employer, in one of several forms, by the order's key."""
    docs = D.postings(spark, sf_dir)
    named = F.concat(F.lit("Ring & Bolt no "), F.element_at(F.array(*map(F.lit, ("One", "Two", "Three"))), (F.col("doc_id") % 3 + 1).cast("int")))
    forms = F.element_at(F.array(F.concat(F.lit("Company: "), named), F.lit("Join Acme Tools today."), F.lit("Bright Lamps Ltd makes lamps"), F.lit("Nobody is named here.")), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select("doc_id", SP.employer_of(F.concat("text", F.lit("\n"), forms)).alias("employer"))


QUERIES["posting_employers"] = posting_employers
ORACLE["posting_employers"] = f"""with {D.POSTINGS} select doc_id, case doc_id % 4 when 0 then 'Ring & Bolt no ' || (['One', 'Two', 'Three'])[doc_id % 3 + 1] when 1 then 'Acme Tools' when 2 then 'Bright Lamps Ltd' end as employer from postings"""
