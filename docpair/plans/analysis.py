"""Queries that take profiles and postings apart and hold them against each other, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import held
from ..operators import advising as AD
from ..operators import comparing as CP
from ..operators import dates as DT
from ..operators import matching as M
from ..operators import pairs as P
from ..operators import scoring as SC
from ..operators import sections as X
from ..operators import semantic as SM
from ..operators import spans as SP
from ..operators import terms as K
from . import derived as D
from . import features as FT
from . import queries as Q

QUERIES, ORACLE = {}, {}


def query(sql: str | None, *tables):
    """Registers a function of derived tables, under its name, with its SQL (None where SQL can't express it)."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[t(spark, sf_dir) for t in tables])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


SPACED = lambda t: rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '[ \t\r\f\x0b]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' *\n *', chr(10), 'g'), '^\n+|\n+$', '', 'g'))"
WORDS = lambda t: rf"len(regexp_extract_all({t}, '\S+'))"
SECTIONS = rf"""aliases as (select alias, section, rank, string_split(alias, ' ') as aw from (values {X.alias_rows()}) v(alias, section, rank)),
ls as (select doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[\t\r\f\x0b]', ' ', 'g')) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from profiles),
lf as (select *, line <> '' and length(line) <= 70 and {WORDS("line")} <= 7 and len(regexp_extract_all(line, '  ')) <= 3 and not regexp_matches(line, '{X.DATED}') and not contains('-*•·–—', substr(line, 1, 1)) as fits from ls),
ln as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '^[\s\-_:|•·.\d()\[\]]+', '', 'g'), '[\s\-_:|•·.]+$', '', 'g'), '\s*[|/•·]\s*', ' ', 'g'), '[ \t\r\f\x0b]+', ' ', 'g')) as name from lf where fits),
lp as (select *, trim(regexp_replace(regexp_replace(name, '[^a-z0-9\s]', ' ', 'g'), '[ \t\r\f\x0b]+', ' ', 'g')) as plain from ln),
lw as (select *, list_distinct(string_split(plain, ' ')) as ws from lp where name <> ''),
lx as (select lw.doc_id, pos, line, e.section as exact, d.section as decorated from lw left join aliases e on e.alias = name left join aliases d on d.alias = plain),
ly as (select doc_id, pos, arg_min(a.section, a.rank) as loose from lw, aliases a where not regexp_matches(line, '\d') and plain <> '' and not list_has_any(ws, {X.PROSE})
  and list_has_all(ws, aw) and len(ws) <= len(aw) + 3 group by doc_id, pos),
lh as (select lx.doc_id, lx.pos, line as heading, coalesce(exact, decorated, loose) as name, case when exact is not null then 0.95 when decorated is not null then 0.9 else 0.75 end::double as base,
  length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) as letters, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) as upper from lx left join ly using (doc_id, pos) where coalesce(exact, decorated, loose) is not null),
hs as (select *, case when letters = 0 then base else round(least(1.0::double, base + (case when 10 * upper >= 8 * letters then 0.05 else 0 end + case when heading like '%:' then 0.02 else 0 end + case when {WORDS("heading")} <= 5 then 0.02 else 0 end)::double), 2) end as confidence,
  coalesce(lead(pos) over (partition by doc_id order by pos), 1000000000) as until from lh),
bodies as (select hs.doc_id, hs.pos, name, heading, confidence, {SPACED("coalesce(string_agg(line, chr(10) order by ls.pos) filter (line <> '' and regexp_replace(lower(line), ':+$', '') <> regexp_replace(lower(heading), ':+$', '')), '')")} as text
  from hs left join ls on ls.doc_id = hs.doc_id and ls.pos > hs.pos and ls.pos < hs.until group by all),
lead_in as (select ls.doc_id, 0 as pos, 'contact' as name, '' as heading, 0.5::double as confidence, {SPACED("string_agg(line, chr(10) order by pos)")} as text
  from ls join (select doc_id, min(pos) as first from hs group by doc_id) using (doc_id) where pos < first group by all),
bs as (select * from bodies union all select * from lead_in where text <> ''),
sb as (select doc_id, name, min(pos) as first, list_reduce(list({{'heading': heading, 'text': text, 'confidence': confidence}} order by pos), lambda a, b: case when {WORDS("b.text")} > {WORDS("a.text")}
  then {{'heading': b.heading, 'text': {SPACED("a.text || chr(10) || b.text")}, 'confidence': b.confidence}} else a end) as b from bs group by doc_id, name),
sectioned as (select doc_id, name, b.heading, b.text, b.confidence from sb
  union all select doc_id, 'unstructured', '', {SPACED("text")}, 0.2::double from profiles where regexp_matches(text, '\S') and doc_id not in (select doc_id from sb where b.text <> ''))"""
SECTIONED = f"{D.PROFILES}, {SECTIONS}"


@query(
    f"with {SECTIONED} select doc_id, name, heading, md5(text) as text_md5, confidence, (case when text = '' then 0 else len(regexp_extract_all(text, '\\n')) + 1 end)::bigint as n_lines, {WORDS('text')}::bigint as n_words from sectioned",
    D.profiles,
)
def profile_sections(docs):
    return X.sections(docs).select("doc_id", "name", "heading", F.md5("text").alias("text_md5"), "confidence", "n_lines", "n_words")


@query(
    f"""with {SECTIONED}, found as (select doc_id, list_sort(list(name) filter (text <> '' and name not in ('unstructured', 'references'))) as names from sectioned group by doc_id)
select doc_id, array_to_string(coalesce(names, []), ' ') as detected, array_to_string(list_sort(list_filter({X.EXPECTED}, lambda x: not list_contains(coalesce(names, []), x))), ' ') as missing from profiles left join found using (doc_id)""",
    D.profiles,
)
def section_presence(docs):
    return X.presence(docs).select("doc_id", F.array_join("detected", " ").alias("detected"), F.array_join("missing", " ").alias("missing"))


TODAY = "2002-01-01"
PLACES = lambda name, table, pattern: rf"""{name}_p as (select doc_id, text, unnest(string_split(regexp_replace(text, '({pattern})', chr(1) || '\1' || chr(2), 'g'), chr(1))) as piece,
  generate_subscripts(string_split(regexp_replace(text, '({pattern})', chr(1) || '\1' || chr(2), 'g'), chr(1)), 1) as k from {table}),
{name} as (select doc_id, text, k - 1 as k, off, string_split(piece, chr(2))[1] as match from (select *, (sum(length(piece)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding) - greatest(k - 2, 0))::int as off from {name}_p) where k > 1)"""  # noqa: E731
AROUND = lambda before, after: f"substr(text, greatest(off - {before}, 0) + 1, off + {after} - greatest(off - {before}, 0))"
DAY = lambda m, y: f"make_date({y}::int, case when {m} = '' then 1 else ((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr({m}, 1, 3))) + 2) / 3)::int end, 1)"
STUDIES = DT.STUDIES.replace("'", "''")
PERIODS = rf"""{SECTIONED}, {PLACES("spots", "profiles", DT.PERIOD)},
education as (select doc_id, trim(text) as w from sectioned where name = 'education'),
spots_out as (select s.*, regexp_extract_all(match, '{DT.PERIOD}', 1)[1] as m1, regexp_extract_all(match, '{DT.PERIOD}', 2)[1] as y1, regexp_extract_all(match, '{DT.PERIOD}', 3)[1] as m2,
  regexp_extract_all(match, '{DT.PERIOD}', 4)[1] as y2, regexp_extract_all(match, '{DT.PERIOD}', 5)[1] as o from spots s left join education using (doc_id)
  where not regexp_matches({AROUND(140, 140)}, '{STUDIES}') and (w is null or length(w) < 40 or instr(text, w) = 0 or off < instr(text, w) - 1 or off >= instr(text, w) - 1 + length(w))),
ends as (select doc_id, k, {DAY("m1", "y1")} as a, case when o <> '' then date '{TODAY}' else {DAY("m2", "nullif(y2, '')")} end as b from spots_out),
periods as (select doc_id, k, least(a, b) as s, greatest(a, b) as e from ends where year(greatest(a, b)) - year(least(a, b)) <= 40)"""


@query(f"with {PERIODS} select doc_id, (row_number() over (partition by doc_id order by k))::int as n, s::varchar as start, e::varchar as \"end\" from periods", D.profiles)
def profile_periods(docs):
    education = F.get(F.filter("sections", lambda s: s["name"] == "education"), F.lit(0))["text"]
    rows = DT.periods(X.with_sections(docs).withColumn("education", education), TODAY, "education").select("doc_id", F.posexplode_outer("periods").alias("n", "p")).where("p is not null")
    return rows.select("doc_id", (F.col("n") + 1).alias("n"), F.col("p.start").cast("string").alias("start"), F.col("p.end").cast("string").alias("end"))


@query(
    f"""with {PERIODS}, reach as (select *, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) as r from periods),
islands as (select *, sum((r is null or s > r)::int) over (partition by doc_id order by s, e rows unbounded preceding) as i from reach),
lengths as (select doc_id, (year(max(e)) - year(min(s))) * 12 + month(max(e)) - month(min(s)) + 1 as n from islands group by doc_id, i),
m as (select doc_id, sum(n)::int as months from lengths group by doc_id),
x as (select doc_id, coalesce(list_max(list_transform(regexp_extract_all(substr(text, 1, 1500), '{DT.YEARS}', 1), lambda v: v::double)), 0) as explicit from profiles)
select doc_id, coalesce(months, 0) as months, explicit, case when greatest(coalesce(months, 0) / 12.0::double, explicit) > 0 then round(least(greatest(coalesce(months, 0) / 12.0::double, explicit), 60), 1) end as years from x left join m using (doc_id)""",
    D.profiles,
)
def experience_years(docs):
    return DT.years_of_experience(docs, TODAY)


@query(
    rf"""with {D.PROFILES}, d as (select doc_id, list_concat(list_transform(regexp_extract_all(text, '{DT.PERIOD}'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
  list_transform(regexp_extract_all(text, '{DT.MONTH_YEAR}'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))) as d from profiles)
select doc_id, array_to_string(list_filter(d, lambda x, i: list_position(list_transform(d, lambda y: lower(y)), lower(x)) = i)[:40], '; ') as dates from d""",
    D.profiles,
)
def written_dates(docs):
    return DT.dates(docs).select("doc_id", F.array_join("dates", "; ").alias("dates"))


@query(
    rf"""with {D.POSTINGS}, {PLACES("spots", "postings", DT.ASKED_YEARS)},
meant as (select doc_id, max(n) as n from (select doc_id, regexp_extract(match, '{DT.ASKED_YEARS}', 1)::int as n from spots where list_has_any([contains(lower({AROUND(120, "length(match) + 120")}), w) for w in {DT.ABOUT_YEARS}], [true])) where n <= 40 group by doc_id),
firsts as (select doc_id, arg_min(match, k) as match from spots group by doc_id)
select doc_id, n::double as min_years, coalesce(n || '+ years', trim(regexp_replace(match, '\s+', ' ', 'g'))) as phrase from postings left join meant using (doc_id) left join firsts using (doc_id)""",
    D.postings,
)
def asked_years(docs):
    return DT.asked_years(docs)


LEVEL = lambda t: "case " + " ".join("when " + " or ".join(f"contains(lower({t}), '{w}')" for w in signs) + f" then '{name}'" for name, signs in DT.LEVELS.items()) + " else 'certification' end"
ANY_DEGREE = DT._any_of(DT.DEGREES).replace("'", "''")
SHOWN = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in DT.SHOWN.items()) + "}"
INITCAP = lambda t: f"array_to_string(list_transform(string_split({t}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
FIELD = "coalesce(" + ", ".join(rf"case when regexp_matches(win, '(?i)\bin\s+{f}') or regexp_matches(substr(win, length(match) + 1), '(?i)^\s*[,(-]?\s*{f}') then {INITCAP(repr(f))} end" for f in DT.FIELDS) + ")"


@query(
    rf"""with {SECTIONED}, scoped as (select p.doc_id, coalesce(nullif(s.text, ''), p.text) as text from profiles p left join sectioned s on s.doc_id = p.doc_id and s.name = 'education'), {PLACES("spots", "scoped", ANY_DEGREE)},
calm as (select *, string_split(substr(text, 1, off), chr(10))[-1] || string_split(substr(text, off + 1), chr(10))[1] as line, substr(text, off + 1, 160) as win from spots),
named as (select doc_id, k, match, {FIELD} as field, array_to_string(list_transform(string_split(lower(match), ' '), lambda w, i: coalesce({SHOWN}[w], case when i > 1 and w in ('in', 'of', 'and', 'the') then w else upper(substr(w, 1, 1)) || lower(substr(w, 2)) end)), ' ') as shown
  from calm where length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) < 4 or 10 * length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) < 9 * length(regexp_replace(line, '[^\p{{L}}]', '', 'g'))),
keyed as (select doc_id, k, shown || coalesce(' in ' || field, '') as d, substr(regexp_replace(lower(shown), '[^a-z0-9]', '', 'g'), 1, 5) as key from named),
best as (select doc_id, key, min(k) as k, arg_max(d, (length(d), -k)) as d from keyed group by all),
levels as (select doc_id, string_agg(d, '; ' order by k) as degrees, max(list_position({DT.RANKS}, {LEVEL("d")})) as r from best group by doc_id)
select doc_id, coalesce(degrees, '') as degrees, ({DT.RANKS})[r] as level from profiles left join levels using (doc_id)""",
    D.profiles,
)
def profile_degrees(docs):
    return DT.degrees(docs).select("doc_id", F.array_join("degrees", "; ").alias("degrees"), "level")


@query(
    rf"""with {D.POSTINGS}, {PLACES("spots", "postings", ANY_DEGREE)},
asked as (select doc_id, k, substr(trim(regexp_replace(regexp_extract(substr(text, 1, off), '[^.\n]*$') || regexp_extract(substr(text, off + 1), '^(?s:.)[^.\n]*\.?'), '\s+', ' ', 'g'), ' -•:|'), 1, 220) as s
  from spots where regexp_matches({AROUND(90, "length(match) + 90")}, '{DT.ASKS}'))
select doc_id, arg_min(s, (case when regexp_matches(s, '(?i)\b(required|minimum|must)\b') then 0 else 1 end, k)) as phrase from postings left join asked using (doc_id) group by doc_id""",
    D.postings,
)
def asked_degree(docs):
    return DT.asked_degree(docs)


KEY = lambda t: rf"array_to_string(regexp_extract_all(lower({t}), '{SP.PIECE}'), ' ')"


def hits_sql(name: str, source: str, table: str = "dictionary") -> str:
    """CTEs ending in name (doc_id, off, n, surface, canonical, category): all hits of a dictionary in source (doc_id, text)."""
    return rf"""{name}_t as (select doc_id, regexp_extract_all(regexp_replace(text, '[''’]s\b', '', 'g'), '{SP.PIECE}') as ts from {source}),
{name}_g as (select doc_id, unnest(range(len(ts))) as off, ts from {name}_t), {name}_n as (select doc_id, off, n, lower(array_to_string(ts[off + 1:off + n], ' ')) as key, regexp_matches(ts[off + 1], '^\p{{Lu}}') as capital from {name}_g, (select unnest(range(1, 5)) as n) where off + n <= len(ts)),
{name}_k as (select {KEY("surface")} as key, * exclude (key) from (select *, '' as key from {table}) where policy <> 'drop'), {name}_s as (select * from {name}_k union all select key || 's' as key, * exclude (key) from {name}_k),
{name}_o as (select key, arg_min({{'surface': surface, 'canonical': canonical, 'category': category, 'policy': policy}}, (canonical, surface, category, policy)) as o from {name}_s where key <> '' group by key),
{name} as (select doc_id, off, n, o.surface, o.canonical, o.category from {name}_n join {name}_o using (key) where o.policy <> 'exact' or capital)"""


def kept_sql(name: str, found: str, order: str, keep: str) -> str:
    return f"""{name}_l as (select doc_id, list({{'off': off, 'n': n, 'surface': surface, 'canonical': canonical, 'category': category}} order by {order}) as hs from {found} group by doc_id),
{name}_r as (select doc_id, list_reduce(list_transform(hs, lambda h: [h]), lambda a, h: case when {keep} then list_concat(a, h) else a end) as hs from {name}_l),
{name} as (select doc_id, h.* from (select doc_id, unnest(hs) as h from {name}_r))"""


GREEDY = lambda name, found: kept_sql(name, found, "-length(surface), off, n, surface", "len(list_filter(a, lambda k: not (k.off + k.n <= h[1].off or h[1].off + h[1].n <= k.off))) = 0")
LEFTMOST = lambda name, found: kept_sql(name, found, "off, -n, surface", "h[1].off >= a[-1].off + a[-1].n")
SKILLS_OF = lambda name, source: f"{hits_sql(name + '_h', source)}, {GREEDY(name + '_k', name + '_h')}, {name} as (select doc_id, canonical as skill, min(category) as category, count(*) as n from {name}_k group by all)"


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived dictionary, written once: Spark knows its size then, and needn't shuffle the texts' words to meet a small one."""
    return FT.written(D.dictionary(spark, sf_dir))


@query(f"with {D.POSTINGS}, {D.DICTIONARY}, {hits_sql('found', 'postings')}, {GREEDY('kept', 'found')} select doc_id, off as first, n, surface, canonical, category from kept", D.postings, _dictionary)
def dictionary_spans(docs, dictionary):
    return SP.greedy(SP.hits(docs, dictionary))


@query(f"with {D.PROFILES}, {D.DICTIONARY}, {hits_sql('found', 'profiles')}, {LEFTMOST('kept', 'found')} select doc_id, off as first, n, surface, canonical, category from kept", D.profiles, _dictionary)
def leftmost_spans(docs, dictionary):
    return SP.leftmost(SP.hits(docs, dictionary))


PROFILE_SKILLS = f"""{SECTIONED}, {D.DICTIONARY}, scopes as (select doc_id, string_agg(text, chr(10) order by list_position(['skills', 'experience', 'projects', 'summary', 'certifications'], name)) as text from sectioned
  where text <> '' and name in ('skills', 'experience', 'projects', 'summary', 'certifications') group by doc_id),
scoped as (select p.doc_id, coalesce(s.text, p.text) as text from profiles p left join scopes s using (doc_id)), {SKILLS_OF('inner_skills', 'scoped')},
others as (select * from profiles where doc_id not in (select doc_id from inner_skills)), {SKILLS_OF('outer_skills', 'others')}, left_skills as (select * from inner_skills union all select * from outer_skills)"""


@query(f"with {PROFILE_SKILLS} select * from left_skills", D.profiles, _dictionary)
def profile_skills(docs, dictionary):
    return SP.profile_skills(docs, dictionary)


STARTS = lambda x, marks: " or ".join(f"starts_with({x}, '{m}')" for m in marks)
BLOCKS = rf"""{D.POSTINGS}, bl as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from postings),
bk as (select *, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) as x from bl),
bm as (select *, case when x = '' then 'blank' when {STARTS("x", SP.PREFERRED)} then 'preferred' when {STARTS("x", SP.REQUIRED)} then 'required'
  when len(regexp_extract_all(x, '\S+')) <= 6 and regexp_matches(x, '{SP.OTHER_BLOCKS}') then 'other' else 'line' end as kind from bk),
bf as (select *, last_value(case when kind in ('preferred', 'required', 'other') then kind end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as block from bm),
bt as (select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (block = 'required' and kind = 'line'), '') as required, coalesce(string_agg(line, chr(10) order by pos) filter (block = 'preferred' and kind = 'line'), '') as preferred from bf group by doc_id)"""
POSTING_SKILLS = f"""{BLOCKS}, {D.DICTIONARY}, must_text as (select doc_id, required as text from bt), nice_text as (select doc_id, preferred as text from bt), {SKILLS_OF('must_skills', 'must_text')}, {SKILLS_OF('nice_skills', 'nice_text')}, {SKILLS_OF('all_skills', 'postings')},
right_skills as (select a.doc_id, a.skill, a.category, case when n.skill is not null and m.skill is null then 'preferred' else 'required' end as kind
  from all_skills a left join must_skills m on m.doc_id = a.doc_id and m.skill = a.skill left join nice_skills n on n.doc_id = a.doc_id and n.skill = a.skill)"""


@query(f"with {BLOCKS} select doc_id, required, preferred from bt", D.postings)
def requirement_blocks(docs):
    return SP.requirement_blocks(docs)


@query(f"with {POSTING_SKILLS} select * from right_skills", D.postings, _dictionary)
def posting_skills(docs, dictionary):
    return SP.posting_skills(docs, dictionary).drop("n")


VERBS = rf"list_distinct(regexp_extract_all(lower(text), '\b(?:{'|'.join(SP.ACTIONS)})\b'))"


@query(rf"with {D.PROFILES}, v as (select doc_id, regexp_extract_all(lower(text), '\b(?:{'|'.join(SP.ACTIONS)})\b') as v from profiles) select doc_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ' ') as verbs from v", D.profiles)
def action_verbs(docs):
    return SP.action_verbs(docs).select("doc_id", F.array_join("verbs", " ").alias("verbs"))


SOFT = [("team work", "teamwork"), ("Teamwork", "teamwork"), ("communication", "communication"), ("look for people", "recruiting"), ("priority", "ranking")]


def _soft(spark, sf_dir):
    return spark.createDataFrame(SOFT, "surface string, canonical string")


@query(
    rf"""with {D.POSTINGS}, soft as (select lower(s) as s, c from (values {", ".join(map(str, SOFT))}) v(s, c)), f as (select doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as t from postings),
p as (select doc_id, t, list_transform(list_filter(regexp_extract_all(t, '[a-z][a-z0-9+#.\-/&]*'), lambda w: length(w) >= 5), lambda w: substr(w, 1, 4)) as ps from f)
select distinct doc_id, c as skill from p, soft where case when contains(s, ' ') then contains(t, s) else length(s) >= 5 and list_contains(ps, substr(s, 1, 4)) end""",
    D.postings, _soft,
)
def soft_skills(docs, soft):
    return SP.soft_skills(docs, soft)


def _certificate_names(spark, sf_dir):
    return spark.createDataFrame([("Certified fork lift driver",), ("fork lift",), ("Best clerk",), ("priority clerk",)], "surface string")


def _certificates(spark, sf_dir):
    return D.dictionary(spark, sf_dir).select("surface").union(_certificate_names(spark, sf_dir))


@query(
    f"""with {D.PROFILES}, {D.DICTIONARY}, gazetteer as (select s as surface, s as canonical, 'name' as category, 'any' as policy from (values ('Certified fork lift driver'), ('fork lift'), ('Best clerk'), ('priority clerk')) v(s)),
{hits_sql('found', 'profiles', 'gazetteer')}, {LEFTMOST('kept', 'found')}, firsts as (select doc_id, canonical, min(off) as off from kept group by all)
select doc_id, array_to_string(list(canonical order by off)[:15], '; ') as names from firsts group by doc_id""",
    D.profiles, _certificates, _dictionary,
)
def certificates(docs, gazetteer, dictionary):
    return SP.mentions(docs, gazetteer, dictionary).select("doc_id", F.array_join("names", "; ").alias("names"))


@query(
    rf"""with {D.POSTINGS}, l as (select doc_id, text, nullif(trim(regexp_extract(text, '{SP.TITLE_LINE}', 1)), '') as title, nullif(trim(regexp_extract(text, '{SP.PLACE_LINE}', 1)), '') as pl,
  nullif(trim(regexp_extract(text, '{SP.EMPLOYER_LINE}', 1)), '') as employer, nullif(trim(regexp_replace(regexp_extract(text, '{SP.PAY}'), '\s+', ' ', 'g')), '') as pay from postings),
p as (select *, regexp_replace(trim(regexp_replace(regexp_extract(pl, '{SP.TRAILERS}', 1), '\s+', ' ', 'g')), '^[ ,:\-–—|]+|[ ,:\-–—|]+$', '', 'g') as stated from l)
select doc_id, {INITCAP("substr(title, 1, 80)")} as title, coalesce(case when stated <> '' and length(stated) <= 60 and not regexp_matches(stated, '\d{{4,}}') then stated end,
  case when regexp_matches(text, '(?i)\b(remote|work from home|wfh|fully remote|anywhere)\b') then 'Remote' end) as place, employer, pay from p""",
    D.postings,
)
def posting_facts(docs):
    return SP.posting_facts(docs)


PAIR_SKILLS = f"""{PROFILE_SKILLS}, {POSTING_SKILLS.replace(D.DICTIONARY + ",", "")}, {D.PAIRS},
sk as (select pair_id, skill as l, null as r, category from pairs join left_skills on left_id = doc_id union all select pair_id, null, skill, category from pairs join right_skills on right_id = doc_id),
sides as (select pair_id, lower(coalesce(r, l)) as key, min(l) as l, min(r) as r, min(category) as category from sk group by all),
matches as (select pair_id, coalesce(r, l) as skill, case when l is not null and r is not null then 'matched' when r is not null then 'missing' else 'extra' end as status, category from sides),
counted as (select p.pair_id, coalesce(count(*) filter (status = 'matched'), 0) as matched, 0::bigint as partial, coalesce(count(*) filter (status = 'missing'), 0) as missing, coalesce(count(*) filter (status = 'extra'), 0) as extra from pairs p left join matches m using (pair_id) group by p.pair_id),
rated as (select *, case when matched + missing > 0 then matched::double / (matched + missing) else 0 end as q, case when matched + extra > 0 then matched::double / (matched + extra) else 0 end as p from counted),
metrics as (select pair_id, matched, partial, missing, extra, round(q, 4) as recall, round(p, 4) as precision, round(case when p + q > 0 then 2 * p * q / (p + q) else 0 end, 4) as f1,
  round(case when matched + missing > 0 then least(100.0::double, 100 * matched::double / (matched + missing)) when extra > 0 then 100 else 0 end, 2) as score from rated)"""


def _rows(*parts: str, fuzzy: float | None = None, fields: tuple[str, ...] = CP.FIELDS, names=None):
    """Rows of pairs with these parts; the feature tables of both sides are written once. names: a gazetteer, of which the left's section
    certifications (its whole text where there is none) and the right may hold certificates and asked_certificates."""

    def rows(spark, sf_dir):
        words = _dictionary(spark, sf_dir)
        left = FT.profile_features(D.profiles(spark, sf_dir), words, TODAY, parts)
        right = FT.posting_features(D.postings(spark, sf_dir), words, parts)
        if names:
            left = SP.with_mentions(left, X.scope_of(F.col("text"), F.col("sections"), ["certifications"]), names(spark, sf_dir)).withColumnRenamed("names", "certificates")
            right = SP.with_mentions(right, F.col("text"), names(spark, sf_dir)).withColumnRenamed("names", "asked_certificates")
        # texts and content tokens that no row of a pair reads aren't written
        unread = [*(["text"] if FT.KEYWORDS not in parts else []), *(["content"] if FT.COSINE not in parts else [])]
        left, right = left.drop("text", *(["content"] if "importance" not in fields and FT.COSINE not in parts else [])), right.drop(*unread)
        return FT.pair_rows(D.pairs(spark, sf_dir), FT.written(left), FT.written(right), parts, fuzzy, fields)

    return rows


@query(f"with {PAIR_SKILLS} select * from matches", _rows(FT.SKILLS))
def exact_skill_matches(rows):
    return M.matches_of(rows).select("pair_id", "skill", "status", "category")


@query(f"with {PAIR_SKILLS} select * from metrics", _rows(FT.SKILLS))
def skill_metrics(rows):
    return rows.select("pair_id", "metrics.*")


@query(f"with {PAIR_SKILLS} select pair_id, status, coalesce(category, 'other') as category, string_agg(skill, ', ' order by lower(skill), skill) as skills from matches where status <> 'extra' group by all", _rows(FT.SKILLS))
def skills_by_category(rows):
    return M.by_category(M.matches_of(rows)).withColumn("skills", F.array_join("skills", ", "))


@query(
    f"""with {PAIR_SKILLS}, g as (select pair_id, m.skill, coalesce(m.category, 'other') as category, case r.kind when 'required' then 'high' when 'preferred' then 'low' else 'medium' end as importance, coalesce(a.n, 1)::bigint as mentions
  from matches m join pairs using (pair_id) left join right_skills r on r.doc_id = right_id and r.skill = m.skill left join all_skills a on a.doc_id = right_id and a.skill = m.skill where status = 'missing')
select pair_id, (row_number() over (partition by pair_id order by list_position(['high', 'medium', 'low'], importance), mentions desc, skill))::int as rank, skill, category, importance, mentions from g""",
    _rows(FT.SKILLS),
)
def skill_gaps(rows):
    return M.skill_gaps(rows)


@query(None, _rows(FT.SKILLS, fuzzy=85.0))
def fuzzy_skill_matches(rows):
    return M.matches_of(rows)


TOP = lambda source: Q.ORACLE["tfidf_terms"].replace("from documents", f"from {source}")
TEXTS = f"{D.PROFILES}, {D.POSTINGS}, {D.PAIRS}"
STEMS = f"list_filter(list_concat([term], list_transform({CP.ENDINGS}, lambda e: case when suffix(term, e) and length(term) - length(e) >= 4 then substr(term, 1, length(term) - length(e)) end)), lambda x: x is not null)"
COMPARED = rf"""with {TEXTS}, lk as ({TOP("profiles")}), rk as ({TOP("postings")}), own as (select doc_id, list(tok) as own from lk group by doc_id),
ctx as (select pair_id, right_id, lower(r.text) as rt, lower(l.text) as lt, own, ' ' || trim(regexp_replace(lower(l.text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) || ' ' as lw, ' ' || trim(regexp_replace(lower(r.text), '\s+', ' ', 'g')) || ' ' as rw,
  ' ' || array_to_string(list_filter(regexp_extract_all(lower(l.text), '[\p{{L}}\p{{N}}]+'), lambda t: t not in ({Q.STOPS}) and length(t) > 1), ' ') || ' ' as lc
  from pairs join postings r on r.doc_id = right_id join profiles l on l.doc_id = left_id left join own on own.doc_id = left_id),
ks as (select ctx.*, tok as term, score from ctx join rk on rk.doc_id = right_id),
compared as (select pair_id, right_id as doc_id, term, score, contains(lt, term) or coalesce(list_contains(own, term), false) or len(list_filter({STEMS}, lambda s: contains(lw, ' ' || s))) > 0 as found,
  ((length(rt) - length(replace(rt, term, ''))) // length(term))::bigint as occurrences, round(score * (1 + ln(1 + case when contains(lc, ' ' || term || ' ') then 1.0::double else 1 + ln(1.5) end)) / 3, 6) as importance
  from ks where not contains(term, ' ') or contains(rw, term)),
ranked as (select *, row_number() over (partition by pair_id order by score desc, term) as rank from compared),
covered as (select pair_id, count(*)::int as considered, (count(*) filter (found))::int as found, round((count(*) filter (found))::double / count(*), 6) as coverage from ranked where rank <= 25 group by pair_id)"""


@query(f"{COMPARED} select * from compared", _rows(FT.KEYWORDS))
def compared_keywords(rows):
    return CP.compared_rows(rows)


@query(f"{COMPARED} select * from covered", _rows(FT.KEYWORDS, fields=()))
def compared_coverage(rows):
    return CP.coverage_of(rows)


@query(
    rf"""{COMPARED}, facts as ({ORACLE["posting_facts"]}), noise as (select doc_id, unnest(list_distinct(list_concat(list_filter([lower(trim(employer)), lower(trim(place))], lambda x: coalesce(x, '') <> ''),
  list_filter(string_split_regex(lower(coalesce(employer, '')), '[^\w&]+'), lambda p: length(p) > 2), {SC.SET_PHRASES}))) as term from facts),
m as (select pair_id, term, round(importance + 1e-9, 4) as importance from ranked r where rank <= 25 and not found and not exists (select 1 from noise n where n.doc_id = r.doc_id and (n.term = r.term or list_contains(string_split(r.term, ' '), n.term))))
select pair_id, (row_number() over (partition by pair_id order by importance desc, term))::int as rank, term, importance, case when importance >= 0.35 then 'high' when importance >= 0.15 then 'medium' else 'low' end as severity from m""",
    _rows(FT.KEYWORDS, FT.PLACES, fields=("importance",)),
)
def missing_keywords(rows):
    return SC.missing_keywords(rows)


GIVEN_COSINE = f"""select pair_id, cosine from (with {TEXTS}, documents as (select pair_id * 2 as doc_id, text from pairs join profiles on left_id = doc_id union all select pair_id * 2 + 1, text from pairs join postings on right_id = doc_id), {Q.COSINE} select * from cosines)"""


@query(GIVEN_COSINE, D.pairs, D.profiles, D.postings)
def given_pair_cosine(pairs, left, right):
    return P.cosine_of(pairs, left, right)


def _named(rows: DataFrame) -> DataFrame:
    """Rows of pairs with the names that scores know some of their features by."""
    names = {"required_years": ("min_years",), "skill_score": ("metrics", "score"), "similarity": ("cosine",), "tfidf_cosine": ("cosine",)}
    rows = rows.withColumns({n: F.col(".".join(of)) for n, of in names.items() if of[0] in rows.columns})
    return rows.withColumn("has_education", F.array_contains("detected", "education"))


def _scored(spark, sf_dir):
    """A row for each pair with all its features. Where LSA would give the texts' similarity, which SQL can't, the cosine of terms stands for it."""
    coverage = F.coalesce("cover.coverage", F.lit(0.0))
    return _named(_rows(FT.FACTS, FT.SKILLS, FT.KEYWORDS, FT.COSINE, fields=())(spark, sf_dir)).withColumns({"coverage": coverage, "section_similarity": coverage})


def _gap_rows(spark, sf_dir):
    return _named(_rows(FT.YEARS, FT.DEGREES)(spark, sf_dir))


WORD_SET = lambda t: rf"list_filter(list_distinct(string_split_regex(trim(replace(lower({t}), '-', ' ')), '\s+')), lambda w: length(w) > 2)"
ASKED = lambda levels: "case " + " ".join("when " + " or ".join(f"contains(lower(degree_phrase), '{w}')" for w in signs) + f" then {DT.RANKS.index(n)}" for n, signs in levels.items()) + " else -1 end"
FEATURES = rf"""with {TEXTS}, feats as (select p.pair_id, p.left_id, p.right_id, list_sort(list_distinct(regexp_extract_all(l.text, '\| (.* clerk)', 1))) as titles, len(regexp_extract_all(l.text, '{T.QUANTITY}')) as n_quantities, years,
  case when verbs = '' then 0 else len(string_split(verbs, ' ')) end as n_verbs, degrees, level, list_contains(string_split(detected, ' '), 'education') as has_education, title, min_years as required_years, a.phrase as degree_phrase,
  coalesce(cosine, 0) as cosine, coalesce(coverage, 0) as coverage, m.score as skill_score
  from pairs p join profiles l on l.doc_id = left_id join ({ORACLE["experience_years"]}) y on y.doc_id = left_id join ({ORACLE["action_verbs"]}) v on v.doc_id = left_id join ({ORACLE["profile_degrees"]}) d on d.doc_id = left_id
  join ({ORACLE["section_presence"]}) s on s.doc_id = left_id join ({ORACLE["posting_facts"]}) f on f.doc_id = right_id join ({ORACLE["asked_years"]}) r on r.doc_id = right_id join ({ORACLE["asked_degree"]}) a on a.doc_id = right_id
  left join ({GIVEN_COSINE}) c on c.pair_id = p.pair_id left join ({ORACLE["compared_coverage"]}) g on g.pair_id = p.pair_id join ({ORACLE["skill_metrics"]}) m on m.pair_id = p.pair_id),
ranked_feats as (select *, coalesce(list_position({DT.RANKS}, level), 0) - 1 as have, {ASKED(SC.ASKED_LEVELS)} as asked, {ASKED(SC.GAP_LEVELS)} as gap_asked, list_filter({DT.FIELDS}, lambda f: contains(lower(coalesce(degree_phrase, '')), f)) as fields from feats)"""
CALIBRATED = lambda x, tau: f"case when {x} <= 0 then 0 else least(1.0::double, 1 - exp(-{x} / {tau}::double)) end"
EDUCATION = """case when asked < 0 and have >= 0 then 90 when asked < 0 then case when has_education then 70 else 45 end when have < 0 then 25
  when have >= asked then case when other then 88 else 100 end when have = asked - 1 then case when other then 62 else 72 end else 40 end::double"""
SCORES = rf"""{FEATURES}, parts as (select *, len(fields) > 0 and degrees <> '' and len(list_filter(fields, lambda f: contains(lower(degrees), f))) = 0 as other,
  case when required_years > 0 then least(100.0::double, 100 * coalesce(years, 0) / required_years) else least(100.0::double, 45 + 7 * coalesce(years, 0)) end as by_years,
  case when coalesce(title, '') = '' then case when len(titles) > 0 then 60 else 20 end when len({WORD_SET("title")}) = 0 then 50
    else 100 * coalesce(list_max(list_transform(titles, lambda t: len(list_intersect({WORD_SET("t")}, {WORD_SET("title")}))::double / len({WORD_SET("title")}))), 0) end::double as by_title, least(40, 4 * n_verbs + 4 * least(n_quantities, 10)) / 0.4::double as quality from ranked_feats),
scores as (select pair_id, left_id, right_id, n_quantities, years, required_years, degree_phrase, level, degrees, have, asked, gap_asked, round(100 * (0.45::double * ({CALIBRATED("cosine", 0.2)}) + 0.55::double * coverage) + 1e-9, 2) as keyword_match, round(100 * ({CALIBRATED("cosine", 0.15)}) + 1e-9, 2) as semantic_similarity,
  round(skill_score + 1e-9, 2) as skill_match, round(0.55::double * by_years + 0.2::double * by_title + 0.15::double * 100 * coverage + 0.1::double * quality + 1e-9, 2) as experience_relevance, {EDUCATION} as education_match from parts),
overalls as (select *, round(least(100.0::double, keyword_match * 0.25::double + semantic_similarity * 0.3::double + skill_match * 0.25::double + experience_relevance * 0.1::double + education_match * 0.1::double) + 1e-9, 1) as overall from scores)"""


@query(f"{SCORES} select pair_id, keyword_match, semantic_similarity, skill_match, experience_relevance, education_match, overall, case when overall >= 85 then 'A' when overall >= 70 then 'B' when overall >= 55 then 'C' when overall >= 40 then 'D' else 'F' end as grade from overalls", _scored)
def weighted_scores(features):
    return SC.full_scores(features)


NUMBER = lambda x: rf"regexp_replace(printf('%.2f', {x}), '\.?0+$', '')"
LABEL = lambda x: "map {" + ", ".join(f"'{k}': '" + v.replace("'", "''") + "'" for k, v in SC.LABELS.items()) + "}" + f"[{x}]"


@query(
    rf"""{SCORES} select pair_id, case when coalesce(required_years, 0) > 0 then case when years is null then {NUMBER("required_years")} || ' years of experience are asked for, but none could be found.'
  when years + 0.25 < required_years then 'About ' || printf('%.1f', years) || ' years of experience against ' || {NUMBER("required_years")} || ' asked for, ' || printf('%.1f', required_years - years) || ' short.' end end as experience_gap,
case when coalesce(degree_phrase, '') <> '' then case when level is null and degrees = '' then 'A degree is asked for (' || substr(degree_phrase, 1, 120) || '), but none was found.'
  when gap_asked >= 0 and have < gap_asked then coalesce({LABEL("level")}, 'No degree') || ' is below ' || {LABEL(f"({DT.RANKS})[gap_asked + 1]")} || ', which is asked for.' end end as education_gap from scores""",
    _gap_rows,
)
def experience_and_education_gaps(features):
    return SC.gaps(features)


def _with_sections(rows, own):
    """Rows of _named() with own_sections: an array of the left's sections with their similarities, and education_score."""
    return rows.withColumn("own_sections", held(own)).withColumn("education_score", SC.education_score(F.col("level"), F.col("degree_phrase"), F.col("degrees"), F.col("has_education")))


def _own_section(section, similarity):
    return F.struct(section["name"].alias("name"), similarity.alias("similarity"), (section["text"] != "").alias("present"))


def _section_rows(spark, sf_dir):
    """A section's similarity is the share of the posting's content tokens that it has, as SQL can't express the latent one."""
    similarity = lambda ws: F.when(F.size("right_words") > 0, F.round(F.size(F.array_intersect(ws, F.col("right_words"))) / F.size("right_words"), 6)).otherwise(0.0)
    own = F.zip_with("sections", "section_words", lambda s, ws: _own_section(s, similarity(ws)))
    return _with_sections(_named(_rows(FT.DEGREES, FT.SKILLS, FT.SECTION_WORDS)(spark, sf_dir)), own).drop("right_words", "section_words")


CONTENT_SET = lambda t: rf"list_distinct(list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+'), lambda t: t not in ({Q.STOPS}) and length(t) > 1))"
SECTION_SCORES = rf"""{SCORES}, secs as (select * from (with {SECTIONED} select doc_id, name, text from sectioned)),
pair_secs as (select sc.*, s.name, s.text <> '' as present, round(len(list_intersect({CONTENT_SET("s.text")}, {CONTENT_SET("r.text")}))::double / len({CONTENT_SET("r.text")}), 6) as similarity from scores sc join secs s on s.doc_id = left_id join postings r on r.doc_id = right_id),
based as (select *, 100 * ({CALIBRATED("similarity", 0.15)}) as base from pair_secs where name not in ('contact', 'references')),
sec_scores as (select pair_id, name, similarity, present, round(least(100.0::double, case when name = 'skills' then 0.4::double * base + 0.6::double * skill_match when name = 'experience' and n_quantities < 3 then 0.9::double * base
  when name = 'education' then 0.5::double * base + 0.5::double * education_match when name = 'summary' and not present then 0 else base end) + 1e-9, 1) as score from based)"""


@query(f"{SECTION_SCORES} select * from sec_scores", _section_rows)
def section_scores(rows):
    return SC.section_scores(rows.select("pair_id", "skill_score", "n_quantities", "education_score", F.inline_outer("own_sections")).where("name is not null")).select("pair_id", "name", "similarity", "present", "score")


@query(
    rf"""{SECTION_SCORES}, here as (select pair_id, string_split(detected, ' ') as names from pairs join ({ORACLE["section_presence"]}) on doc_id = left_id),
weak as (select pair_id, unnest(list_filter({SC.EXPECTED}, lambda x: not list_contains(names, x))) as section, 0::double as score from here
  union all select pair_id, name, score from sec_scores where present and score < case when name in {tuple(SC.EXPECTED)} then 55 when name in {tuple(SC.OPTIONAL)} then 25 else 0 end)
select pair_id, (row_number() over (partition by pair_id order by score, section))::int as rank, section, score from weak""",
    _section_rows,
)
def weak_sections(rows):
    return rows.select("pair_id", F.inline_outer(SC.weak_of(rows))).where("section is not null")


COUNT = lambda p: f"len(regexp_extract_all(text, '{p}'))"


def _checked(spark, sf_dir):
    rows = FT.profile_features(D.profiles(spark, sf_dir), D.dictionary(spark, sf_dir), TODAY, (FT.FACTS,))
    return rows.select("doc_id", "text", F.col("detected").alias("names"), "n_contacts", "n_bytes")


@query(
    rf"""with {D.PROFILES}, n as (select doc_id, text, string_split(detected, ' ') as names from profiles join ({ORACLE["section_presence"]}) using (doc_id)),
e as (select doc_id, {COUNT(SC.EMOJI)} as emoji, (length(trim(text)) >= 50)::int as text_extractable, ({COUNT(T.EMAIL)} + {COUNT(T.PHONE.replace("'", "''"))} > 0)::int as contact_info, list_has_all(names, ['experience', 'education', 'skills'])::int as standard_headers, 1 as no_tables, 1 as few_images,
  ({COUNT(SC.COLUMN_GAP)} < 4)::int as single_column, 1 as page_count, ({WORDS("text")} between 250 and 1500)::int as word_count, (strlen(text) <= 1048576)::int as file_size, ({COUNT(SC.EMOJI)} = 0 and {COUNT("[^" + chr(92) + "x00-" + chr(92) + "x7F]")} <= 12)::int as clean_charset,
  ({COUNT(SC.BULLET)} >= 3)::int as bullet_points, ({COUNT(SC.DATE_LINE)} >= 1)::int as parseable_dates, 1 as keyword_density from n),
s as (select *, {" + ".join(SC.CHECKS)} as passed, {" + ".join(f"{w} * {c}" for c, w in SC.CHECKS.items())} + (emoji > 0)::int * clean_charset as earned, {sum(SC.CHECKS.values())} + (emoji > 0)::int as total from e)
select * exclude (emoji, earned, total), round(100.0::double * earned / total + 1e-9, 1) as score from s""",
    _checked,
)
def profile_checks(rows):
    return SC.document_checks(rows)


@query(
    rf"""with kw as ({TOP("documents")}), t as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as ts from documents), g as (select doc_id, ts, unnest(ts) as tok, unnest(range(1, len(ts) + 1)) as pos from t),
p as (select doc_id, string_split(tok, ' ') as p from kw), h as (select g.doc_id, unnest(range(pos, pos + len(p.p))) as at_pos from g join p on p.doc_id = g.doc_id and p.p[1] = g.tok and g.ts[g.pos:g.pos + len(p.p) - 1] = p.p),
c as (select doc_id, count(distinct at_pos)::int as covered from h group by doc_id), d as (select t.doc_id, coalesce(covered, 0) as covered, len(ts)::int as n, case when len(ts) > 0 then round(coalesce(covered, 0)::double / len(ts), 4) else 0 end as density from t left join c using (doc_id) where ts is not null)
select *, case when density < 0.05 then 'under_optimized' when density > 0.6 then 'over_optimized' else 'optimal' end as band from d""",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet"),
)
def keyword_cover(docs):
    return CP.keyword_cover(docs, K.top_terms(docs).select("doc_id", F.col("tok").alias("term")))


@query(None, lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet"))
def three_rankings(docs):
    return CP.three_rankings(docs)


@query(None, D.pairs, D.profiles, D.postings)
def latent_similarity(pairs, left, right):
    return SM.pair_similarity(pairs, left, right)


@query(None, D.pairs, D.profiles, D.postings)
def latent_section_similarity(pairs, left, right):
    return SM.section_similarity(pairs, X.sections(left), right)


def _advised(spark, sf_dir):
    """All that recommendations rest on, in the row of each pair: similarities of texts and sections are latent ones, skills may match in part. No text is scanned."""
    parts = (FT.FACTS, FT.SKILLS, FT.KEYWORDS, FT.COSINE, FT.LATENT, FT.DENSITY)
    rows = _named(_rows(*parts, fuzzy=85.0, fields=("importance",), names=_certificate_names)(spark, sf_dir))
    of = lambda name: F.coalesce(F.get("section_latent", (F.array_position("latent_names", name) - 1).cast("int")), F.lit(0.0))
    rows = rows.withColumns({"similarity": F.coalesce("latent", F.lit(0.0)), "coverage": F.coalesce("cover.coverage", F.lit(0.0)), "section_similarity": of(F.lit("experience"))})
    rows = _with_sections(rows, F.transform("sections", lambda s: _own_section(s, of(s["name"]))))
    rows = rows.withColumns({"__gaps": held(M.gaps_of(F.col("matches"), F.col("rights"))), "__noise": SC.noise_of(F.col("employer"), F.col("place"))})
    rows = rows.withColumn("__terms", held(SC.missing_of(F.col("compared"), F.col("__noise")))).withColumn("weak", held(SC.weak_of(rows)))
    pick = lambda c, field, value, name: F.transform(F.filter(c, lambda x: x[field] == value), lambda x: x[name])
    rows = rows.withColumns({n: pick("__gaps", "importance", k, "skill") for k, n in (("high", "required"), ("medium", "open"), ("low", "preferred"))})
    rows = rows.withColumns({k: pick("__terms", "severity", k, "term") for k in ("high", "medium")} | {"extra": F.array_sort(pick("matches", "status", "extra", "skill"))})
    near = F.array_sort(F.transform(F.filter("matches", lambda x: (x["status"] == "partial") & (x["similarity"] < 0.98)), lambda x: F.struct((-x["similarity"]).alias("less"), F.concat(F.lit("'"), x["other"], F.lit("' -> '"), x["skill"], F.lit("'")).alias("said"))))
    experience, education = SC.gap_texts()
    overall = SC.dimensions()
    rows = rows.withColumns({
        "weak": F.transform("weak", lambda w: F.struct(w["section"].alias("section"), w["score"].alias("score"))),
        "n_extra": F.col("metrics.extra"), "n_matched": F.col("metrics.matched"), "experience_gap": experience, "education_gap": education, "has_summary": F.array_contains("detected", "summary"),
        "partial": F.transform(near, lambda x: x["said"]), "scanned": F.lit(False), **overall,
    })
    # scores rest on all keywords, advice on those that aren't noise; without keywords there is none
    return rows.withColumn("coverage", F.when(F.size("compared") > 0, F.coalesce(CP.covered(F.col("compared"), 25, F.col("__noise"))["coverage"], F.lit(0.0))))


@query(None, _advised)
def pair_recommendations(rows):
    return AD.recommendations(rows)
