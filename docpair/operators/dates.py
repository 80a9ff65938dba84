"""Dates, periods and years in documents; requirements of years and degrees; education. Everything happens within a row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import held, let
from .sections import scope_of, with_sections

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: A month by its first three letters, whatever else of the name follows.
MONTH = f"(?:{'|'.join(m[:3] for m in MONTHS)})[a-z]*"
#: A year, perhaps with a month before it; two groups.
WHEN = rf"(?:\b({MONTH})\.?,?\s+)?\b((?:19|20)\d\d)"
OPEN = ["present", "today", "now", "current", "ongoing", "to date"]
#: Start month, start year, end month, end year, or a word for an open end.
PERIOD = rf"(?i){WHEN}\s*(?:[-–—]|\bto\b|\buntil\b)\s*(?:{WHEN}|({'|'.join(OPEN)}))"
MONTH_YEAR = rf"(?i)\b{MONTH}\.?,?\s+(?:19|20)\d\d"
YEAR_WORD = r"y(?:ea)?rs?\b"
YEARS = rf"(?i)(\d{{1,2}}(?:\.\d)?)\s*[+]?\s*{YEAR_WORD}"
ASKED_YEARS = rf"(?i)(?:at least |minimum of |more than |over )?(\d{{1,2}})(?:\s*(?:[-–]|to)\s*\d{{1,2}})?\s*[+]?\s*{YEAR_WORD}"
#: Wording beside a date that makes it one of studies.
STUDIES = (
    r"(?i)(?:\b(?:b\.?\s?s\.?c?\.?|m\.?\s?s\.?c?\.?|b\.?\s?a\.?|m\.?\s?a\.?)\b|\bb\.?tech\b|\bm\.?tech\b|\bm\.?b\.?a\b|\bmba\b|\bph\.?\s?d\.?\b|\bbachelor\w*\b"
    r"|\bmaster(?:'s|s)?\s+(?:degree|of|sc|science|arts)\b|\bdoctorat\w*\b|\bdoctor\s+of\b|\bassociate\s+degree\b|\bdiploma\b|\bgpa\b|\bhonou?rs\b|\bgraduat\w*\b|\bcoursework\b"
    r"|\bundergraduate\b|\bpost-?graduate\b|\bspeciali[sz]ation\s+in\b|\bclass\s+of\s+\d{4}\b|\b(?:conferred|awarded)\b)"
)
#: The same, but the wording is tried only where a word begins with one of its first letters, not at each character.
STUDIES_AT = STUDIES.replace("(?i)", r"(?i)(?=[abcdghmpsu])\b", 1)
#: Words that make a number of years one of work, and words that make a degree a wish.
ABOUT_YEARS = ["experience", "background", "practice", "working"]
ASKS = r"(?i)\b(?:degree|bachelor|master|doctorate|diploma|equivalent|graduate|preferred|required)"
#: Degrees as they are written, and fields of study; both may be given instead.
DEGREES = ["bachelor of science", "bachelor of arts", "bachelor of engineering", "bachelor's degree", "bachelor", "b.sc", "b.s.", "b.a.", "b.tech", "master of science", "master of arts", "master's degree", "master", "m.sc", "m.s.", "m.a.", "mba", "doctor of philosophy", "doctorate", "ph.d.", "phd", "associate degree", "high school"]
FIELDS = ["computer science", "software engineering", "electrical engineering", "mechanical engineering", "information systems", "data science", "mathematics", "statistics", "physics", "chemistry", "biology", "economics", "finance", "business administration", "psychology", "design"]
#: What shows a degree's level, the highest level first.
LEVELS = {
    "phd": ["phd", "ph.d", "doctorate", "doctoral", "dphil", "md ", "jd"],
    "master": ["master", "m.s", "msc", "m.sc", "mba", "m.eng", "mtech", "m.a", "postgraduate"],
    "bachelor": ["bachelor", "b.s", "bsc", "b.sc", "b.eng", "btech", "bba", "bca", "undergraduate"],
    "associate": ["associate", "diploma", "hnd", "hnc"],
    "certification": ["certif", "license", "accredit"],
    "high_school": ["high school", "secondary", "a-level", "ib diploma", "ged", "ssc", "hsc"],
}
#: Levels in rising order.
RANKS = ["high_school", "certification", "associate", "bachelor", "master", "phd"]
#: How abbreviated degrees are shown.
SHOWN = {"m.s.": "M.S.", "b.s.": "B.S.", "m.sc": "M.Sc.", "b.sc": "B.Sc.", "m.a.": "M.A.", "b.a.": "B.A.", "phd": "PhD", "ph.d.": "Ph.D.", "mba": "MBA", "b.tech": "B.Tech", "m.tech": "M.Tech"}


def _placed(pieces: Column, tail: int) -> Column:
    """Where each piece but the first begins, and what it is up to the end mark; pieces have an end mark of `tail` characters."""
    none = F.array().cast("array<struct<at:int,match:string>>")
    begin = F.struct(F.char_length(pieces[0]).alias("at"), none.alias("out"))
    step = lambda s, p: F.struct((s["at"] + F.char_length(p) - tail).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), F.substring_index(p, "\x02", 1).alias("match")))).alias("out"))
    return F.aggregate(F.slice(pieces, 2, 1 << 30), begin, step, lambda s: s["out"])


def places(text: Column, pattern: str) -> Column:
    """An array of at (from 0) and match, for each match of the pattern. The text must not hold the characters 1 and 2."""
    return _placed(F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x02"), "\x01"), 1)


def literal_places(text: Column, needle: Column) -> Column:
    """Where each occurrence of a string begins."""
    return F.transform(_placed(F.split(F.replace(text, needle, F.concat(F.lit("\x01"), needle)), "\x01"), 0), lambda p: p["at"])


def around(text: Column, at: Column, before: int, after: Column | int) -> Column:
    """The text from so many characters before a place to so many behind it."""
    start = F.greatest(at - before, F.lit(0))
    return F.substring(text, start + 1, at + after - start)


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dates(docs: DataFrame, most: int = 40) -> DataFrame:
    """doc_id, dates: periods as they are written, then months with years, each once without regard to case; at most so many."""
    all_of = lambda p: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), single_spaced)
    lists = docs.where("text is not null").select("doc_id", F.concat(all_of(PERIOD), all_of(MONTH_YEAR)).alias("d"))
    first = F.filter("d", lambda x, i: F.array_position(F.transform("d", lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return lists.select("doc_id", F.slice(first, 1, most).alias("dates"))


def _first_day(month: Column, year: Column) -> Column:
    number = F.when(month == "", 1).otherwise(((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(month, 1, 3))) + 2) / 3).cast("int"))
    return F.make_date(year.cast("int"), number, F.lit(1))


def periods(docs: DataFrame, today: str, without: str | None = None) -> DataFrame:
    """docs with the column periods: an array of start and end (dates) in the order of the text, null for null texts.

    Months without a name are January; an open end is today. A period that ends before it starts is turned round; one of
    more than 40 years is left out. So is one beside wording of studies, and one within the text in the column `without`
    (if that has 40 characters or more; where it isn't found as it stands, within its lines of more than 12 characters).
    """
    text, w = F.col("text"), F.col("__w")
    rows = docs.withColumn("__w", F.trim(F.col(without)) if without else F.lit(None).cast("string"))
    whole = F.transform(literal_places(text, w), lambda a: F.struct(a.alias("s"), (a + F.char_length(w)).alias("e")))
    lines = F.filter(F.transform(F.split(w, "\n"), lambda x: F.trim(x)), lambda x: (F.char_length(x) > 12) & F.contains(text, x))
    by_line = F.transform(lines, lambda x: F.struct((F.call_function("locate", x, text) - 1).alias("s"), (F.call_function("locate", x, text) - 1 + F.char_length(x)).alias("e")))
    rows = rows.withColumn("__spans", held(F.when(F.char_length(w) < 40, None).when(F.contains(text, w), whole).otherwise(by_line)))
    own = F.filter(places(text, PERIOD), lambda p: ~F.coalesce(F.exists("__spans", lambda s: (s["s"] <= p["at"]) & (p["at"] < s["e"])), F.lit(False)) & ~around(text, p["at"], 140, 140).rlike(STUDIES_AT))
    part = lambda p, k: F.regexp_extract(p["match"], PERIOD, k)
    made = F.transform(own, lambda p: F.struct(_first_day(part(p, 1), part(p, 2)).alias("a"), F.when(part(p, 5) != "", F.lit(today).cast("date")).otherwise(_first_day(part(p, 3), F.nullif(part(p, 4), F.lit("")))).alias("b")))
    turned = F.transform(made, lambda p: F.struct(F.least(p["a"], p["b"]).alias("start"), F.greatest(p["a"], p["b"]).alias("end")))
    return rows.withColumn("periods", F.filter(turned, lambda p: F.year(p["end"]) - F.year(p["start"]) <= 40)).drop("__w", "__spans")


def months_of(periods: Column) -> Column:
    """Inclusive months of an array of periods, overlapping ones joined."""
    length = lambda a, b: F.when(a.isNull(), 0).otherwise((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) + 1)
    none = F.lit(None).cast("date")
    state = lambda start, end, n: F.struct(start.alias("start"), end.alias("end"), n.cast("int").alias("n"))
    step = lambda s, p: F.when(p["start"] <= s["end"], state(s["start"], F.greatest(s["end"], p["end"]), s["n"])).otherwise(state(p["start"], p["end"], s["n"] + length(s["start"], s["end"])))
    return F.aggregate(F.array_sort(periods), state(none, none, F.lit(0)), step, lambda s: s["n"] + length(s["start"], s["end"]))


def with_experience(docs: DataFrame, today: str) -> DataFrame:
    """docs with months, explicit and years: the greater of the months of all periods outside of the section education and the
    most years that the first 1,500 characters state; at most 60, to one place, null if 0. All are null or 0 for null texts."""
    education = F.get(F.filter("sections", lambda s: s["name"] == "education"), F.lit(0))["text"]
    rows = periods(with_sections(docs).withColumn("__education", education), today, "__education").drop("__education")
    stated = F.transform(F.regexp_extract_all(F.substring("text", 1, 1500), F.lit(YEARS), F.lit(1)), lambda x: x.cast("double"))
    rows = rows.withColumns({"months": held(months_of(F.col("periods")))}).withColumn("explicit", F.coalesce(F.array_max(stated), F.lit(0.0)))
    best = F.greatest(F.col("months") / 12.0, F.col("explicit"))
    return rows.withColumn("years", F.when(best > 0, F.round(F.least(best, F.lit(60.0)), 1)))


def years_of_experience(docs: DataFrame, today: str) -> DataFrame:
    """doc_id, months, explicit, years of with_experience(), without null texts."""
    return with_experience(docs.where("text is not null"), today).select("doc_id", "months", "explicit", "years")


def with_asked_years(docs: DataFrame) -> DataFrame:
    """docs with min_years and years_phrase: the most years of experience a posting asks for, up to 40, and how it is put."""
    rows = docs.withColumn("__found", held(places(F.col("text"), ASKED_YEARS)))
    meant = lambda p: let(F.lower(around(F.col("text"), p["at"], 120, F.char_length(p["match"]) + 120)), lambda a: F.exists(F.array(*map(F.lit, ABOUT_YEARS)), lambda w: F.contains(a, w)))
    numbers = F.filter(F.transform(F.filter("__found", meant), lambda p: F.regexp_extract(p["match"], ASKED_YEARS, 1).cast("int")), lambda n: n <= 40)
    rows = rows.withColumn("min_years", held(F.array_max(numbers).cast("double")))
    phrase = F.when(F.col("min_years").isNotNull(), F.concat(F.col("min_years").cast("int"), F.lit("+ years"))).otherwise(single_spaced(F.get("__found", F.lit(0))["match"]))
    return rows.withColumn("years_phrase", phrase).drop("__found")


def asked_years(docs: DataFrame) -> DataFrame:
    """doc_id, min_years, phrase of with_asked_years(), without null texts."""
    return with_asked_years(docs.where("text is not null")).select("doc_id", "min_years", F.col("years_phrase").alias("phrase"))


def _any_of(words: list[str], ignore_case: bool = True) -> str:
    """A pattern of these, longest first, that stand alone."""
    bare = [w.replace(".", r"\.").replace("+", r"\+") for w in sorted(words, key=lambda w: (-len(w), w))]
    return ("(?i)" if ignore_case else "") + rf"\b(?:{'|'.join(bare)})"


def _any_at(words: list[str]) -> str:
    """The same, but the words are tried only at their first letters; as it is if these are no plain letters."""
    heads = "".join(sorted({w[:1].lower() for w in words}))
    return _any_of(words).replace("(?i)", f"(?i)(?=[{heads}])", 1) if re.fullmatch("[a-z]+", heads) and all(words) else _any_of(words)


def level(text: Column) -> Column:
    """The level that wording shows, the highest first; certification if none does."""
    low = F.lower(text)
    out = F.lit("certification")
    for name, signs in reversed(LEVELS.items()):
        out = F.when(F.exists(F.array(*map(F.lit, signs)), lambda w: F.contains(low, w)), name).otherwise(out)
    return out


def rank(name: Column) -> Column:
    """0 for high school up to 5 for a doctorate; -1 for null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, RANKS)), name).cast("int") - 1, F.lit(-1))


def shown(degree: Column) -> Column:
    words = F.transform(F.split(F.lower(degree), " "), lambda w, i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv]), w), F.when((i > 0) & w.isin("in", "of", "and", "the"), w).otherwise(F.initcap(w))))
    return F.array_join(words, " ")


def with_degrees(docs: DataFrame, surfaces: list[str] = DEGREES, fields: list[str] = FIELDS, most: int = 12) -> DataFrame:
    """docs with degrees and level: degrees of the section education (of the whole text where there is none), each with its field
    of study if one stands within 160 characters behind "in" or right behind the degree. Degrees in lines of capitals
    don't count. Of degrees that begin alike (5 letters) the longest stays, in the place of the first. Null for null texts.
    """
    rows = with_sections(docs).withColumn("__scope", held(scope_of(F.col("text"), F.col("sections"), ["education"])))
    scope = F.col("__scope")
    line = lambda p: F.concat(F.element_at(F.split(F.substring(scope, F.lit(1), p["at"]), "\n"), -1), F.substring_index(F.substring(scope, p["at"] + 1, F.lit(1 << 30)), "\n", 1))
    letters = lambda x, kind: F.char_length(F.regexp_replace(x, rf"[^\p{{{kind}}}]", ""))
    calm = F.filter(places(scope, _any_at(surfaces)), lambda p: (letters(line(p), "L") < 4) | (10 * letters(line(p), "Lu") < 9 * letters(line(p), "L")))
    window = lambda p: F.substring(scope, p["at"] + 1, F.lit(160))
    behind = lambda p: F.substring(window(p), F.char_length(p["match"]) + 1, F.lit(160))
    field = lambda p: F.coalesce(*[F.when(window(p).rlike(rf"(?i)\bin\s+{f}") | behind(p).rlike(rf"(?i)^\s*[,(-]?\s*{f}"), F.initcap(F.lit(f))) for f in fields])
    rows = rows.withColumn("__d", held(F.transform(calm, lambda p: F.concat_ws(" in ", shown(p["match"]), field(p)))))
    key = lambda x: F.substring(F.regexp_replace(F.lower(F.substring_index(x, " in ", 1)), "[^a-z0-9]", ""), 1, 5)
    alike = lambda x: F.filter("__d", lambda y: key(y) == key(x))
    longest = lambda x: F.aggregate(alike(x), F.lit(""), lambda a, b: F.when(F.char_length(b) > F.char_length(a), b).otherwise(a))
    rows = rows.withColumn("degrees", held(F.slice(F.array_distinct(F.transform("__d", longest)), 1, most)))
    highest = F.array_max(F.transform("degrees", lambda x: rank(level(x))))
    return rows.withColumn("level", F.when(F.size("degrees") > 0, F.element_at(F.array(*map(F.lit, RANKS)), F.greatest(highest, F.lit(0)) + 1))).drop("__scope", "__d")


def degrees(docs: DataFrame, surfaces: list[str] = DEGREES, fields: list[str] = FIELDS, most: int = 12) -> DataFrame:
    """doc_id, degrees, level of with_degrees(), without null texts."""
    return with_degrees(docs.where("text is not null"), surfaces, fields, most).select("doc_id", "degrees", "level")


def with_asked_degree(docs: DataFrame, surfaces: list[str] = DEGREES) -> DataFrame:
    """docs with degree_phrase: the sentence or line in which a posting asks for a degree, at most 220 characters. One that says
    required, minimum or must goes first, then the first. Null where no degree stands near such wording."""
    text = F.col("text")
    asked = F.filter(places(text, _any_at(surfaces)), lambda p: around(text, p["at"], 90, F.char_length(p["match"]) + 90).rlike(ASKS))
    before = lambda p: F.substring_index(F.translate(F.substring("text", F.lit(1), p["at"]), "\n", "."), ".", -1)
    after = lambda p: F.regexp_extract(F.substring("text", p["at"] + 1, F.lit(1 << 30)), r"^(?s:.)[^.\n]*\.?", 0)
    sentence = lambda p: F.substring(F.regexp_replace(single_spaced(F.concat(before(p), after(p))), r"^[ \-•:|]+|[ \-•:|]+$", ""), 1, 220)
    rows = docs.withColumn("__s", held(F.transform(asked, sentence)))
    first = F.coalesce(F.get(F.filter("__s", lambda x: x.rlike(r"(?i)\b(required|minimum|must)\b")), F.lit(0)), F.get("__s", F.lit(0)))
    return rows.withColumn("degree_phrase", first).drop("__s")


def asked_degree(docs: DataFrame, surfaces: list[str] = DEGREES) -> DataFrame:
    """doc_id, phrase of with_asked_degree(), without null texts."""
    return with_asked_degree(docs.where("text is not null"), surfaces).select("doc_id", F.col("degree_phrase").alias("phrase"))
