"""Column expressions over text; all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://[^\s<>()]+"
PHONE = r"[+]?[0-9][0-9 ().-]{5,}[0-9]"
TOKEN = r"[\p{L}\p{N}]+"
SPACED = r"[^\x20\x09-\x0D]+"

#: Typographic signs and what stands for them in plain text.
TYPOGRAPHIC = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "•": "-", "\u00a0": " "}
#: Words that titles keep small.
SMALL_WORDS = "a an and at by for in of on or the to with".split()
#: Sums of money, shares, and numbers of something.
QUANTITY = r"[$€£] ?[0-9][0-9.,]*|[0-9]+(?:\.[0-9]+)? ?%|[0-9]+[+]? (?:years|months|days|users|times)"


def collapsed(text: Column) -> Column:
    """Without control characters; runs of blanks are one blank, three newlines or more are two, lines are trimmed."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"[ \t\r]+", " "), r"\n{3,}", "\n\n")
    return F.trim(F.array_join(F.transform(F.split(clean, "\n"), lambda x: F.trim(x)), "\n"))


def plain(text: Column) -> Column:
    """Latin letters without accents, typographic signs as ASCII; other characters stay."""
    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0xC0, 0x180))}
    bare = {c: d[0] for c, d in parts.items() if len(d) > 1 and d[0].isascii()} | TYPOGRAPHIC
    return F.translate(text, "".join(bare), "".join(bare.values()))


def repaired(text: Column) -> Column:
    """Words broken at line ends joined, no blanks before marks, zeros within words as o."""
    joined = F.regexp_replace(text, r"(\p{Ll})-\n(\p{Ll})", "$1$2")
    return F.regexp_replace(F.regexp_replace(joined, r" +([,.;:!?])", "$1"), r"(\p{Ll})0(\p{Ll})", "$1o$2")


def cleaned(text: Column) -> Column:
    """All cleaning steps: plain letters, repaired words, signs other than usual punctuation as blanks, blanks collapsed."""
    return collapsed(F.regexp_replace(repaired(plain(text)), r"[^\p{L}\p{N}\x20\x09-\x0D.,;:!?'\"()@%$+#/&_-]", " "))


def titled(text: Column, acronyms: dict[str, str] | None = None) -> Column:
    """Words with a first capital but for small ones behind the first; words with capitals inside stay as they are; ß has no capital.

    acronyms maps lower-case words to how they are written; they go before all other rules.
    """
    words = F.split(text, " ")
    big = lambda w: F.when(w.startswith("ß"), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    usual = lambda w, i: F.when(w.rlike(r"^.+\p{Lu}"), w).when((i > 0) & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(big(w))
    if not acronyms:
        return F.array_join(F.transform(words, usual), " ")
    known = F.create_map(*[F.lit(x) for kv in acronyms.items() for x in kv])
    return F.array_join(F.transform(words, lambda w, i: F.coalesce(F.try_element_at(known, F.lower(w)), usual(w, i))), " ")


def lemma(word: Column) -> Column:
    """A lower-case word without endings of number and tense."""
    w = F.lower(word)
    rules = ((r"^.{2,}ies$", r"ies$", "y"), (r"^.{4,}ing$", r"ing$", ""), (r"^.{4,}ed$", r"ed$", ""), (r"^.{2,}[^su]s$", r"s$", ""))
    out = w
    for test, ending, new in reversed(rules):
        out = F.when(w.rlike(test), F.regexp_replace(w, ending, new)).otherwise(out)
    return out


def valid_term(term: Column) -> Column:
    """Whether a term may be shown: at most 48 characters and 5 words, with a letter, no code of digits."""
    return (F.char_length(term) <= 48) & term.rlike(r"\p{L}") & ~term.rlike(r"^[A-Za-z]?[0-9]+[a-z]?$") & (F.size(F.split(term, " ")) <= 5)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces of a line that end in a mark before blanks and a capital, a digit, a quotation mark or a parenthesis."""
    marked = F.regexp_replace(text, r"([.!?]) +([\p{Lu}0-9\"(])", "$1\n$2")
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def found(text: Column, pattern: str) -> Column:
    """Distinct matches in lower case, first seen first."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.lower(x)))


def without_tags(html: Column) -> Column:
    """Text of a page: scripts, styles and tags are blanks, blanks are single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def calibrated(x: Column, tau: float) -> Column:
    """1 - exp(-x / tau), within 0 and 1."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 1 - F.exp(-x / F.lit(tau))))


def rounded(x: Column, places: int) -> Column:
    """x to so many places, halves away from zero, after a binary multiplication, as DuckDB rounds. Spark's round goes by x as it is written, which tells 15.149999999999999 from a half."""
    return F.round(x * float(10**places)) / float(10**places)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")
