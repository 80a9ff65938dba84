"""Texts in their plain forms: compatibility forms, scan repairs, contacts taken out, signs taken out; and all of it in order."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import held, let
from .text import EMAIL, sentences

#: Typographic signs and what stands for them.
SIGNS = {
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", " ": " ", "•": "*", "●": "*", "▪": "*", "": "*", "": "*",
    "​": "", "‌": "", "‍": "", "﻿": "", " ": "\n", " ": "\n", "­": "",
}
#: From this share of ASCII characters on, other characters are dropped.
MOSTLY = 0.95
#: Last labels of addresses without a scheme.
LAST_LABELS = ["com", "io", "dev", "me", "ai", "xyz", "tech", "org", "net", "co"]
#: An address on the web with its scheme or www; one without, by its last label; a telephone number of 8 to 15 digits.
ADDRESS = r"(?i)\b(?:https?://|www\.)[^\s<>\"{}|^`\\]+"
DOMAIN = rf"(?i)\b[a-z0-9][a-z0-9-]{{1,40}}\.(?:{'|'.join(LAST_LABELS)})\b(?:/[\w./?%&=+#~-]*)?"
NUMBER = r"[+]?[(]?\b[0-9](?:[ .()-]{0,2}[0-9]){7,14}\b"
#: What is neither a letter, digit, blank nor usual sign.
NOISE = r"[^\p{L}\p{M}\p{N}_\s.,;:!?'\"()\[\]/&+@#%–—-]"
#: Repairs of scanned texts, in order. A replacement may hold groups, $1 and so on.
REPAIRS = [
    (r"\|\s*", " "), ("[‘’′`]", "'"), ("[“”″]", '"'), ("[–—]", "-"), (r"\b0O\b", "OO"), (r"\brn\b", "m"), (r"\bcl\b", "d"), (r"\bvvh\b", "w"), (r"\btl\b", "h"),
    ("([a-z])0(?=[a-z])", "$1o"), ("([a-z])1(?=[a-z])", "$1l"), ("([a-z])5(?=[a-z])", "$1s"), ("([a-z])8(?=[a-z])", "$1b"), (r"\s+([,.;:!?])", "$1"), ("([,;:])(?=[A-Za-z])", "$1 "),
]


def written_form(c: str) -> str:
    """A character's compatibility form, signs written plainly."""
    return "".join(SIGNS.get(x, x) for x in unicodedata.normalize("NFKC", c))


def plain_form(c: str) -> str:
    """The same without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", written_form(c)) if not unicodedata.combining(x))


@cache
def ascii_signs() -> str:
    """Characters beyond ASCII whose written form is within it."""
    return "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if written_form(c).isascii())


@cache
def tables() -> list[tuple[str, str]]:
    """For each place of a plain form the characters that have one there, and what it is: (matching, replacing) as translate() takes them.

    In the first table, characters whose form is empty come last, so that they are dropped. Characters that are their own
    form are in none.
    """
    forms = {c: f for c in map(chr, range(128, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and (f := plain_form(c)) != c}
    longest = max(map(len, forms.values()))
    gone = "".join(c for c, f in forms.items() if not f)
    out = []
    for at in range(longest):
        here = {c: f[at] for c, f in forms.items() if len(f) > at}
        out.append(("".join(here) + (gone if at == 0 else ""), "".join(here.values())))
    return out


def ranges(characters: str) -> str:
    """The inside of a character class, as ranges of code points."""
    points = sorted(map(ord, characters))
    starts = [p for k, p in enumerate(points) if k == 0 or points[k - 1] != p - 1]
    ends = [p for k, p in enumerate(points) if k == len(points) - 1 or points[k + 1] != p + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


def compatible(text: Column) -> Column:
    """A text's characters in their plain forms. Where at least MOSTLY of the characters are ASCII as written (accents are not),
    those whose plain form isn't are dropped. Null stays null.

    translate() looks at each character, so it gets runs beyond ASCII only: of characters whose form has one character or none. Those
    whose forms have more, such as ligatures and syllables, are looked at one by one: table after table, or, for the few of
    more than four, in a map. All tables are made by rule, from the character database.
    """
    first, *more = tables()
    several = ranges(more[0][0])
    long_ = {c: plain_form(c) for c in more[3][0]}
    whole = F.create_map(*[F.lit(x) for kv in long_.items() for x in kv])
    next_ = lambda c, table: let(F.translate(c, *table), lambda x: F.when(x != c, x).otherwise(""))
    one = lambda c: F.coalesce(F.try_element_at(whole, c), F.concat(F.translate(c, *first), *[next_(c, t) for t in more[:3]]))
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x00-\x7F]+|[{several}]|[^\x00-\x7F{several}]+"), F.lit(0))
    plain_piece = lambda p: F.when(p.rlike(r"^[\x00-\x7F]"), p).when(p.rlike(f"^[{several}]"), one(p)).otherwise(F.translate(p, *first))
    formed = F.array_join(F.transform(pieces, plain_piece), "")
    others = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    beyond = F.char_length(F.translate(others, ascii_signs(), ""))
    mostly = beyond <= (1 - MOSTLY) * F.char_length(text) + 1e-9
    of_all = let(formed, lambda t: F.when(mostly, F.regexp_replace(t, r"[^\x00-\x7F]+", "")).otherwise(t))
    return F.when(text.rlike(r"[^\x00-\x7F]"), of_all).otherwise(text)


def repaired_scan(text: Column, repairs: list[tuple[str, str]] = REPAIRS) -> Column:
    """All repairs, one after the other."""
    for pattern, new in repairs:
        text = F.regexp_replace(text, pattern, new)
    return text


def contacts_of(text: Column) -> Column:
    """A struct of text, emails, urls and phones: mail addresses, then web addresses, then bare domains, then telephone numbers, each
    blanked before the next are looked for, so that none is found within another. Each list has every entry once, first seen
    first; addresses are in lower case and without closing marks."""
    all_of = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    bare = lambda x, marks: F.lower(F.rtrim(x, F.lit(marks)))
    once = lambda xs: F.array_distinct(xs)
    blank = lambda t, p: F.regexp_replace(t, p, " ")
    mails = lambda t: once(F.transform(all_of(t, EMAIL), lambda x: bare(x, ".,;:")))
    webs = lambda t, u: once(F.transform(F.concat(all_of(t, ADDRESS), all_of(u, DOMAIN)), lambda x: bare(x, ".,;:)")))
    phones = lambda t: once(F.transform(all_of(t, NUMBER), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))
    after_domains = lambda t, u: let(blank(u, DOMAIN), lambda v: F.struct(blank(v, NUMBER).alias("text"), webs(t, u).alias("urls"), phones(v).alias("phones")))
    after_mails = let(blank(text, EMAIL), lambda t: let(blank(t, ADDRESS), lambda u: after_domains(t, u)))
    return let(after_mails, lambda s: F.struct(s["text"].alias("text"), mails(text).alias("emails"), s["urls"].alias("urls"), s["phones"].alias("phones")))


def without_noise(text: Column) -> Column:
    """Characters that are neither letters, digits, blanks nor usual signs become blanks. Tokens such as c++ or ci/cd hold usual signs only and stay."""
    return F.regexp_replace(text, NOISE, " ")


def spaced_out(text: Column) -> Column:
    """Runs of blanks single, at most two newlines in a row, lines and text trimmed."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0b]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(flat, " *\n *", "\n"), r"^[ \n]+|[ \n]+$", "")


def cleaned_documents(docs: DataFrame, scanned: bool = True) -> DataFrame:
    """docs with text cleaned, and emails, urls, phones, sentences and lines (arrays), n_words and n_chars.

    Control characters go, characters take their plain forms, scans are repaired, contacts are taken out, noise becomes blanks,
    blanks are collapsed; then sentences and lines are split. Null and blank texts become empty, with empty lists.
    """
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    rows = docs.withColumn("__c", held(bare)).withColumn("__c", held(compatible(F.col("__c"))))  # each step is made once, whatever reads it
    if scanned:
        rows = rows.withColumn("__c", held(repaired_scan(F.col("__c"))))
    rows = rows.withColumn("__c", held(contacts_of(F.col("__c"))))
    rows = rows.withColumn("text", held(spaced_out(without_noise(F.col("__c.text"))))).withColumns({c: F.col(f"__c.{c}") for c in ("emails", "urls", "phones")}).drop("__c")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumns({"sentences": sentences(F.col("text")), "lines": lines, "n_words": F.regexp_count("text", F.lit(r"\S+")), "n_chars": F.char_length("text")})
