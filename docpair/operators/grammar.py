"""Words in sentences: classes with context, lemmas by class, and the relation of each word to its sentence's root.

There are two forms. With a row for each sentence and its words as an array (sentence_rows), all is made in that row: no word is
shuffled or sorted, and lexicon and forms are lists. With a row for each word, lexicon and forms are tables
(word, tag) and (form, lemma) of any size, joined, and a sentence is the unit of all windows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.counts import bounded_batches
from ..functions.rows import held
from ..functions.text import sentences

#: A word with its inner hyphens and apostrophes, or a single sign.
WORD = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
#: Words whose class their form doesn't show.
LEXICON = {
    "DET": ["a", "all", "an", "any", "each", "every", "its", "my", "no", "our", "some", "such", "that", "the", "their", "these", "this", "those", "your"],
    "PRON": ["he", "her", "him", "i", "it", "me", "she", "them", "they", "us", "we", "who", "you"],
    "AUX": ["am", "are", "be", "been", "can", "could", "did", "do", "does", "had", "has", "have", "is", "may", "might", "must", "shall", "should", "was", "were", "will", "would"],
    "ADP": ["about", "after", "as", "at", "before", "between", "by", "during", "for", "from", "in", "into", "of", "on", "over", "per", "through", "to", "under", "until", "via", "with", "within", "without"],
    "CCONJ": ["and", "but", "nor", "or"],
    "ADV": ["again", "also", "always", "here", "never", "not", "now", "often", "only", "there", "very", "well"],
    "ADJ": ["best", "big", "clear", "good", "great", "high", "large", "long", "low", "new", "old", "own", "short", "small", "strong"],
    "VERB": ["ask", "build", "built", "call", "design", "find", "found", "give", "help", "keep", "lead", "led", "look", "made", "make", "need", "plan", "run", "said", "sell", "show", "take", "test", "use", "want", "went", "work", "write", "wrote"],
    "NOUN": ["change", "end", "group", "part", "point", "program", "team", "time", "week", "year"],
}
#: Words behind which a noun is used as a verb. (A verb behind a DET of the lexicon is used as a noun.)
BEFORE_VERBS = ["can", "could", "help", "may", "might", "must", "need", "shall", "should", "to", "want", "will", "would"]
#: Endings that show a class, with the least number of letters before them.
ENDINGS = {
    "VERB": [("ify", 2), ("ing", 3), ("ise", 3), ("ize", 3), ("ed", 3)],
    "NOUN": [("ment", 3), ("ness", 3), ("ship", 3), ("tion", 2), ("sion", 2), ("ance", 3), ("ence", 3), ("ity", 3), ("ist", 3), ("er", 3), ("or", 3)],
    "ADJ": [("able", 2), ("ible", 2), ("ical", 3), ("less", 3), ("ful", 3), ("ous", 3), ("ive", 3), ("al", 4)],
    "ADV": [("ly", 3)],
}
#: Forms that no rule leads back.
IRREGULAR = {
    "be": ["am", "are", "been", "is", "was", "were"], "build": ["built"], "child": ["children"], "do": ["did", "does", "done"], "find": ["found"], "give": ["gave", "given"], "go": ["goes", "gone", "went"],
    "good": ["best", "better"], "have": ["had", "has"], "keep": ["kept"], "lead": ["led"], "make": ["made", "making"], "man": ["men"], "person": ["people"], "run": ["ran", "running"], "sell": ["sold"],
    "show": ["shown"], "take": ["taken", "took"], "use": ["used", "using"], "woman": ["women"], "write": ["written", "wrote"],
}
NOMINAL = ["NOUN", "PROPN", "PRON"]
#: Words whose facts a task keeps.
REMEMBERED = 1 << 17


def _first(lists: dict[str, list[str]]) -> dict[str, str]:
    """The first name under which each entry is listed."""
    known: dict[str, str] = {}
    for name, entries in lists.items():
        for entry in entries:
            known.setdefault(entry, name)
    return known


def lexicon(spark: SparkSession, classes: dict[str, list[str]] | None = None) -> DataFrame:
    """word, tag. A word of several classes has the first."""
    known = _first({tag: [w.lower() for w in words] for tag, words in (classes or LEXICON).items()})
    return spark.createDataFrame(list(known.items()), "word string, tag string")


def irregular(spark: SparkSession, forms: dict[str, list[str]] | None = None) -> DataFrame:
    """form, lemma; a form of several lemmas has the first."""
    return spark.createDataFrame(list(_first(forms or IRREGULAR).items()), "form string, lemma string")


def words(docs: DataFrame) -> DataFrame:
    """doc_id, sent, pos, word: a row for each word or sign of each sentence, both counted from 0; null and blank texts have none."""
    each = docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sent", "__s"))
    return each.select("doc_id", "sent", F.posexplode(F.regexp_extract_all("__s", F.lit(WORD), F.lit(0))).alias("pos", "word"))


def by_ending(low: Column) -> Column:
    """The class that a word's longest known ending shows, or null."""
    rules = sorted(((e, n, tag) for tag, endings in ENDINGS.items() for e, n in endings), key=lambda r: (-len(r[0]), r[0]))
    first, *more = [(low.endswith(e) & (F.char_length(low) >= len(e) + n), tag) for e, n, tag in rules]
    out = F.when(*first)
    for rule in more:
        out = out.when(*rule)
    return out


def by_shape(word: Column, low: Column, pos: Column) -> Column:
    """The class of a word that no lexicon knows: signs, numbers, names by their capitals, endings (of the last part of a compound), else a noun."""
    ending, tail = by_ending(low), by_ending(F.substring_index(low, "-", -1))
    name = (pos > 0) & word.rlike(r"^\p{Lu}")
    return (
        F.when(~word.rlike(r"[\p{L}\p{N}]"), "PUNCT").when(word.rlike(r"^\p{N}"), "NUM").when(word.rlike(r"^\p{Lu}[\p{Lu}\p{N}-]+$"), "PROPN")
        .when(name, F.when(F.char_length(low) > 6, F.coalesce(ending, F.lit("PROPN"))).otherwise("PROPN"))
        .otherwise(F.coalesce(ending, F.when(low.contains("-"), F.coalesce(tail, F.lit("ADJ"))), F.lit("NOUN")))
    )


def with_tags(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words with tag, in two passes: the lexicon's class, or what the shape shows; then the word before it overrides a noun or verb
    that the lexicon gave."""
    low = F.lower("word")
    known = lexicon.select(F.lower("word").alias("__low"), F.col("tag").alias("__known")).groupBy("__low").agg(F.min("__known").alias("__known"))
    first = words.withColumn("__low", low).join(known, "__low", "left")
    before = F.lag(F.struct("__low", "__known")).over(Window.partitionBy("doc_id", "sent").orderBy("pos"))
    second = first.withColumn("__before", before)
    tag = (
        F.when(F.col("__known").isNull(), by_shape(F.col("word"), F.col("__low"), F.col("pos"))).when((F.col("__known") == "VERB") & (F.col("__before.__known") == "DET"), "NOUN")
        .when((F.col("__known") == "NOUN") & F.col("__before.__low").isin(BEFORE_VERBS), "VERB").otherwise(F.col("__known"))
    )
    return second.withColumn("tag", tag).drop("__low", "__known", "__before")


def undoubled(stem: Column) -> Column:
    """Without the second of two equal consonants at the end."""
    last, other = F.substring(stem, -1, 1), F.substring(stem, F.char_length(stem) - 1, F.lit(1))
    return F.when((F.char_length(stem) > 1) & (last == other) & ~last.isin(*"aeiou"), F.substring(stem, F.lit(1), F.char_length(stem) - 1)).otherwise(stem)


def by_rule(low: Column, tag: Column) -> Column:
    """The lemma of a regular form by its class."""
    less = lambda n: F.substring(low, F.lit(1), F.char_length(low) - n)
    size = F.char_length(low)
    noun = (
        F.when((size <= 3) | ~low.endswith("s") | low.rlike("(ss|us|is|as|os)$"), low).when(low.endswith("ies") & (size > 4), F.concat(less(3), F.lit("y")))
        .when(low.rlike("(ch|sh|x|z|ss)es$"), less(2)).otherwise(less(1))
    )
    cut = lambda n: F.when(F.char_length(undoubled(less(n))) >= 3, undoubled(less(n))).otherwise(F.concat(less(n), F.lit("e")))
    verb = F.when(low.endswith("ied") & (size > 4), F.concat(less(3), F.lit("y"))).when(low.endswith("ing") & (size > 5), cut(3)).when(low.endswith("ed") & (size > 4), cut(2)).otherwise(noun)
    adjective = F.when(low.endswith("er") & (size > 5), undoubled(less(2))).when(low.endswith("est") & (size > 5), undoubled(less(3))).otherwise(low)
    return F.when(tag.isin("NOUN", "PROPN"), noun).when(tag == "VERB", verb).when(tag == "ADJ", adjective).otherwise(low)


def with_lemmas(tagged: DataFrame, irregular: DataFrame) -> DataFrame:
    """tagged words with lemma: of an irregular form by the table, else by the rules of its class; words of capitals stay as they are."""
    known = irregular.select(F.lower("form").alias("__low"), F.col("lemma").alias("__lemma")).groupBy("__low").agg(F.min("__lemma").alias("__lemma"))
    rows = tagged.withColumn("__low", F.lower("word")).join(known, "__low", "left")
    capitals = F.col("word").rlike(r"^\p{Lu}[\p{Lu}\p{N}-]+$")
    return rows.withColumn("lemma", F.when(capitals, F.col("word")).otherwise(F.coalesce("__lemma", by_rule(F.col("__low"), F.col("tag"))))).drop("__low", "__lemma")


def with_relations(tagged: DataFrame) -> DataFrame:
    """tagged words with dep and head (the place of another word of the sentence; a root is its own).

    The root is the first verb that is no -ing form, else the first verb, else the first nominal, adjective or number, else
    the first word. Before it, the first nominal is its subject, later nouns are compounds of the word before the root.
    Behind it, nominals are objects of the last preposition that no adjective has closed since, else of the root.
    Determiners, adjectives and numbers belong to the next noun within three words, else to the root; all else to the root.
    """
    sentence = Window.partitionBy("doc_id", "sent")
    in_order = sentence.orderBy("pos")
    pos, tag, low = F.col("pos"), F.col("tag"), F.lower("word")
    first = lambda test: F.min(F.when(test, pos)).over(sentence)
    root = F.coalesce(first((tag == "VERB") & ~low.endswith("ing")), first(tag == "VERB"), first(tag.isin(*NOMINAL, "ADJ", "NUM")), F.lit(0))
    rows = tagged.withColumn("__root", root)
    ahead, behind = pos < F.col("__root"), pos > F.col("__root")
    preposition = (tag == "ADP") & ~low.isin("not", "n't")
    event = F.when(behind & preposition, pos).when(behind & (tag == "ADJ"), -1)
    rows = rows.withColumns({
        "__noun": F.min(F.when(tag.isin("NOUN", "PROPN"), pos)).over(in_order.rowsBetween(1, 3)),
        "__open": F.nullif(F.last(event, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)),
        "__subject": F.min(F.when(ahead & tag.isin(NOMINAL) & ~low.isin("not", "n't"), pos)).over(sentence),
    })
    r, o = F.col("__root"), F.col("__open")
    nominal, noun, modifier = tag.isin(NOMINAL), tag.isin("NOUN", "PROPN"), tag.isin("DET", "ADJ", "NUM")
    at = lambda dep, head: F.struct(F.lit(dep).alias("dep"), head.cast("int").alias("head"))
    modified = lambda name: at(name, F.coalesce("__noun", r))
    relation = (
        F.when(pos == r, at("ROOT", r)).when(tag == "PUNCT", at("punct", r)).when(tag == "AUX", at("aux", r)).when(low.isin("not", "n't"), at("neg", r))
        .when(ahead & nominal & (pos == F.col("__subject")), at("nsubj", r)).when(ahead & noun, at("compound", r - 1)).when(tag == "DET", modified("det"))
        .when(modifier & (ahead | (tag == "ADJ")), modified("amod")).when(tag == "NUM", modified("nummod")).when(tag == "ADP", at("prep", r)).when(behind & (tag == "CCONJ"), at("cc", r))
        .when(behind & nominal & o.isNotNull(), at("pobj", o)).when(behind & nominal, at("dobj", r)).when(tag == "ADV", at("advmod", r))
        .when(ahead & (tag == "VERB"), at("advcl", r)).when((tag == "VERB") & o.isNull(), at("conj", r)).when(tag == "VERB", at("pcomp", r)).otherwise(at("dep", r))
    )
    rows = rows.withColumn("__rel", relation)
    return rows.withColumns({"dep": F.col("__rel.dep"), "head": F.col("__rel.head")}).drop("__root", "__noun", "__open", "__subject", "__rel")


def sentence_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in keep, sent, words (array): a row for each sentence; null and blank texts have none."""
    each = docs.select("doc_id", *keep, F.posexplode(sentences(F.col("text"))).alias("sent", "__s"))
    return each.select("doc_id", *keep, "sent", held(F.regexp_extract_all("__s", F.lit(WORD), F.lit(0))).alias("words"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The entries of an array of lists as numbers, what they stand for, and where each list begins, with the end."""
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), offsets - offsets[0]


def _listed(numbers: np.ndarray, names: list[str], offsets: np.ndarray) -> pa.Array:
    """Lists of strings by their numbers."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()).take(pa.array(numbers)))


def _kind(c: str) -> str:
    return unicodedata.category(c)


def _capitals(word: str) -> bool:
    return len(word) > 1 and _kind(word[0]) == "Lu" and all(c == "-" or _kind(c) == "Lu" or _kind(c)[0] == "N" for c in word)


def _ending_of(low: str) -> str | None:
    """by_ending() of a string."""
    size = len(low)
    return next((tag for n in (4, 3, 2) if (rule := _RULES.get(low[-n:])) and size >= n + rule[0] for tag in rule[1:]), None)


_RULES = {e: (n, tag) for tag, endings in ENDINGS.items() for e, n in endings}


def shape_of(word: str, inner: bool) -> str:
    """by_shape() of a string, inner for one behind the first of its sentence."""
    low = word.lower()
    if word.isascii() and word.isalpha() and word == low:
        return _ending_of(low) or "NOUN"
    if not any(_kind(c)[0] in "LN" for c in word):
        return "PUNCT"
    if _kind(word[0])[0] == "N":
        return "NUM"
    if _capitals(word):
        return "PROPN"
    if inner and _kind(word[0]) == "Lu":
        return _ending_of(low) or "PROPN" if len(low) > 6 else "PROPN"
    return _ending_of(low) or (_ending_of(low.rpartition("-")[2]) or "ADJ" if "-" in low else "NOUN")


def rule_of(low: str, tag: str) -> str:
    """by_rule() of a string."""
    size = len(low)
    bare = lambda stem: stem[:-1] if len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeiou" else stem
    cut = lambda n: stem if len(stem := bare(low[:-n])) >= 3 else low[:-n] + "e"
    if tag == "VERB":
        if low.endswith("ied") and size > 4:
            return low[:-3] + "y"
        if low.endswith("ing") and size > 5:
            return cut(3)
        if low.endswith("ed") and size > 4:
            return cut(2)
    if tag == "ADJ":
        return bare(low[:-2]) if low.endswith("er") and size > 5 else bare(low[:-3]) if low.endswith("est") and size > 5 else low
    if tag not in ("NOUN", "PROPN", "VERB") or size <= 3 or not low.endswith("s") or low.endswith(("ss", "us", "is", "as", "os")):
        return low
    return low[:-3] + "y" if low.endswith("ies") and size > 4 else low[:-2] if low.endswith(("ches", "shes", "xes", "zes", "sses")) else low[:-1]


def tagged_sentences(rows: DataFrame, classes: dict[str, list[str]] | None = None) -> DataFrame:
    """sentence_rows() with tags (array), by the rules of with_tags(); classes are those of lexicon(). Of a batch each distinct word is looked at once."""
    bounded_batches(rows.sparkSession)
    known = _first({tag: [w.lower() for w in words] for tag, words in (classes or LEXICON).items()})
    names = [*dict.fromkeys(["PUNCT", "NUM", "PROPN", "ADJ", "NOUN", "VERB", *ENDINGS, *known.values()])]
    number, before_verbs = {name: i for i, name in enumerate(names)}, frozenset(BEFORE_VERBS)

    def facts(word: str) -> tuple[int, int, int, bool, bool]:
        """The class at the start of a sentence, that behind it, the lexicon's or -1, and what the word does to the next."""
        low = word.lower()
        tag = known.get(low)
        first = tag or shape_of(word, False)
        inner = first if tag or word == low else shape_of(word, True)
        return number[first], number[inner], number[tag] if tag else -1, tag == "DET", low in before_verbs

    @F.arrow_udf("array<string>")
    def tagged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = lru_cache(REMEMBERED)(facts)
        for lists in parts:
            at, words, offsets = _flat(lists)
            table = np.array([of(w) for w in words], np.int8).reshape(-1, 5)[at]
            inner = np.ones(len(at) + 1, bool)
            inner[offsets] = False  # with an entry more, as empty lists may end the batch
            inner = inner[:-1]
            before = np.concatenate([table[:1], table[:-1]])
            tags = np.where(inner, table[:, 1], table[:, 0])
            tags = np.where(inner & (table[:, 2] == number["VERB"]) & (before[:, 3] > 0), number["NOUN"], tags)
            tags = np.where(inner & (table[:, 2] == number["NOUN"]) & (before[:, 4] > 0), number["VERB"], tags)
            yield _listed(tags, names, offsets)

    return rows.withColumn("tags", held(tagged("words")))


def lemmatized_sentences(rows: DataFrame, forms: dict[str, list[str]] | None = None) -> DataFrame:
    """tagged_sentences() with lemmas (array), by the rules of with_lemmas(); forms are those of irregular()."""
    bounded_batches(rows.sparkSession)
    known = _first({lemma: [f.lower() for f in listed] for lemma, listed in (forms or IRREGULAR).items()})

    def lemma_of(word: str, tag: str) -> str:
        low = word.lower()
        return word if _capitals(word) else known.get(low) or rule_of(low, tag)

    @F.arrow_udf("array<string>")
    def lemmas(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        of = lru_cache(REMEMBERED)(lemma_of)
        for words, tags in parts:
            (at, names, offsets), (kind, kinds, _) = _flat(words), _flat(tags)
            pairs, back = np.unique(at.astype(np.int64) * max(len(kinds), 1) + kind, return_inverse=True)
            yield _listed(back, [of(names[p // len(kinds)], kinds[p % len(kinds)]) for p in pairs.tolist()], offsets)

    return rows.withColumn("lemmas", held(lemmas("words", "tags")))


#: Classes that the relations tell apart, and the relations, both by number; a class of none of these is one more.
CLASSES = ["NOUN", "PROPN", "PRON", "VERB", "AUX", "DET", "ADJ", "NUM", "ADP", "ADV", "CCONJ", "PUNCT"]
RELATIONS = ["ROOT", "punct", "aux", "neg", "nsubj", "compound", "det", "amod", "nummod", "prep", "cc", "pobj", "dobj", "advmod", "advcl", "conj", "pcomp", "dep"]
ING, NOT = 16, 32


def relations(kinds: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of relations, and heads, of the words of sentences that follow each other: kinds are numbers of classes, plus ING and NOT for
    such words; ends is where each sentence ends. The rules are those of with_relations(), for all sentences of a batch at once."""
    lengths = np.diff(ends, prepend=0)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    starts, at = np.cumsum(lengths) - lengths, np.arange(len(kinds))
    start, end = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)
    pos, far = at - start, len(kinds)
    tag, ing, neg = kinds & 15, (kinds & ING) > 0, (kinds & NOT) > 0
    is_ = {name: tag == i for i, name in enumerate(CLASSES)}
    noun, verb = is_["NOUN"] | is_["PROPN"], is_["VERB"]
    nominal = noun | is_["PRON"]
    each = lambda least: np.repeat(np.minimum.reduceat(least, starts), lengths)
    choice = np.where(verb, np.where(ing, 1, 0), np.where(nominal | is_["ADJ"] | is_["NUM"], 2, 3))
    root = each(choice * far + pos) % far
    subject = each(np.where(nominal & ~neg, pos, far))
    ahead, behind = pos < root, pos > root
    next_noun = root
    for step in (3, 2, 1):
        there = np.minimum(at + step, far - 1)
        next_noun = np.where((at + step < end) & noun[there], pos + step, next_noun)
    opens = behind & is_["ADP"] & ~neg
    last = np.maximum.accumulate(np.where(opens | (behind & is_["ADJ"]), at, -1))
    last = np.concatenate([[-1], last[:-1]])
    opened = (last >= start) & opens[last]
    rules = [
        (pos == root, "ROOT", root), (is_["PUNCT"], "punct", root), (is_["AUX"], "aux", root), (neg, "neg", root), (ahead & nominal & (pos == subject), "nsubj", root),
        (ahead & noun, "compound", root - 1), (is_["DET"], "det", next_noun), (is_["ADJ"] | (is_["NUM"] & ahead), "amod", next_noun), (is_["NUM"], "nummod", next_noun),
        (is_["ADP"], "prep", root), (behind & is_["CCONJ"], "cc", root), (behind & nominal & opened, "pobj", last - start), (behind & nominal, "dobj", root),
        (is_["ADV"], "advmod", root), (ahead & verb, "advcl", root), (verb & ~opened, "conj", root), (verb, "pcomp", root),
    ]
    tests = [test for test, _, _ in rules]
    return np.select(tests, [np.int32(RELATIONS.index(name)) for _, name, _ in rules], np.int32(RELATIONS.index("dep"))), np.select(tests, [head for _, _, head in rules], root).astype(np.int32)


def related_sentences(rows: DataFrame) -> DataFrame:
    """tagged_sentences() with relations (array of dep and head), by the rules of with_relations()."""
    bounded_batches(rows.sparkSession)
    number = {name: i for i, name in enumerate(CLASSES)}

    @F.arrow_udf("array<struct<dep:string,head:int>>")
    def related(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for words, tags in parts:
            (at, names, offsets), (kind, kinds, _) = _flat(words), _flat(tags)
            marks = np.array([(ING if low.endswith("ing") else 0) + (NOT if low in ("not", "n't") else 0) for low in map(str.lower, names)], np.int64)
            coded = np.array([number.get(tag, len(CLASSES)) for tag in kinds], np.int64)
            dep, head = relations(coded[kind] + marks[at], offsets[1:])
            fields = [pa.array(RELATIONS, pa.string()).take(pa.array(dep)), pa.array(head, pa.int32())]
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["dep", "head"]))

    return rows.withColumn("relations", held(related("words", "tags")))


def word_rows(rows: DataFrame) -> DataFrame:
    """A row for each word of rows of sentences: its place, word, and what has been made of it of tag, lemma, dep and head."""
    made = {"words": "word", "tags": "tag", "lemmas": "lemma", "relations": "relation"}
    there = [c for c in made if c in rows.columns]
    others = [c for c in rows.columns if c not in made]
    each = rows.select(*others, F.posexplode(F.arrays_zip(*there)).alias("pos", "__x"))
    named = [F.col(f"__x.{c}").alias(made[c]) for c in there if c != "relations"]
    return each.select(*others, "pos", *named, *(["__x.relations.dep", "__x.relations.head"] if "relations" in there else []))


def longest_spans(spans: Column) -> Column:
    """Of an array of spans (first, n, and other fields) those that the longest-first rule keeps, in the order of the text: the longest,
    then the next that overlaps none of them; ties from the left."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct((-s["n"]).alias("less"), s["first"].alias("first"), s.alias("span"))))
    apart = lambda kept, s: F.forall(kept, lambda k: (k["first"] + k["n"] <= s["first"]) | (s["first"] + s["n"] <= k["first"]))
    listed = F.transform(order, lambda x: x["span"])
    kept = F.aggregate(listed, F.slice(listed, 1, 0), lambda out, s: F.when(apart(out, s), F.concat(out, F.array(s))).otherwise(out))
    return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["first"].alias("first"), s.alias("span")))), lambda x: x["span"])


def with_longest_spans(docs: DataFrame, column: str = "spans") -> DataFrame:
    """docs with the spans of longest_spans() in the place of a column of candidates; null ones stay null."""
    return docs.withColumn(column, held(longest_spans(F.col(column)))).select(*docs.columns)
