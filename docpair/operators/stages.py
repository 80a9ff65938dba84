"""The analysis of texts as a pyspark.ml Pipeline: stages with parameters that are saved and loaded, in any order that fits.

Each stage is a Transformer over columns of the operators in grammar.py; a pipeline of them is fitted, saved and loaded like any other.
Words makes a row for each sentence, in which the next stages add to its words; Relations makes a row for each word. All but Words take rows of words, too.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grammar as G


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A Transformer whose parameters are written and read by their names."""


class SpanMerger(_Stage):
    """docs: of candidate spans (an array with first and n) in spansCol the longest that don't overlap stay."""

    spansCol = Param(Params._dummy(), "spansCol", "column of candidate spans", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, spansCol: str = "spans"):
        super().__init__()
        self._setDefault(spansCol="spans")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return G.with_longest_spans(dataset, self.getOrDefault("spansCol"))


class Words(_Stage):
    """docs (doc_id, textCol) to a row for each sentence with its words as an array; columns named in keep go with each."""

    textCol = Param(Params._dummy(), "textCol", "column of texts", TypeConverters.toString)
    keep = Param(Params._dummy(), "keep", "columns that go with each word", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, textCol: str = "text", keep: list[str] = ()):
        super().__init__()
        self._setDefault(textCol="text", keep=[])
        self._set(**{k: list(v) if k == "keep" else v for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keep = [c for c in self.getOrDefault("keep") if c != "text"]
        rows = dataset.select("doc_id", *keep, F.col(self.getOrDefault("textCol")).alias("text"))
        return G.sentence_rows(rows, *self.getOrDefault("keep"))


class Tagger(_Stage):
    """Words to tagged words. entries are those of the lexicon, as word=TAG; without any, the built-in ones."""

    entries = Param(Params._dummy(), "entries", "lexicon entries, word=TAG", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, entries: list[str] = ()):
        super().__init__()
        self._setDefault(entries=[])
        self._set(**{k: list(v) for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes: dict[str, list[str]] = {}
        for entry in self.getOrDefault("entries"):
            word, _, tag = entry.rpartition("=")
            classes.setdefault(tag, []).append(word)
        if "words" in dataset.columns:
            return G.tagged_sentences(dataset, classes or None)
        return G.with_tags(dataset, G.lexicon(dataset.sparkSession, classes or None))


class Lemmatizer(_Stage):
    """Tagged words to words with lemmas. forms are irregular ones, as form=lemma; without any, the built-in ones."""

    forms = Param(Params._dummy(), "forms", "irregular forms, form=lemma", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, forms: list[str] = ()):
        super().__init__()
        self._setDefault(forms=[])
        self._set(**{k: list(v) for k, v in self._input_kwargs.items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        table: dict[str, list[str]] = {}
        for entry in self.getOrDefault("forms"):
            form, _, lemma = entry.partition("=")
            table.setdefault(lemma, []).append(form)
        if "words" in dataset.columns:
            return G.lemmatized_sentences(dataset, table or None)
        return G.with_lemmas(dataset, G.irregular(dataset.sparkSession, table or None))


class Relations(_Stage):
    """Tagged words to words with their relation to the root of the sentence."""

    @keyword_only
    def __init__(self):
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if "words" in dataset.columns:
            return G.word_rows(G.related_sentences(dataset))
        return G.with_relations(dataset)


def text_pipeline(merge_spans: bool = False) -> Pipeline:
    """All stages in order; with spans, their merging goes first and they go with each word."""
    first = [SpanMerger(), Words(keep=["spans"])] if merge_spans else [Words()]
    return Pipeline(stages=[*first, Tagger(), Lemmatizer(), Relations()])
