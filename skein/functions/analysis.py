"""Lexical facts of texts by a pluggable analyser, and word vectors trained on word lists."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import col, digests
from skein.schemas import FACT

#: From a text to an array of facts.
Analyzer = Callable[[Column], Column]

_TOKEN = r"#?[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
_PREPOSITIONS = ("в", "во", "на", "по", "с", "со", "к", "ко", "от", "до", "из", "за", "под", "над", "о", "об", "у", "при", "про", "для", "без")


def default_analyzer(text: Column) -> Column:
    """Facts of the tokens of a text, in order.

    The lemma is the token in lower case; a preposition goes with the token after it and is no fact itself; a
    token with # is a hash tag, one of digits a number, one that begins with a capital and is not the text's
    first a name.  Null gives null, an empty text no facts.
    """
    words = F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))
    is_prep = lambda w: F.lower(w).isin(*_PREPOSITIONS)

    def fact(w: Column, i: Column) -> Column:
        before = F.get(words, i - 1)
        prep = F.when((i > 0) & is_prep(before), before)
        return F.struct(
            w.alias("noun"),
            F.lower(w).alias("noun_lemma"),
            prep.alias("prep"),
            F.lower(prep).alias("prep_lemma"),
            F.concat(F.lit("n"), i.cast("string")).alias("noun_id"),
            F.when(prep.isNotNull(), F.concat(F.lit("p"), (i - 1).cast("string"))).alias("prep_id"),
            F.lit("0").alias("lead_id"),
            w.startswith("#").alias("is_hash_tag"),
            ((i > 0) & w.rlike(r"^\p{Lu}")).alias("is_person_name"),
            w.rlike(r"^\p{N}+$").alias("is_number"),
        )

    return F.filter(F.transform(words, fact), lambda f: ~is_prep(f["noun"]))


def pandas_analyzer(f: Callable[[str], list[dict]]) -> Analyzer:
    """An analyser from a Python function on one text, run in Arrow batches; null texts stay null."""

    @F.pandas_udf(f"array<{FACT}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


def analyse(tweets: DataFrame, text: str = "tw_text", analyzer: Analyzer = default_analyzer) -> DataFrame:
    """Tweets with their facts."""
    return tweets.withColumn("facts", analyzer(col(text)))


def index_facts(analysed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, created_at, lemmas, sources) word lists, and the dictionary (noun_md5, noun) of lemmas and surfaces.

    A surface is the preposition and the noun in lower case.
    """
    surface = lambda f: F.lower(F.concat_ws(" ", f["prep"], f["noun"]))
    lists = analysed.select("id", "created_at", F.transform("facts", lambda f: f["noun_lemma"]).alias("lemmas"), F.transform("facts", surface).alias("sources"))
    texts = lists.select(F.explode(F.concat("lemmas", "sources")).alias("noun")).distinct()
    return lists, texts.select(F.element_at(digests(F.array("noun")), 1).alias("noun_md5"), "noun")


def word_vectors(lists: DataFrame, words: str = "lemmas", size: int = 300, window: int = 5, least: int = 40, seed: int = 1) -> Word2VecModel:
    """Skip-gram vectors of the words that occur at least ``least`` times."""
    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, seed=seed, inputCol=words, outputCol="vector").fit(lists.where(F.size(words) > 0))
