"""Phrases of a lexicon table found in texts by one automaton, however many there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases of an automaton, which each Python worker builds once; more are further automata.
PHRASES = 200_000


def _finder(phrases: list[str], whole_words: bool) -> Callable[[str | None], list[int]]:
    """A function that gives the places in the list, ascending, of the phrases that stand in a text."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        automaton.add_word(p, (i, len(p)))
    if phrases:
        automaton.make_automaton()

    def inside(text: str, k: int) -> bool:
        return 0 <= k < len(text) and (text[k] in _WORD)

    def find(text: str | None) -> list[int]:
        if not text or not phrases:
            return []
        found = automaton.iter(text)
        if whole_words:
            return sorted({i for end, (i, n) in found if not inside(text, end - n) and not inside(text, end + 1)})
        return sorted({i for _, (i, _) in found})

    return find


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _distinct(phrases: list[str]) -> list[str]:
    return list(dict.fromkeys(p for p in phrases if p))


class Dictionary:
    """A lexicon that goes to each task whole, with its phrases in order; up to PHRASES, which the caller vouches for.

    Texts and phrases are compared as they are, so both should be in one normal form. With whole_words a phrase counts
    only where neither a letter a to z nor a digit adjoins it.
    """

    def __init__(self, spark: SparkSession, phrases: list[str], whole_words: bool = True):
        phrases = _distinct(phrases)
        if len(phrases) > PHRASES:
            raise ValueError(f"a lexicon of over {PHRASES} phrases is for occurrences()")
        self.sent = spark.sparkContext.broadcast((phrases, whole_words))

    def found(self, text: Column) -> Column:
        """The different phrases in a text, in the lexicon's order; none for a null."""
        sent = self.sent

        @F.pandas_udf("array<string>")
        def spot(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            phrases, whole = sent.value
            find = _finder(phrases, whole)
            for x in texts:
                yield pd.Series([[phrases[i] for i in find(t)] for t in x], dtype=object)

        return spot(text)


def occurrences(texts: DataFrame, key: str, text: str, lexicon: DataFrame, phrase: str = "phrase", whole_words: bool = True) -> DataFrame:
    """key, phrase: each different phrase of the lexicon that stands in a text, for lexicons of any size.

    The lexicon is dealt by hash into parts of about PHRASES phrases, and each part's automaton goes over all texts: one
    linear pass a part, and no pair of a text and a phrase that do not meet. Rows with equal keys are texts of one key.
    """
    spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
    words = lexicon.select(F.col(phrase).alias("phrase")).where("phrase <> ''").distinct()
    parts, found = max(1, -(-words.count() // PHRASES)), None
    for k in range(parts):
        own = [r["phrase"] for r in words.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k).collect()]
        sent = spark.sparkContext.broadcast((own, whole_words))

        def spot(rows: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            phrases, whole = sent.value
            find = _finder(phrases, whole)
            for x in rows:
                hits = [find(t) for t in x["text"]]
                yield pd.DataFrame({"key": x["key"].repeat([len(h) for h in hits]), "phrase": pd.Series([phrases[i] for h in hits for i in h], dtype=object).to_numpy()}).reset_index(drop=True)

        one = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(spot, f"key {kind}, phrase string")
        found = one if found is None else found.union(one)
    return found.select(F.col("key").alias(key), "phrase").distinct()
