"""Query analysis as table transforms: weighted terms and phrases, cues, time ranges, actions, coverage."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions import text as T

from .rank import top_k

#: Cues by ordered keyword rules: fixed values. All groups of a rule must have a term in the text.
CUES = (
    ("first proposed", (("first", "introduced", "initially", "pioneer"),)),
    ("foundational work", (("gave rise to", "gave rise", "origin", "originated", "originating", "prompt-based learning"),)),
    ("comparative study", (("compare", "versus", "vs", "contrast", "compare with"),)),
    ("performance degradation", (("negative impact", "negatively impact", "harm", "degrade", "worse"),)),
    ("better than larger baseline", (("better",), ("than", "bigger", "larger"))),
    ("empirical finding", (("claiming", "claim", "show that", "showing that"),)),
    ("analysis", (("analyzes", "analyse", "analyze", "analysis"),)),
    ("factual consistency", (("factuality", "faithfulness", "hallucination"),)),
)
VENUES = ("acl", "emnlp", "neurips", "iclr", "icml", "cvpr", "iccv", "eccv", "sigir", "kdd")


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(text, F.lit(t))
    return hit


def relation_cues(query: Column, limit: int = 4) -> Column:
    low, found = F.lower(query), []
    for name, groups in CUES:
        hit = F.lit(True)
        for terms in groups:
            hit = hit & _any(low, terms)
        found.append(F.when(hit, F.lit(name)))
    return F.slice(F.array_compact(F.array(*found)), 1, limit)


def time_range(query: Column) -> Column:
    """struct(start, end) of the years in the text; null without a year; open by after, since, before or until."""
    low = F.lower(query)
    years = F.transform(F.regexp_extract_all(low, T.ascii_words(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    first, last = F.array_min(years), F.array_max(years)
    after, before = _any(low, ("after", "since")), _any(low, ("before", "until"))
    return F.when(F.size(years) > 0, F.struct(F.when(~(before & ~after), first).alias("start"), F.when(~after, last).alias("end")))


def venues(query: Column, whole_words: bool = False) -> Column:
    """Upper-case names that occur in the text; with whole_words only between non-letters."""
    low = F.lower(query)
    if whole_words:
        low = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z]+", " "), F.lit(" "))
    names = [F.when(F.contains(low, F.lit(f" {v} " if whole_words else v)), F.lit(v.upper())) for v in VENUES]
    return F.array_compact(F.array(*names))


def excluded(query: Column) -> Column:
    return T.distinct_ignoring_case(F.regexp_extract_all(F.lower(query), F.lit(r"(?:not about|excluding|exclude|except) ([a-z0-9 -]+)"), F.lit(1)))


def main_intent(query: Column, constraints: Column) -> Column:
    return F.when(F.size(constraints) > 0, F.concat(F.lit("find scholarly papers about "), F.array_join(F.slice(constraints, 1, 4), ", "))).otherwise(F.concat(F.lit("find scholarly papers relevant to: "), query))


def without_noise(terms: Column, noise: list[str]) -> Column:
    """Terms that are not noise words; all terms if none would remain."""
    kept = F.filter(terms, lambda t: ~F.lower(t).isin(*noise))
    return F.when(F.size(kept) > 0, kept).otherwise(terms)


def keep_term(token: Column, high: list[str], low: list[str], stop: tuple[str, ...] = T.STOP_WORDS) -> Column:
    return (token.isin(*high) | ~(token.isin(*stop) | (F.length(token) <= 2))) & ~token.isin(*low)


def term_weight(token: Column, high: list[str], low: list[str], suffixes: tuple[str, ...], stop: tuple[str, ...] = T.STOP_WORDS) -> Column:
    """1, raised for valued, hyphenated, short alphabetic and domain terms, lowered for common ones and numbers."""
    w = 1.0 + F.when(token.isin(*high), 1.2).otherwise(0.0) + F.when(F.contains(token, F.lit("-")), 0.7).otherwise(0.0)
    w = w + F.when(F.rlike(token, F.lit("^[a-z]{2,12}(?:-[a-z0-9]{2,12})?$")) & ~token.isin(*stop), 0.5).otherwise(0.0)
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.endswith(token, F.lit(s))
    w = (w + F.when(ends, 0.35).otherwise(0.0)) * F.when(token.isin(*low), 0.45).otherwise(1.0) * F.when(F.rlike(token, F.lit("^[0-9]+$")), 0.6).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.1), F.least(w, F.lit(3.0))), 4)


def weighted_terms(queries: DataFrame, high: list[str], low: list[str], suffixes: tuple[str, ...], limit: int = 24) -> DataFrame:
    """qid, term, weight, place: each query's different kept tokens, heaviest and then longest first."""
    words = queries.select("qid", F.explode(T.tokens(T.normalize_title(F.col("query_text")), ())).alias("term")).where(keep_term(F.col("term"), high, low)).distinct()
    weighted = words.withColumn("weight", term_weight(F.col("term"), high, low, suffixes))
    return top_k(weighted, ["qid"], [F.desc("weight"), F.desc(F.length("term")), F.asc("term")], limit, "place")


def weighted_phrases(queries: DataFrame, high: list[str], low: list[str], suffixes: tuple[str, ...], limit: int = 12) -> DataFrame:
    """qid, phrase, weight: runs of two to four kept tokens of which one is valued, hyphenated or a domain word."""
    kept = F.filter(T.tokens(T.normalize_title(F.col("query_text")), ()), lambda t: keep_term(t, high, low))
    grams = queries.select("qid", F.explode(F.concat(*(T.ngrams(kept, n) for n in (4, 3, 2)))).alias("phrase")).distinct()
    parts = F.split("phrase", " ")
    useful = F.exists(parts, lambda t: t.isin(*high) | F.contains(t, F.lit("-")) | F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(t, s)))
    weight = F.round(F.least(F.lit(4.5), F.array_max(F.transform(parts, lambda t: term_weight(t, high, low, suffixes))) + 0.55 * (F.size(parts) - 1)), 4)
    return top_k(grams.where(useful).withColumn("weight", weight), ["qid"], [F.desc("weight"), F.desc(F.length("phrase")), F.asc("phrase")], limit, "place")


def token_map(terms: DataFrame, phrases: DataFrame) -> DataFrame:
    """qid, token, weight: terms, and phrases' tokens at the greater of their own and min(2.4, 0.7 phrase weight)."""
    parts = phrases.select("qid", F.explode(F.split("phrase", " ")).alias("token"), F.least(F.lit(2.4), 0.7 * F.col("weight")).alias("weight"))
    return terms.select("qid", F.col("term").alias("token"), "weight").unionByName(parts).groupBy("qid", "token").agg(F.max("weight").alias("weight"))


def sparse_features(terms: DataFrame, phrases: DataFrame) -> DataFrame:
    """qid, feature, weight: the token map and the phrases themselves."""
    return token_map(terms, phrases).select("qid", F.col("token").alias("feature"), "weight").unionByName(phrases.select("qid", F.concat(F.lit("phrase:"), "phrase").alias("feature"), "weight"))


def sub_query_top_k(index: Column, k: int) -> Column:
    return F.when(index <= 3, F.lit(k)).otherwise(F.greatest(F.lit(30), F.floor(F.lit(k) * 0.8))).cast("int")



def constraint_matches(constraints: DataFrame, candidates: DataFrame, text: str) -> DataFrame:
    """qid, paper_id, constraint, weight, matched. constraints: qid, constraint; candidates: qid, paper_id and a text.

    A constraint is matched by its whole phrase, or by at least min(2, its tokens) of its tokens.
    """
    words = T.tokens(F.col("constraint"))
    asked = constraints.select("qid", "constraint", words.alias("words"), T.normalize_title(F.col("constraint")).alias("phrase")).where(F.size("words") > 0)
    given = candidates.select("qid", "paper_id", F.array_distinct(T.tokens(F.col(text))).alias("have"), T.normalize_title(F.col(text)).alias("whole"))
    x = asked.join(given, "qid")
    overlap = F.size(F.filter("words", lambda w: F.array_contains(F.col("have"), w)))
    exact = (F.size("words") > 1) & F.contains(F.col("whole"), F.col("phrase"))
    weight = F.when((F.size("words") > 1) | F.contains(F.col("constraint"), F.lit("-")), 1.6).when(F.length(F.col("words")[0]) <= 3, 0.7).otherwise(1.0)
    return x.select("qid", "paper_id", "constraint", weight.alias("weight"), (exact | (overlap >= F.least(F.lit(2), F.size("words")))).alias("matched"))



def action_metrics(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """Exact match, parse rate, stop accuracy and micro precision, recall and F1 of `[Expand]a[Expand]b[StopExpand]` strings."""

    def parsed(x: str) -> tuple[Column, Column]:
        text = F.trim(F.coalesce(F.col(x), F.lit("")))
        ok = F.endswith(text, F.lit("[StopExpand]"))
        items = F.regexp_extract_all(text, F.lit(r"(?s)\[Expand\](.*?)(?=\[Expand\]|\[StopExpand\])"), F.lit(1))
        clean = F.filter(F.array_distinct(F.transform(items, lambda i: F.trim(i))), lambda i: i != "")
        return ok, F.when(ok, clean).otherwise(F.array().cast("array<string>"))

    (_, gold), (ok, pred) = parsed(label), parsed(prediction)
    x = rows.select(ok.alias("ok"), (F.trim(label) == F.trim(prediction)).alias("exact"), ((F.size(gold) == 0) == (F.size(pred) == 0)).alias("stop"), F.size(F.array_intersect(gold, pred)).alias("tp"), F.size(F.array_except(pred, gold)).alias("fp"), F.size(F.array_except(gold, pred)).alias("fn"))
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return x.agg(F.count("*").alias("total"), rate("exact").alias("exact_match"), rate("ok").alias("parse_rate"), rate("stop").alias("stop_accuracy"), F.round(tp / (tp + fp), 6).alias("precision"), F.round(tp / (tp + fn), 6).alias("recall"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"))


def document_features(docs: DataFrame, high: list[str], low: list[str], suffixes: tuple[str, ...], aliases: dict[str, str], most: int = 80) -> DataFrame:
    """doc_id, feature, value: counts of kept tokens (as keep_term has them), the heaviest `most` runs of four to two of them
    with a useful one, and the phrases of aliases in the text, of equal features the greatest.

    docs: doc_id, norm (as normalize_title gives it), a row for each id, so that everything is found in the row's task.
    """
    high_, low_, stop, ends = frozenset(high), frozenset(low), frozenset(T.STOP_WORDS), tuple(suffixes)
    phrases = [(f" {a} ", f"phrase:{t}") for a, t in aliases.items()]

    def features(text: str) -> dict[str, float]:
        ts = [t for t in text.split(" ") if len(t) > 1 and t not in low_ and (t in high_ or (len(t) > 2 and t not in stop))]
        useful = [t in high_ or "-" in t or t.endswith(ends) for t in ts]
        out = {t: float(n) for t, n in Counter(ts).items()}
        weights = []
        for n in (4, 3, 2):
            grams = Counter(" ".join(ts[k : k + n]) for k in range(len(ts) - n + 1) if True in useful[k : k + n])
            weights += [(-round(times * (1 + 0.15 * (n - 1)), 4), g) for g, times in grams.items()]
        named = [(f"phrase:{g}", -w) for w, g in heapq.nsmallest(most, weights)]
        named += [(phrase, 1.8) for alias, phrase in phrases if ts and alias in f" {text} "]
        for f, v in named:
            out[f] = max(v, out.get(f, v))
        return out

    def spread(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in rows:
            for k in range(0, len(x), 200):
                some = x.iloc[k : k + 200]
                found = [features(t) for t in some["norm"]]
                ids = some["doc_id"].repeat([len(f) for f in found])
                yield pd.DataFrame({"doc_id": ids.to_numpy(), "feature": [f for one in found for f in one], "value": [v for one in found for v in one.values()]})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(F.col("doc_id").cast("string"), "norm").mapInPandas(spread, "doc_id string, feature string, value double").withColumn("doc_id", F.col("doc_id").cast(kind))
