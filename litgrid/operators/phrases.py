"""Positional postings of fielded texts, and terms and phrases matched on them with room for words between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litgrid.functions import text as T
from litgrid.sources.tables import held, small, stored

from .index import bm25_idf


def words(text: Column) -> Column:
    """The words that positions count: runs of letters and digits of the folded text, none for an empty one."""
    return F.filter(F.split(T.normalize_title(text), " "), lambda w: w != "")


def field_rows(docs: DataFrame, doc: str, fields: dict[str, Column]) -> DataFrame:
    """doc_id, field, words, length: one row for each field of a document."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), words(x).alias("words")) for name, x in fields.items()))).alias("f")
    return docs.select(F.col(doc).alias("doc_id"), each).select("doc_id", "f.field", "f.words", F.size("f.words").alias("length"))


def positional_postings(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """field, token, doc_id, length and the ascending positions of the vocabulary's (field, token) in each text.

    A field's words are one row until the vocabulary is met; a token's positions in a text are gathered before the shuffle.
    """
    each = rows.select("doc_id", "field", "length", F.posexplode("words").alias("place", "token")).join(small(vocabulary), ["field", "token"])
    return each.groupBy("field", "token", "doc_id", "length").agg(F.sort_array(F.collect_list("place")).alias("positions"))


def matches(lists: Column, slop: Column) -> Column:
    """How often a phrase stands in a text: lists are its words' positions, in order. A match with g words between its words,
    of at most slop, counts 1 / (1 + g); slop is 0 or 1.

    Position lists, each less its word's place in the phrase, are met one after the other: what is left of the first is
    where the phrase stands without a gap; a second list holds where it stands after one.
    """
    start = F.struct(F.lit(-1).alias("i"), F.array().cast("array<int>").alias("straight"), F.array().cast("array<int>").alias("late"))

    def meet(a: Column, x: Column) -> Column:
        i = a["i"] + 1
        here = F.transform(x, lambda p: p - i)
        later = F.array_union(F.array_intersect(a["late"], here), F.array_intersect(F.transform(a["straight"], lambda p: p + 1), here))
        return F.when(i == 0, F.struct(i.alias("i"), here.alias("straight"), a["late"].alias("late"))).otherwise(
            F.struct(i.alias("i"), F.array_intersect(a["straight"], here).alias("straight"), F.when(slop > 0, later).otherwise(a["late"]).alias("late"))
        )

    return F.aggregate(lists, start, meet, lambda a: F.size(a["straight"]) + 0.5 * F.size(a["late"]))


def clause_scores(clauses: DataFrame, rows: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """qid, doc_id, field, phrase, slop, frequency, score: every clause's match in every text, scored like BM25 with the
    sum of its words' document frequencies and the phrase's frequency, times the clause's boost.

    clauses: qid, field, phrase (array of words, one for a term), slop (0 or 1), boost; rows: as field_rows gives them.
    Texts that hold a phrase's rarest word are the only candidates, so common words lead to no text by themselves.
    Candidates then meet the postings of their other words by text and word. Clauses whose words stand nowhere have no row.
    """
    clauses = held(clauses.where(F.size("phrase") > 0).withColumn("id", F.xxhash64("field", "slop", "phrase")))
    asked = clauses.select("id", "field", "slop", "phrase").distinct()
    each = asked.select("id", "field", "slop", F.size("phrase").alias("n"), F.posexplode("phrase").alias("i", "token"))
    size = rows.groupBy("field").agg(F.count("*").alias("texts"), F.avg("length").alias("mean"))
    post = stored(positional_postings(rows, each.select("field", "token").distinct()))
    df = post.groupBy("field", "token").agg(F.count("*").alias("df"))
    known = each.join(small(df), ["field", "token"]).join(F.broadcast(size), "field").withColumn("idf", bm25_idf(F.col("texts"), F.col("df")))
    whole = known.groupBy("id", "field", "slop", "n", "mean").agg(F.sum("idf").alias("idf"), F.min_by("token", F.struct("df", "i")).alias("rarest"), F.count("*").alias("found"), F.collect_list(F.struct("i", "token")).alias("parts"))
    whole = small(held(whole.where("found = n")))
    single = post.withColumnRenamed("token", "rarest").join(whole, ["field", "rarest"])
    terms = single.where("n = 1").select("id", "doc_id", "length", "mean", "idf", F.size("positions").cast("double").alias("frequency"))
    parts = single.where("n > 1").select("id", "field", "doc_id", "length", "mean", "idf", "slop", "n", F.explode("parts").alias("p")).select("*", "p.i", "p.token").drop("p")
    lists = parts.join(post.select("field", "token", "doc_id", "positions"), ["field", "token", "doc_id"])
    lists = lists.groupBy("id", "doc_id", "length", "mean", "idf", "slop", "n").agg(F.array_sort(F.collect_list(F.struct("i", "positions"))).alias("lists")).where(F.size("lists") == F.col("n"))
    phrases = lists.withColumn("frequency", matches(F.transform("lists", lambda x: x["positions"]), F.col("slop"))).where("frequency > 0")
    found = terms.unionByName(phrases.select(*terms.columns))
    saturated = F.col("frequency") * (k1 + 1) / (F.col("frequency") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return found.join(small(clauses), "id").select("qid", "doc_id", "field", "phrase", "slop", "frequency", (F.col("boost") * F.col("idf") * saturated).alias("score"))


def phrase_clauses(phrases: DataFrame, boosts: dict[str, tuple[float, int]]) -> DataFrame:
    """A clause for each field of each (qid, phrase, weight); boosts: field -> (boost, slop)."""
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(boost).alias("boost"), F.lit(slop).alias("slop")) for f, (boost, slop) in boosts.items()))).alias("f")
    return phrases.select("qid", "phrase", "weight", fields).select("qid", "f.field", "phrase", "f.slop", F.round(F.col("f.boost") * F.col("weight"), 4).alias("boost"))
