"""Exact top k of sparse dot products over impact-ordered blocks of postings, most of which are never joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litgrid.sources.tables import small, stored

from .rank import top_k

#: Postings of a block, and levels of impact for each doubling of it.
BLOCK, LEVELS = 256, 4
#: Postings of a query, by largest bounds, that its first pass reads, and times k that it scores.
FIRST, SCORED = 2000, 5
#: Room for rounding where bounds are compared.
SLACK = 1 + 1e-9


def blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (feature, level, docs: array of doc_id and value) and levels (feature, level, n, top) of doc_id, feature, value.

    A level holds a feature's postings of about one impact. Large levels are parted by a hash of the document, so that no
    feature, however frequent, is one row or one task.
    """
    rows = docs.where("value > 0").select("doc_id", "feature", F.col("value").cast("double").alias("value")).withColumn("level", F.floor(F.log2("value") * LEVELS).cast("int"))
    levels = stored(rows.groupBy("feature", "level").agg(F.count("*").alias("n"), F.max("value").alias("top")))
    large = levels.where(F.col("n") > BLOCK).select("feature", "level", F.ceil(F.col("n") / BLOCK).alias("parts"))
    parted = rows.join(small(large), ["feature", "level"], "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))))
    return stored(parted.groupBy("feature", "level", "part").agg(F.collect_list(F.struct("doc_id", "value")).alias("docs"))), levels


def _met(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """qid, doc_id, got, most of the postings in the chosen (qid, feature, level, q, most); blocks are opened after the join."""
    each = found.join(small(chosen), ["feature", "level"]).select("qid", "q", "most", F.explode("docs").alias("d"))
    return each.groupBy("qid", "d.doc_id").agg(F.sum(F.col("q") * F.col("d.value")).alias("got"), F.sum("most").alias("met"))


def _scored(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, doc_id, score of (qid, doc_id), from the documents' own rows."""
    own = docs.join(small(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    return pairs.join(own, "doc_id").join(small(queries), ["qid", "feature"]).groupBy("qid", "doc_id").agg(F.sum(F.col("q") * F.col("value")).alias("score"))


def block_max_top_k(queries: DataFrame, docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """qid, doc_id, score, rank of the k best documents of each query (qid, feature, value), and a report: qid, postings of
    its features, and how many of them were read. docs: doc_id, feature, value. Only values above 0 count.

    First pass: each query reads its most promising levels and scores the best documents there in full; its k-th best
    score is what others must reach. Second pass: features whose largest impacts together cannot reach it lead to no
    document by themselves, so their lists (mostly of frequent features) are not joined. Of the other features a level is
    joined only if its largest impact, with the most that all other features can add, reaches it. Documents met there are
    kept if what they got and what features not met can add does, and are scored in full from their own rows. No bound
    rules out a document among the k best. Equal scores (to nine digits) go by doc_id.
    """
    docs, queries = stored(docs.where("value > 0")), stored(queries.where("value > 0").groupBy("qid", "feature").agg(F.sum("value").cast("double").alias("q")))
    found, levels = blocks(docs)
    by_query = Window.partitionBy("qid")
    asked = queries.join(levels, "feature").withColumn("bound", F.col("q") * F.col("top"))
    asked = asked.withColumn("most", F.max("bound").over(Window.partitionBy("qid", "feature")))
    lists = asked.groupBy("qid", "feature").agg(F.max("most").alias("most"))
    lists = lists.withColumn("below", F.sum("most").over(by_query.orderBy("most", "feature"))).withColumn("all", F.sum("most").over(by_query))
    asked = stored(asked.drop("most").join(lists, ["qid", "feature"]))

    promising = asked.withColumn("before", F.coalesce(F.sum("n").over(by_query.orderBy(F.desc("bound"), "feature", "level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = top_k(_met(promising.where(F.col("before") < FIRST), found), ["qid"], [F.desc("got"), F.asc("doc_id")], SCORED * k)
    best = _scored(stored(first.select("qid", "doc_id")), queries, docs)
    least = stored(top_k(best, ["qid"], [F.desc("score"), F.asc("doc_id")], k).where(F.col("rank") == k).select("qid", F.col("score").alias("least")))

    bounded = asked.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    leads = (F.col("below") * SLACK >= F.col("least")) & ((F.col("bound") + F.col("all") - F.col("most")) * SLACK >= F.col("least"))
    chosen = stored(bounded.withColumn("read", leads))
    met = _met(chosen.where("read"), found).join(chosen.select("qid", "all", "least").distinct(), "qid")
    pairs = stored(met.where((F.col("got") + F.col("all") - F.col("met")) * SLACK >= F.col("least")).select("qid", "doc_id"))
    hits = top_k(_scored(pairs, queries, docs), ["qid"], [F.desc(F.round("score", 9)), F.asc("doc_id")], k)
    return hits, chosen.groupBy("qid").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("read"))
