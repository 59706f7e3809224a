"""Fusion of hits and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected, spread_join
from .rank import by_source, top_k


def annotated(hits: DataFrame, group: list[str], order: list, weight: str | None = None) -> DataFrame:
    """Hits with their rank within the action and the reciprocal-rank score of their retriever."""
    w = F.greatest(F.lit(0.1), F.col(weight)) if weight else F.lit(1.0)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.withColumn("rrf", by_source(F.col("source"), 0, 1.0) * w / (60.0 + F.col("rank")))


def fused(hits: DataFrame, qid: str = "qid", paper: str = "paper_id") -> DataFrame:
    """Per candidate the sum over retrievers of the best reciprocal-rank score over its actions."""
    best = hits.groupBy(qid, paper, "source").agg(F.max("rrf").alias("rrf"), F.max("score").alias("score"))
    return best.groupBy(qid, paper).agg(F.sum("rrf").alias("rrf"), F.max("score").alias("best_score"), F.count("*").alias("n_sources"))


def diagnostic_pool(candidates: DataFrame, k: int = 500) -> DataFrame:
    """The first k candidates of each query by fused score, then best raw score, then id."""
    return top_k(candidates, ["qid"], [F.desc(F.round("rrf", 9)), F.desc("best_score"), F.desc("paper_id")], k)


def entities(keys: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """node and entity: rows that share an identity key, over any number of steps, are one entity named by its least node.

    keys has a row for each node and key. Each key hangs its nodes on the least of them, and the components of these edges
    are the entities; every round is written to the checkpoint folder, so that neither the plan nor the loss of an
    executor makes earlier rounds run again. No key, node or entity is gathered in one task, however large.
    """
    spark = keys.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        raise ValueError("set spark.checkpoint.dir")
    links = keys.select(F.col(node).alias("node"), F.col(key).alias("key")).distinct().checkpoint()
    least = links.groupBy("key").agg(F.min("node").alias("least")).checkpoint()
    labels = connected(spread_join(links, least, "key").select(F.col("node").alias("a"), F.col("least").alias("b")))
    every = links.select("node").distinct().join(labels, "node", "left")
    return every.select(F.col("node").alias(node), F.coalesce("label", "node").alias("entity"))


def merged(rows: DataFrame, entity: str, order: str) -> DataFrame:
    """A row per entity: longest abstract, first year and venue in order, most citations, first title."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy(entity).agg(first("title"), F.max_by("abstract", F.struct(F.length("abstract"), -F.col(order))).alias("abstract"), first("year"), first("venue"), F.max("citation_count").alias("citation_count"), F.count("*").alias("members"))


def unions(rows: DataFrame, entity: str, sets: dict[str, str], scores: str | None = None) -> DataFrame:
    """A row per entity with the different values of each array column, ascending (name of the result -> column), and with the
    greatest score of each name, where `scores` is a map column. Values are made different before the shuffle, so a group
    of very many rows sends each value once a task."""
    each = [rows.select(F.col(entity), F.lit(name).alias("_set"), F.explode(column).alias("_value")).distinct() for name, column in sets.items()]
    out = rows.select(entity).distinct()
    for name, one in zip(sets, each, strict=True):
        out = out.join(one.groupBy(entity).agg(F.array_sort(F.collect_list("_value")).alias(name)), entity, "left")
    if scores:
        best = rows.select(F.col(entity), F.explode(scores).alias("_name", "_score")).groupBy(entity, "_name").agg(F.max("_score").alias("_score"))
        out = out.join(best.groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_score")))).alias(scores)), entity, "left")
    return out
