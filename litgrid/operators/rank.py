"""Ranking: top-k per group, score features, labels, preselection scores, greedy selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: By retriever: base of the reciprocal-rank score, weight of the rank signal, preselection bonus and its scale. Fixed values.
SOURCES = {
    "title_bm25": (1.25, 1.15, 0.28, 24.0),
    "chunk_bm25": (1.00, 1.05, 0.18, 30.0),
    "tfidf": (0.94, 0.85, 0.08, 30.0),
    "dense": (1.18, 1.20, 0.22, 38.0),
    "sparse": (1.08, 0.55, 0.16, 44.0),
    "alias": (1.10, 0.75, 0.0, 1.0),
    "concept": (0.72, 0.65, 0.07, 24.0),
    "api": (0.86, 1.10, 0.24, 32.0),
    "api_snippet": (0.80, 0.95, 0.20, 38.0),
}


def by_source(source: Column, column: int, other: float) -> Column:
    found = F.lit(other)
    for name, values in SOURCES.items():
        found = F.when(source == name, F.lit(values[column])).otherwise(found)
    return found


def top_k(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes each partition's groups to k rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def rank_signal(hits: DataFrame, keys: list[str]) -> DataFrame:
    """min(1, sum of w / (1 + rank / 8) over min(sum of w, 2.8)) over the retrievers of a candidate."""
    w = by_source(F.col("source"), 1, 0.7)
    return hits.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(w / (1 + F.greatest(F.col("rank"), F.lit(1)) / 8.0)) / F.least(F.sum(w), F.lit(2.8))).alias("rank_signal"))


def rank_of(name: str) -> Column:
    return F.min(F.when(F.col("source") == name, F.greatest(F.col("rank"), F.lit(1)))).alias(f"r_{name}")


def source_ranks(hits: DataFrame, keys: list[str]) -> DataFrame:
    """A row per candidate with its best rank by every retriever, the number of retrievers and the best raw score."""
    return hits.groupBy(*keys).agg(*(rank_of(s) for s in SOURCES), F.count_distinct("source").alias("n_sources"), F.max("score").alias("best_score"))


def candidates(hits: DataFrame, keys: list[str]) -> DataFrame:
    """A row per candidate with its ranks by retriever, number of retrievers, best raw score, rank signal and fused score,
    from one grouping. hits: as fuse.annotated gives them, a row for each action that found the candidate."""
    w = by_source(F.col("source"), 1, 0.7)
    best = hits.groupBy(*keys, "source").agg(F.min(F.greatest(F.col("rank"), F.lit(1))).alias("rank"), F.max("rrf").alias("rrf"), F.max("score").alias("score"))
    signal = F.least(F.lit(1.0), F.sum(w / (1 + F.col("rank") / 8.0)) / F.least(F.sum(w), F.lit(2.8)))
    return best.groupBy(*keys).agg(*(rank_of(s) for s in SOURCES), F.count("*").alias("n_sources"), F.max("score").alias("best_score"), signal.alias("rank_signal"), F.sum("rrf").alias("rrf"))


def sparse_synergy() -> Column:
    lexical = F.least("r_title_bm25", "r_chunk_bm25")
    near = 1.0 + F.col("r_sparse") / 20.0
    return F.when(F.col("r_sparse").isNull(), 0.0).when(lexical.isNull(), 0.18 / near).otherwise(F.least(F.lit(1.0), 0.55 / near + 0.45 / (1.0 + lexical / 16.0)))


def academic_synergy() -> Column:
    one = 0.62 / (1.0 + F.col("r_api") / 18.0)
    return F.when(F.col("r_api").isNull(), 0.0).when(F.col("r_api_snippet").isNull(), one).otherwise(F.least(F.lit(1.0), one + 0.55 / (1.0 + F.col("r_api_snippet") / 24.0)))


def graph_authority(influential: Column, references: Column) -> Column:
    return 0.75 * F.least(F.lit(1.0), F.log1p(influential) / 5.0) + 0.25 * F.least(F.lit(1.0), F.log1p(references) / 8.0)


def recency(year: Column) -> Column:
    return F.when(year.isNull(), 0.2).when(year >= 2023, 1.0).when(year >= 2019, 0.8).when(year >= 2015, 0.6).otherwise(0.4)


def retrieval_signal(best: Column) -> Column:
    return F.coalesce(best / (best + 5.0), F.lit(0.0))


def rrf_signal(rrf: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(rrf, F.lit(0.0)) / 0.055)


def constraint_weight(words: Column, text: Column) -> Column:
    """1.6 for several tokens or a hyphen, 0.7 for a short token, else 1; 0 without tokens."""
    return F.when(F.size(words) == 0, 0.0).when((F.size(words) > 1) | F.contains(text, F.lit("-")), 1.6).when(F.length(words[0]) <= 3, 0.7).otherwise(1.0)


def label(coverage: Column, scored: Column, n_sources: Column) -> Column:
    return F.when((coverage >= 0.6) & scored, "highly_relevant").when((coverage >= 0.3) | (n_sources >= 2), "partially_relevant").otherwise("weakly_relevant")


#: Weights of the final score's features: fixed values.
SCORE = {
    "coverage": 0.28, "retrieval_signal": 0.05, "rank_signal": 0.48, "rrf_signal": 0.3, "sparse_synergy": 0.22, "academic_synergy": 0.18, "keyword_match": 0.1, "soft_alias": 0.12,
    "strong_alias": 0.42, "graph_alias": 0.18, "source_confidence": 0.05, "citation_authority": 0.04, "graph_authority": 0.05, "recency": 0.03, "phrase_bonus": 0.03,
}


def final_score(features: dict[str, Column], penalty: Column) -> Column:
    """The weighted sum of the features less the penalty for missing constraints, itself softened by alias bonuses."""
    get = lambda k: features.get(k, F.lit(0.0))
    soft = F.greatest(F.lit(0.0), F.least(F.lit(0.45), penalty) - 0.15 * get("soft_alias") - 0.25 * get("strong_alias") - 0.18 * get("graph_alias"))
    total = F.lit(0.0)
    for name, w in SCORE.items():
        total = total + w * get(name)
    return total - soft


def rank_bonus() -> Column:
    """Sum of w / (1 + rank / scale) over the retrievers that found the candidate."""
    total = F.lit(0.0)
    for name, (_, _, w, scale) in SOURCES.items():
        if w:
            total = total + F.coalesce(w / (1.0 + F.col(f"r_{name}") / scale), F.lit(0.0))
    return total


def promoted(rank: Column, strong: Column, at: int = 30) -> Column:
    """An order key that moves strong rows behind the first `at` up to right after them."""
    return F.when(rank <= at, F.struct(F.lit(0).alias("block"), rank.alias("rank"))).when(strong, F.struct(F.lit(1).alias("block"), rank.alias("rank"))).otherwise(F.struct(F.lit(2).alias("block"), rank.alias("rank")))


def rerank_fusion(model: Column, heuristic: Column, alias: Column, source: Column) -> Column:
    """(1 - w) model + w heuristic with w = min(.75, .25 + .35 alias + .35 source)."""
    w = F.least(F.lit(0.75), 0.25 + 0.35 * alias + 0.35 * source)
    return (1 - w) * model + w * heuristic


def merge_head(pool: DataFrame, reranked: DataFrame, protect: int = 0) -> DataFrame:
    """qid, paper_id, place: the pool's first `protect` rows, then the reranked rows in their order, then the rest of the
    pool, each paper once. pool: qid, paper_id, rank; reranked: qid, paper_id, rerank, which may hold papers beyond the pool."""
    both = pool.select("qid", "paper_id", "rank").join(reranked.select("qid", "paper_id", "rerank"), ["qid", "paper_id"], "full")
    block = F.when(F.col("rank") <= protect, F.struct(F.lit(0).alias("block"), F.col("rank").cast("long").alias("at"))).when(F.col("rerank").isNotNull(), F.struct(F.lit(1).alias("block"), F.col("rerank").cast("long").alias("at"))).otherwise(F.struct(F.lit(2).alias("block"), F.col("rank").cast("long").alias("at")))
    return both.select("qid", "paper_id", F.row_number().over(Window.partitionBy("qid").orderBy(block)).alias("place"))
