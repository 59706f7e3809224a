"""Inverted-file index of dense vectors: lists around sampled centroids, of which a search reads the nearest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import BLOCK, _units
from .rank import top_k

#: Numbers of the vectors that centroids are drawn from, most lists, and vectors of a part of a list.
SAMPLE, LISTS, PART = 8_000_000, 4096, 200_000
ROUNDS = 8


def _drawn(docs: DataFrame, least: int, sample: int) -> tuple[np.ndarray, int]:
    """Unit vectors drawn by hash, `least` of them at least where there are so many, and the number of all."""
    given = docs.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    n, size = given.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return np.zeros((0, 1)), 0
    share = min(1.0, max(least, sample // size) / n)
    place = F.xxhash64("doc_id", "vector")
    some = given.where(F.pmod(place, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else given
    return _units([r["vector"] for r in some.select("vector").orderBy(place).collect()]), n


def centroids(docs: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids by k-means on a sample of the vectors, drawn by hash, that holds about `sample` numbers at most.

    lists: by default about the square root of the number of vectors. Where a centroid loses all its vectors it stays.
    """
    x, n = _drawn(docs, LISTS, sample)
    if not len(x):
        return np.zeros((0, 1))
    lists = min(len(x), LISTS, lists or max(1, round(n**0.5)))
    center = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (x @ center.T).argmax(1)
        total = np.zeros_like(center)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        center = np.where(norm > 0, total / np.where(norm > 0, norm, 1), center)
    return center


def probes_for(docs: DataFrame, center: np.ndarray, k: int, recall: float = 0.95, queries: int = 500, sample: int = SAMPLE) -> int:
    """The least number of lists that hold that share of the k nearest of drawn vectors among all drawn vectors."""
    x, _ = _drawn(docs, queries, sample)
    if not len(x) or not len(center):
        return 1
    own, asked = (x @ center.T).argmax(1), x[np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int)]
    nearest = np.argsort(-(asked @ x.T), 1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ center.T), 1, kind="stable"), 1)  # by query, the rank of each list
    ranks = np.sort(np.take_along_axis(place, own[nearest], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def write_index(docs: DataFrame, center: np.ndarray, path: str) -> None:
    """Writes doc_id and vector of all vectors (null ones go), a folder for each nearest centroid; large lists have several
    files, dealt by hash, so that no list, however many copies it holds, is one task."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)
    sent = spark.sparkContext.broadcast(center)

    def assign(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in rows:
            if len(x):
                yield x.assign(list=(_units(x["vector"]) @ sent.value.T).argmax(1).astype("int32"))

    given = docs.select("doc_id", "vector").where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    dealt = given.mapInPandas(assign, f"doc_id {kind['doc_id']}, vector {kind['vector']}, list int")
    parts = max(1, -(-given.count() // PART))
    dealt.repartition("list", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).write.mode("overwrite").partitionBy("list").parquet(path)


def search(spark: SparkSession, path: str, center: np.ndarray, queries: DataFrame, k: int, probes: int, block: int = BLOCK) -> DataFrame:
    """qid, doc_id, score, rank: the k best by cosine among the vectors of each query's `probes` nearest lists, scored exactly.

    Queries (qid, vector) go in blocks of at most `block`; only lists that some query of the block asks for are read. With
    all lists probed the rows are those of dense_top_k.
    """
    n_blocks, kind = max(1, -(-queries.count() // block)), dict(queries.dtypes)["qid"]
    docs = spark.read.parquet(path)
    found = None
    for b in range(n_blocks):
        some = queries.where(F.col("vector").isNotNull() & (F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b)).collect()
        qids, q = [r["qid"] for r in some], _units([r["vector"] for r in some])
        near = np.zeros((len(qids), len(center)), bool)
        if qids and len(center):
            np.put_along_axis(near, np.argsort(-(q @ center.T), 1, kind="stable")[:, :probes], True, 1)
        sent = spark.sparkContext.broadcast((qids, q, near))

        def score(rows: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qids, q, near = sent.value
            for x in rows:
                for at, own in x.groupby("list"):
                    asked = np.flatnonzero(near[:, at])
                    scores, n, ids = np.round(_units(own["vector"]) @ q[asked].T, 9), min(k, len(own)), own["doc_id"].to_numpy()
                    place = np.broadcast_to(np.argsort(np.argsort(ids, kind="stable"))[:, None], scores.shape)
                    order = np.lexsort((place, -np.round(scores, 6)), axis=0)[:n]
                    yield pd.DataFrame({"qid": np.repeat(np.array(qids, dtype=object)[asked], n), "doc_id": ids[order.T.ravel()], "score": np.take_along_axis(scores, order, 0).T.ravel()}).infer_objects()

        lists = np.flatnonzero(near.any(0)).tolist()
        one = docs.where(F.col("list").isin(lists) if lists else F.lit(False)).mapInPandas(score, f"qid {kind}, doc_id {dict(docs.dtypes)['doc_id']}, score double")
        found = one if found is None else found.unionByName(one)
    return top_k(found, ["qid"], [F.desc(F.round("score", 6)), F.asc("doc_id")], k)
