"""Exact top-k search of texts by integer impacts: vectors in buckets by length, pruned by Cauchy-Schwarz and coordinates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, id_in, id_out, lean, prepared, settled

#: Items, and different terms of them, that one pass over the documents answers: what is sent to all tasks.
ITEMS, TERMS = 4096, 500_000
#: Share of the documents, those of the longest vectors, that are scored first, for what scores must reach.
LONGEST = 1 / 64
#: Vectors of a bucket within a task, coordinates of an item that bounds are drawn from in turn, bytes of text cut at once.
BUCKET, FOCUS, SEGMENT = 4096, (4, 12), 1 << 20
#: Room for rounding in comparisons of bounds, which are in doubles; scores are integers.
SLACK = 1 + 1e-9
_TERMS = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_LAST = (1 << 63) - 1


def counted(text: bytes) -> Counter:
    """How often each term stands in a text, which is cut between terms into pieces of about SEGMENT bytes."""
    found, at = Counter(), 0
    while at < len(text):
        to = min(len(text), at + SEGMENT)
        while to < len(text) and _TERMS[text[to]] != 32:
            to += 1
        found.update(text[at:to].translate(_TERMS).split())
        at = to
    return found


def blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """The items with their terms, up to ITEMS items and about TERMS terms at a time; rows of one id are one item."""
    block, terms = [], 0
    rows = items.groupBy("item_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    for item_id, texts in rows.toLocalIterator():
        own = sum((counted(t.encode()) for t in texts), Counter())
        if block and (len(block) == ITEMS or terms + len(own) > TERMS):
            yield block
            block, terms = [], 0
        block.append((item_id, own))
        terms += len(own)
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), and the terms of the vocabulary in it with their counts; texts without terms go.

    Each task adds a row of n -1 with the documents that hold each term.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @lean
    def count(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held = sent.value, np.zeros(len(sent.value), np.int64)
        for x in rows:
            out = []
            for i, text in zip(x["doc_id"].tolist(), x["text"].tolist(), strict=True):
                found = counted(bytes(text))
                if found:
                    own = sorted((names[t], tf) for t, tf in found.items() if t in names)
                    at = np.array(own, np.int64).reshape(-1, 2)
                    held[at[:, 0]] += 1
                    out.append((i, found.total(), at[:, 0].astype("<i4").tobytes(), at[:, 1].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "counts"])
        at = np.flatnonzero(held)
        yield pd.DataFrame([(0, -1, at.astype("<i4").tobytes(), held[at].astype("<u4").tobytes())], columns=["doc_id", "n", "terms", "counts"])

    rows = docs.select(id_in("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(count, "doc_id long, n long, terms binary, counts binary")


def document_frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    @lean
    def parted(x: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(terms, np.int64)
        for part in x:
            for at, many in zip(part["terms"].tolist(), part["counts"].tolist(), strict=True):
                total[np.frombuffer(at, "<i4")] += np.frombuffer(many, "<u4")
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    out = np.zeros(terms, np.int64)
    for term, many in rows.where("n < 0").select("terms", "counts").mapInPandas(parted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[term] = many
    return out


def impacts(rows: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, terms, impacts (of each term's occurrences, without its weight) and the length of the vector.

    A coordinate counts as the impact times the root of the term's weight, and the item's as its count times that root, so
    that their product is the score, and what is rare weighs as much in the lengths of both.
    """
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    @lean
    def made(x: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for part in x:
            out = []
            for i, n, at, tf in zip(*(part[c].tolist() for c in ("doc_id", "n", "terms", "counts")), strict=True):
                tf = np.frombuffer(tf, "<u4").astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * n_docs // n_terms))
                out.append((i, at, impact.astype("<u4").tobytes(), float(np.sqrt(np.dot(w[np.frombuffer(at, "<i4")].astype(float), impact.astype(float) ** 2)))))
            yield pd.DataFrame(out, columns=["doc_id", "terms", "impacts", "length"])

    return rows.where("n >= 0").mapInPandas(made, "doc_id long, terms binary, impacts binary, length double").where("length > 0")


class Best:
    """The k best documents of each item so far, and the score that a further one must reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.found = k, least.copy(), {}

    def add(self, q: int, score: np.ndarray, doc_id: np.ndarray) -> None:
        if q in self.found:
            score, doc_id = np.r_[self.found[q][0], score], np.r_[self.found[q][1], doc_id]
        order = np.lexsort((doc_id, -score))[: self.k]
        self.found[q] = score[order], doc_id[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], score[order[-1]])


class Items:
    """An item's vector: terms by weight, heaviest first, their integer factors, and coordinates."""

    def __init__(self, counts: list[dict[int, int]], weights: np.ndarray):
        self.of = []
        for own in counts:
            terms = np.array(sorted((t for t in own if weights[t] > 0), key=lambda t: (-weights[t] * own[t] ** 2, t)), np.int64)
            times = np.array([own[int(t)] for t in terms], np.int64)
            self.of.append((terms, times * weights[terms] if len(terms) else times, times * np.sqrt(weights[terms].astype(float)) if len(terms) else times.astype(float)))
        self.length = np.array([float(np.sqrt(np.dot(x, x))) for _, _, x in self.of])


def search_bucket(items: Items, weights: np.ndarray, best: Best, doc_id: np.ndarray, length: np.ndarray, owner: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> tuple[int, int]:
    """Adds what the bucket's vectors score to best; returns how many (item, vector) pairs passed the bounds, and in all.

    Items whose length times the longest vector's cannot reach what they need skip the bucket. For the others bounds
    are drawn from their heaviest coordinates: what these add up to, and for all others at most the product of the
    lengths that are left. What remains is scored in integers.
    """
    order = np.argsort(terms, kind="stable")
    terms, owner, impact = terms[order], owner[order], impact[order]
    root = np.sqrt(weights[terms].astype(float)) * impact
    names, begin = np.unique(terms, return_index=True)
    end, passed = np.r_[begin[1:], len(terms)], 0
    for q in np.flatnonzero((items.length * length.max() * SLACK >= best.least) & (items.length > 0)).tolist():
        mine, factor, x = items.of[q]
        at = np.searchsorted(names, mine)
        there = np.flatnonzero((at < len(names)) & (names[np.minimum(at, len(names) - 1)] == mine))
        if not len(there):
            continue
        lists = [(begin[i], end[i]) for i in at[there].tolist()]
        may, got, left, upto = np.ones(len(doc_id), bool), np.zeros(len(doc_id)), length**2, 0
        if best.least[q] > 0:
            for many in FOCUS:
                few = there[(there >= upto) & (there < upto + many)]
                for i in few.tolist():
                    a, b = begin[at[i]], end[at[i]]
                    got[owner[a:b]] += root[a:b] * x[i]
                    left[owner[a:b]] -= root[a:b] ** 2
                upto += many
                rest = math.sqrt(float(np.dot(x[upto:], x[upto:])))
                may &= (got + np.sqrt(np.maximum(left, length**2 * 1e-12)) * rest) * SLACK >= best.least[q]
                if not may.any():
                    break
            else:
                may &= length * items.length[q] * SLACK >= best.least[q]
        if not may.any():
            continue
        score = np.zeros(len(doc_id), np.int64)
        for (a, b), f in zip(lists, factor[there].tolist(), strict=True):
            score[owner[a:b]] += impact[a:b] * f  # a document holds a term once in its vector
        passed += int(may.sum())
        ok = np.flatnonzero(may & (score >= max(1, best.least[q])))
        if len(ok):
            best.add(q, score[ok], doc_id[ok])
    return passed, len(items.of) * len(doc_id)


def searched(vectors: DataFrame, items: Items, weights: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """item (its number), doc_id and score of each task's k best; rows of a task come with the longest vectors first."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, weights, least))

    @lean
    def search(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights, least = sent.value
        best, held, n = Best(k, least), [], 0

        def done() -> None:
            x = pd.concat(held)
            at = [np.frombuffer(t, "<i4") for t in x["terms"].tolist()]
            owner = np.repeat(np.arange(len(at)), [len(t) for t in at])
            ids = x["doc_id"].to_numpy(np.int64)
            search_bucket(items, weights, best, np.where(ids == -_LAST - 1, _LAST, ids), x["length"].to_numpy(float), owner, np.concatenate(at).astype(np.int64), np.frombuffer(b"".join(x["impacts"].tolist()), "<u4").astype(np.int64))
            held.clear()

        for x in rows:
            if len(x):
                held.append(x)
                n += len(x)
            if n >= BUCKET:
                done()
                n = 0
        if held:
            done()
        for q, (score, doc_id) in best.found.items():
            yield pd.DataFrame({"item": q, "doc_id": np.where(doc_id == _LAST, -_LAST - 1, doc_id), "score": score})

    return vectors.mapInPandas(search, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last(id_out()))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def best(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents, of equal scores those of smaller ids (null last).

    A score sums weight * impact over the item's terms, repeats included, in integers; statistics are over all documents.
    Documents become vectors over the terms of a block of items. The longest are searched first; their k-th best scores
    are what the others must reach. These are dealt out in ranges of length (and id, as copies are equally long), which
    tasks search from the longest on, a bucket at a time. No bound rules out a document that could be among the best, so
    results are those of scoring everything.

    Texts of any length are counted in segments. Null and empty texts, and items without terms, have no scores. Rows that
    repeat an id and text are documents of their own; rows of items with one id, null too, are one item. No rows come from
    an empty table on either side. Columns other than doc_id and text, item_id and text are not read.
    """
    prepared(spark)
    out = None
    for block in blocks(items.select("item_id", "text")):
        got = _block(spark, docs, block, items.schema["item_id"].dataType.simpleString(), k)
        out = got if out is None else out.unionByName(got)
    kind = items.schema["item_id"].dataType.simpleString()
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _block(spark: SparkSession, docs: DataFrame, block: list[tuple[object, Counter]], kind: str, k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(own for _, own in block))))}
    with Scratch(spark, "lexical-search") as scratch:
        rows = scratch.keep(postings(docs.select("doc_id", "text"), vocabulary))
        n_docs, n_terms = rows.where("n >= 0").agg(F.count("*"), F.sum("n")).first()
        df = document_frequencies(rows, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        asked = Items([{vocabulary[t]: many for t, many in own.items()} for _, own in block], weights)
        vectors = scratch.keep(impacts(rows, weights, n_docs, n_terms or 1))
        longest = (vectors.approxQuantile("length", [1 - LONGEST], 1 / 1024) or [0.0])[0]
        first = scratch.keep(_ranked(searched(vectors.where(F.col("length") >= longest), asked, weights, np.zeros(len(block), np.int64), k), k))
        least = np.zeros(len(block), np.int64)
        for q, score in first.where(F.col("rank") == k).select("item", "score").collect():  # a row an item of the block
            least[q] = score
        rest = vectors.where(F.col("length") < longest).repartitionByRange(F.desc("length"), "doc_id").sortWithinPartitions(F.desc("length"))
        found = _ranked(first.drop("rank").unionByName(searched(rest, asked, weights, least, k)), k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, item_id {kind}")
        return settled(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), id_out(), "score"))
