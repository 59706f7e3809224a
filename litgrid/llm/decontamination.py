"""Benchmark decontamination: a BM25 index of test items, queried by every passage with block-max WAND."""

from __future__ import annotations

import copy
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, batches, hashed_words, id_in, id_out, lean, prepared, settled

K1, B = 1.2, 0.75
#: Postings of a block, each with its largest impact.
BLOCK = 32
#: Words of a passage, and from one passage to the next: any text of up to the difference lies whole in one passage. For
#: longer items both are doubled until the item fits.
PASSAGE, STEP = 128, 48
#: Least share of an item's own BM25 score that a passage must reach.
THRESHOLD = 0.5
#: Least share of the question's and of the answer's words that stand in order and together in the passage.
OVERLAP = 0.6
#: Items of one index, about; more items are further indexes, each of which all passages query.
ITEMS = 50_000
_PLAIN = bytes.maketrans((string.ascii_uppercase + string.punctuation).encode(), (string.ascii_lowercase + " " * len(string.punctuation)).encode())


def plain(text: str | None) -> bytes:
    """Lower case, and ASCII punctuation as spaces."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN)


def pairs(words: np.ndarray) -> np.ndarray:
    """The index' terms: hashes of every two successive words."""
    return words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]


def item_pairs(text: str) -> np.ndarray:
    return pairs(hashed_words(plain(text))[0])


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer follows `answer:`, else a question mark, else it is the last sentence; it may be empty."""
    for mark in (r"(?i)\banswer\s*:", r"\?", r"[.!](?=\s+\S)"):
        if found := list(re.finditer(mark, text)):
            at = found[-1].end()
            if text[at:].strip():
                return text[:at], text[at:]
    return text, ""


class Index:
    """Inverted lists of the items' word pairs. A posting's impact is its share of what the item itself would score.

    Single words would not do: passages of 128 common words reach half of a short item's score.
    """

    def __init__(self, ids: list[int], texts: list[str], over: tuple[int, float, dict[int, int]] | None = None):
        """over: number of all items, their mean word pairs, and how many hold each pair, where these are some of them."""
        words = [item_pairs(t) for t in texts]
        keep = [k for k, w in enumerate(words) if len(w)]
        self.block = BLOCK
        self.ids, self.texts = np.array([ids[k] for k in keep], np.int64), [texts[k] for k in keep]
        words = [words[k] for k in keep]
        if not words:
            self.vocabulary = np.zeros(0, np.uint64)
            return
        n = np.array([len(w) for w in words])
        item = np.repeat(np.arange(len(words)), n)
        pair, tf = np.unique(np.stack([np.concatenate(words), item.astype(np.uint64)], 1), axis=0, return_counts=True)
        self.vocabulary, at, df = np.unique(pair[:, 0], return_index=True, return_counts=True)
        many, mean, held = over or (len(words), n.mean(), dict(zip(self.vocabulary.tolist(), df.tolist(), strict=True)))
        each = np.array([held[x] for x in self.vocabulary.tolist()], float)
        idf = np.log1p((many - each + 0.5) / (each + 0.5))
        item = pair[:, 1].astype(np.int64)
        score = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[item] / mean))
        self.length = n + 1
        self._fill(score / np.bincount(item, score, len(words))[item], item, at)
        self.split = []
        for t in self.texts:
            q, a = question_and_answer(t)
            self.split.append((hashed_words(plain(q))[0], hashed_words(plain(a))[0]))

    def _fill(self, impact: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        """Postings ordered by term, then item; at: where each term's begin."""
        self.impact, self.item, self.at = impact, item, np.r_[at, len(item)]
        self.top = np.maximum.reduceat(impact, at)
        self.blocks = [np.array([impact[i : min(i + BLOCK, b)].max() for i in range(a, b, BLOCK)]) for a, b in zip(at, self.at[1:], strict=True)]

    def by_length(self) -> list[tuple[int, int, Index]]:
        """Passage, step and the items that need them, with the same impacts: an item's words lie whole in one of the passages."""
        if not len(self.vocabulary):
            return []
        times = np.ones(len(self.length), np.int64)
        while (short := self.length > times * (PASSAGE - STEP)).any():
            times[short] *= 2
        found, term = [], np.repeat(np.arange(len(self.vocabulary)), np.diff(self.at))
        for k in np.unique(times).tolist():
            own, part = times[self.item] == k, copy.copy(self)
            used, at = np.unique(term[own], return_index=True)
            part.vocabulary = self.vocabulary[used]
            part._fill(self.impact[own], self.item[own], at)
            found.append((PASSAGE * k, STEP * k, part))
        return found

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items whose summed impacts over these distinct terms reach the threshold, by block-max WAND.

        Lists are ordered by their next item. The pivot is the first list at which the lists' largest impacts together
        reach the threshold: no earlier item can. Where the current blocks' largest impacts cannot reach it either, the
        lists move past the nearest block end, else the pivot item is scored.
        """
        lists = [[self.at[t], self.at[t + 1], t, self.at[t]] for t in terms.tolist()]  # position, end, term, start
        found = []
        while lists:
            lists.sort(key=lambda x: self.item[x[0]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += self.top[x[2]]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = self.item[lists[pivot][0]]
            while pivot + 1 < len(lists) and self.item[lists[pivot + 1][0]] == item:
                pivot += 1
            for x in lists[:pivot]:
                x[0] += int(np.searchsorted(self.item[x[0] : x[1]], item))
            here = [x for x in lists[: pivot + 1] if x[0] < x[1]]
            blocks = [(x, (x[0] - x[3]) // self.block) for x in here]
            if sum(self.blocks[x[2]][b] for x, b in blocks) < threshold - 1e-9:
                # no item up to the nearest block end can reach it, nor before the next list's item
                ends = [self.item[min(x[3] + (b + 1) * self.block, x[1]) - 1] + 1 for x, b in blocks]
                to = min([*ends, *(self.item[x[0]] for x in lists[pivot + 1 :][:1])])
                for x in here:
                    x[0] += int(np.searchsorted(self.item[x[0] : x[1]], max(to, item + 1)))
            else:
                score = sum(self.impact[x[0]] for x in here if self.item[x[0]] == item)
                if score >= threshold - 1e-9:
                    found.append((int(item), float(score)))
                for x in here:
                    x[0] += int(self.item[x[0]] == item)
            lists = [x for x in lists if x[0] < x[1]]
        return found


def covered(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the part's words within word pairs that the passage has too; of the words if it is one word."""
    if len(part) < 2:
        return float(np.isin(part, passage).mean()) if len(part) else 1.0
    hit = np.isin(pairs(part), pairs(passage))
    return float((np.r_[hit, False] | np.r_[False, hit]).mean())


def windows(a: int, b: int, passage: int = PASSAGE, step: int = STEP) -> list[tuple[int, int]]:
    return [(i, min(i + passage, b)) for i in range(a, max(a + 1, b - passage + step), step)]


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold test items: a row for each document and item, with the passage that matches best.

    Terms are pairs of successive words, lower case without ASCII punctuation. A document's passages are 128 words, 48 apart, for
    items of up to 80 words; both are doubled for items of up to 160, 320 and so on, so that a verbatim copy of any item
    lies whole in a passage wherever it starts. A passage whose words' largest impacts together miss the threshold is
    passed over at once, which is WAND's own bound; the others search the index. A hit counts if the question's and the answer's words are found by word pairs.

    The index holds about ITEMS items and goes to each task; beyond that there are several indexes, one after the other,
    under the same statistics of all items, so that scores do not depend on how items are dealt out. Null or empty texts
    and items of fewer than two words match nothing; ids of documents and of items may be null or repeated (a row each, by
    row); equal items match alike. Very long texts are gone through passage by passage. Empty tables give no rows; other
    columns are not used.

    Columns: doc_id, item_id, score, question_overlap, answer_overlap, start and end (bytes of the normalised text).
    """
    prepared(spark)
    own = items.select(F.coalesce(F.col(item_id).cast("long"), F.lit(NULL_ID)).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    parts = max(1, -(-own.count() // ITEMS))
    rows = docs.select(id_in(id_col), F.col(text_col).alias("text")).where("text is not null")
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    if parts == 1:
        found = _query(rows, _index(own.collect()), threshold, overlap)
        return found.withColumns({"doc_id": id_out(), "item_id": id_out("item_id")})
    each = settled(own.withColumn("part", part).mapInPandas(_pairs, "part int, pair long, n long"))
    held = settled(each.where("pair is not null").groupBy("pair").agg(F.count("*").alias("df")))
    many, mean = each.where("pair is null").agg(F.count("*"), F.avg("n")).first()
    found = None
    for k in range(parts):
        some = held.join(each.where((F.col("part") == k) & F.col("pair").isNotNull()).select("pair").distinct(), "pair", "left_semi").collect()
        over = (many, mean, {r["pair"] & (1 << 64) - 1: r["df"] for r in some})
        one = _query(rows, _index(own.where(part == k).collect(), over), threshold, overlap)
        found = one if found is None else found.union(one)
    return found.withColumns({"doc_id": id_out(), "item_id": id_out("item_id")})


def _pairs(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """part and pair for each different word pair of an item, and one row without a pair, with the number of its pairs."""
    for x in batch:
        for part, text in zip(x["part"].tolist(), x["text"].tolist(), strict=True):
            if len(own := item_pairs(text)):
                yield pd.DataFrame({"part": part, "pair": np.unique(own).view(np.int64), "n": 0}).astype({"pair": "Int64"})
                yield pd.DataFrame({"part": [part], "pair": pd.array([None], "Int64"), "n": [len(own)]})


def _index(rows: list, over: tuple | None = None) -> Index:
    rows = sorted(rows, key=lambda r: (r["item_id"], r["text"]))
    return Index([r["item_id"] for r in rows], [r["text"] for r in rows], over)


def _query(rows: DataFrame, index: Index, threshold: float, overlap: float) -> DataFrame:
    parts = index.by_length()

    @lean
    def query(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batch:
            ids, raw, out = x["doc_id"].tolist(), [plain(t) for t in x["text"]], []
            for i, j in batches(raw):
                joined = b"\n".join(raw[i:j])
                words, start, end = hashed_words(joined)
                begin = np.r_[0, np.cumsum([len(t) + 1 for t in raw[i:j]])]
                at = np.searchsorted(start, begin)
                all_terms = pairs(words)  # a passage of words u to v has the terms u to v - 1
                for passage, step, index in parts:
                    top = np.r_[index.top, 0.0]
                    place = np.minimum(np.searchsorted(index.vocabulary, all_terms), len(index.vocabulary) - 1)
                    term = np.where(index.vocabulary[place] == all_terms, place, len(index.vocabulary))
                    bound = np.r_[0.0, np.cumsum(top[term])]
                    for k in range(j - i):
                        a, b = int(at[k]), int(at[k + 1])
                        if b - a < 2 or bound[b - 1] - bound[a] < threshold - 1e-6:
                            continue
                        best: dict[int, tuple] = {}
                        for u, v in windows(a, b, passage, step):
                            if bound[max(u, v - 1)] - bound[u] < threshold - 1e-6:
                                continue
                            terms = np.unique(term[u : v - 1])
                            terms = terms[terms < len(index.vocabulary)]
                            if top[terms].sum() < threshold - 1e-6:
                                continue
                            for item, score in index.search(terms, threshold):
                                question, answer = (covered(p, words[u:v]) for p in index.split[item])
                                if min(question, answer) >= overlap and (item not in best or score > best[item][0]):
                                    best[item] = (score, question, answer, int(start[u] - begin[k]), int(end[v - 1] - begin[k]))
                        out += [(ids[i + k], int(index.ids[item]), *found) for item, found in best.items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "start", "end"])

    return rows.mapInPandas(query, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, start long, end long")
