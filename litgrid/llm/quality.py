"""A quality classifier learned from trusted positives and unlabelled text: non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEGMENT, batches, fold_of, hashed_words, id_in, id_out, lean, prepared

#: Expected unlabelled documents to learn from, and expected trusted ones if there are more, both drawn by hash.
SAMPLE, TRUSTED = 60_000, 30_000
STEPS, RATE = 400, 0.05
THRESHOLD = 0.3
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "\"'()-:;", "#$%&*+/<=>@[\\]^_`{}~")
_KIND = np.full(256, len(_CLASSES), np.int64)
for _k, _s in enumerate(_CLASSES):
    _KIND[list(_s.encode())] = _k


def features(texts: list[str | None]) -> np.ndarray:
    """Shares of character classes, of repeated and marked words, and word and line lengths; zeros for an empty text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    out = []
    for i, j in batches(raw):
        joined = b"\n".join(raw[i:j]) + b"\n"
        size = np.array([len(t) + 1 for t in raw[i:j]])
        ends, kinds = np.cumsum(size), len(_CLASSES) + 1
        n = np.maximum(size - 1, 1)
        share, run, before = np.zeros((j - i) * kinds), np.zeros(j - i), -1
        for at in range(0, len(joined), SEGMENT):  # a long text never has columns of its own length
            code = np.frombuffer(joined, np.uint8, min(SEGMENT, len(joined) - at), at)
            kind, doc = _KIND[code], np.searchsorted(ends, np.arange(at, at + len(code)), "right")
            share += np.bincount(doc * kinds + kind, minlength=len(share))
            run += np.bincount(doc, np.r_[code[0] == before, code[1:] == code[:-1]] & (kind != 3), j - i)
            before = code[-1]
        share = share.reshape(j - i, -1)
        share[:, 4] -= 1  # the line end put after each text
        lines = share[:, 4] + 1
        words, start, end = hashed_words(joined)
        at = np.searchsorted(ends, start, "right")
        m = np.maximum(np.bincount(at, minlength=j - i), 1)
        marked = np.isin(_KIND[np.frombuffer(joined, np.uint8)[end - 1]], (7, 10))
        again = np.r_[False, (words[1:] == words[:-1]) & (at[1:] == at[:-1])]
        pairs = np.unique(np.stack([at.astype(np.uint64), words], 1), axis=0) if len(words) else np.zeros((0, 2), np.uint64)
        different = np.bincount(pairs[:, 0].astype(np.int64), minlength=j - i)
        length = np.bincount(at, end - start, j - i) / m
        out.append(np.column_stack([
            share / n[:, None], run / n, np.bincount(at, marked, j - i) / m, np.bincount(at, again, j - i) / m,
            np.minimum(1, different / m ** 0.8), np.log1p(m), np.log1p(length), np.log1p(m / lines),
        ]) * (size[:, None] > 1))
    return np.concatenate(out) if out else np.zeros((0, len(_CLASSES) + 8))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Model:
    """A logistic model of standardised features and their squares."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.w = np.zeros(2 * x.shape[1] + 1)

    def made(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z / 3, np.ones((len(z), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.made(x) @ self.w)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Model:
        """Without a prior, positives against unlabelled; with one, the non-negative risk by Adam steps:
        prior E_p[l(f)] + max(0, E_u[l(-f)] - prior E_p[l(-f)]), l logistic. Where the second part is below zero
        only its own gradient is followed, upwards."""
        p, u = self.made(positive), self.made(unlabelled)
        m = v = np.zeros_like(self.w)
        for step in range(1, STEPS + 1):
            fp, fu = p @ self.w, u @ self.w
            up, down, rest = -(p * _sigmoid(-fp)[:, None]).mean(0), (p * _sigmoid(fp)[:, None]).mean(0), (u * _sigmoid(fu)[:, None]).mean(0)
            if prior is None:
                g = up + rest
            elif np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean() >= 0:
                g = prior * up + rest - prior * down
            else:
                g = -(rest - prior * down)
            g = g + 1e-4 * self.w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w = self.w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled text, from scores: the least ratio of the parts of both above a threshold, each
    with its sampling error. Where scores are highest the unlabelled are positives, so the ratio there is the share."""
    at = np.quantile(np.r_[positive, unlabelled], np.linspace(0.0, 0.98, 99))
    p, u = ((x[None, :] >= at[:, None]).mean(1) for x in (positive, unlabelled))
    bound = (u + np.sqrt(np.log(20) / (2 * len(unlabelled))) + np.sqrt(np.log(20) / (2 * len(positive)))) / np.maximum(p, 1e-9)
    k = int(np.argmin(np.where(p > 0.02, bound, np.inf)))
    return float(np.clip(u[k] / max(p[k], 1e-9), 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, trusted: int = TRUSTED) -> tuple[Model | None, float]:
    """The model and the prior. Unlabelled text: about `sample` documents of those to learn from, whatever their labels.
    Positives: all trusted documents, or about `trusted` of them if there are more, however rare they are among all.
    Fewer than two of either give no model."""
    rows = docs.where(learn).select("doc_id", "text")
    positives = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    n, m = rows.count(), positives.count()
    if not n or not m:
        return None, 0.5
    part = lambda x, share: F.pmod(x, F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20))
    # bounded by the parameter, with room for chance
    chosen = positives.where(part(F.xxhash64("doc_id", F.lit(7)), trusted / m)).withColumn("trusted", F.lit(True))
    drawn = rows.withColumn("drawn", part(F.xxhash64("doc_id", "text"), sample / n)).join(F.broadcast(chosen), "doc_id", "left").where("drawn or trusted")

    @lean
    def measure(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batch:
            yield pd.DataFrame({"x": list(features(x["text"].tolist())), "drawn": x["drawn"].to_numpy(bool), "trusted": x["trusted"].notna().to_numpy(bool)})

    found = drawn.select("text", "drawn", "trusted").mapInPandas(measure, "x array<double>, drawn boolean, trusted boolean").toPandas()
    every = np.stack(found["x"].tolist()) if len(found) else np.zeros((0, 1))
    x, positive = (every[found[k].to_numpy(bool)] for k in ("drawn", "trusted"))
    if min(len(positive), len(x)) < 2:
        return None, 0.5
    half = Model(x).fit(positive[::2], x[::2], None)
    prior = class_prior(half.scores(positive[1::2]), half.scores(x[1::2]))
    return Model(x).fit(positive, x, prior), prior


def predict(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every document; learns only from all folds but 0. Labels enter as trusted positives alone.

    Null and empty texts have features of zero and are scored like any other. Without positives all scores are 0.5. Null
    and repeated ids are scored row by row (a null id is neither learned from nor held out); repeated labels count once.
    An empty table gives no rows; other columns are not used. Columns: doc_id, held_out, score, predicted.
    """
    prepared(spark)
    model, _ = train(docs, labels, F.coalesce(fold_of("doc_id") != 0, F.lit(False)))

    @lean
    def judge(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batch:
            yield pd.DataFrame({"doc_id": x["doc_id"], "score": model.scores(features(x["text"].tolist())) if model else np.full(len(x), 0.5)})

    found = docs.select(id_in("doc_id"), "text").mapInPandas(judge, "doc_id long, score double").withColumn("doc_id", id_out())
    return found.select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
