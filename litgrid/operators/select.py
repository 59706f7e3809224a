"""Greedy selection within one query's candidates: lanes, diversification, back-filling.

The greedy steps look at the rows chosen before, so each query's candidates (at most `limit` rows, pruned by rank in
Spark first) go through one pandas call; queries are spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import features


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _incidence(lists: pd.Series) -> np.ndarray:
    """A row for each list and a column for each different value: 1 where the list holds it."""
    sizes = lists.map(len).to_numpy(np.int64)
    own, column = np.repeat(np.arange(len(lists)), sizes), {}
    out = [column.setdefault(v, len(column)) for values in lists for v in values]
    found = np.zeros((len(lists), len(column)), np.float32)
    found[own, out] = 1
    return found


def _likeness(m: np.ndarray) -> np.ndarray:
    """The Jaccard likeness of all pairs of rows of an incidence; 0 where one has no values. Counts of words are exact."""
    common, size = (m @ m.T).astype(float), m.sum(1, dtype=float)
    return common / np.maximum(1, size[:, None] + size[None, :] - common)


def lanes(candidates: DataFrame, target: int = 120, limit: int = 500, redundant: float = 0.92) -> DataFrame:
    """qid, paper_id, place, reason: a protected head, then rows of each lane up to its quota, both by profile, then the
    others by preselection score, and last those whose titles are too like one of the first 30 chosen, if not sure.

    candidates: qid, paper_id, profile, rank, preselect, words (array of the title's), sure, and the lanes' columns.
    """

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        rows = x.sort_values(["rank", "paper_id"]).to_dict("records")
        n = min(target, len(rows))
        if len(rows) <= n:
            return pd.DataFrame([(r["qid"], r["paper_id"], k + 1, "pool<=target") for k, r in enumerate(rows)], columns=["qid", "paper_id", "place", "reason"])
        quota, chosen, taken = features.quotas(rows[0]["profile"], n), [], set()

        def take(r: dict, reason: str) -> None:
            taken.add(r["paper_id"])
            chosen.append((r, reason))

        for r in rows[: quota["head"]]:
            take(r, "protected_rule_head")
        best = sorted(rows, key=lambda r: -r["preselect"])  # stable: the pool's order among equals
        for lane, name in features.LANES.items():
            fit = [r for r in best if r[lane] and r["paper_id"] not in taken]
            for r in fit[: max(0, min(quota[name], n - len(chosen)))]:
                take(r, lane)
        late = []
        for r in best:
            if r["paper_id"] in taken or len(chosen) >= n:
                continue
            own = set(r["words"])
            if not r["sure"] and any(_jaccard(own, set(y["words"])) >= redundant for y, _ in chosen[:30]):
                late.append(r)
            else:
                take(r, "score_fill")
        for r in late[: n - len(chosen)]:
            take(r, "redundant_score_fill")
        return pd.DataFrame([(r["qid"], r["paper_id"], k + 1, why) for k, (r, why) in enumerate(chosen)], columns=["qid", "paper_id", "place", "reason"])

    kept = candidates.where(F.col("rank") <= limit)
    types = dict(kept.dtypes)
    return kept.groupBy("qid").applyInPandas(choose, f"qid {types['qid']}, paper_id {types['paper_id']}, place int, reason string")


def diversified(ranked: DataFrame, top_k: int = 50, gain: float = 0.025, limit: int = 120) -> DataFrame:
    """qid, paper_id, place: the first rows stay; up to top_k always the row of greatest score + gain * new constraints -
    penalty * likeness to the chosen follows, then the rest. With at most 12 rows, or a top_k of at most 10, nothing moves.

    ranked: qid, paper_id, rank, score, protected (rows that stay), penalty, words and matched (arrays), and soften, a factor
    of the likeness.
    """

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["rank", "paper_id"])
        n, place = len(x), x["rank"].to_numpy()
        stay = n if n <= 12 or top_k <= 10 else min(n, int(x["protected"].iloc[0]))
        chosen, rest = list(range(stay)), np.arange(n) >= stay
        if rest.any() and stay < top_k:
            like, new = _likeness(_incidence(x["words"])), _incidence(x["matched"])
            near = like[:, :stay].max(1, initial=0.0)
            new[:, new[:stay].any(0)] = 0
            score, weight = x["score"].to_numpy(float), (x["penalty"] * x["soften"]).to_numpy(float)
            fresh = new.sum(1, dtype=float)
            while rest.any() and len(chosen) < top_k:
                value = score + gain * fresh - weight * near
                # equal to nine digits, as Python rounds them, are only rows this close to the best
                close = np.flatnonzero(rest & (value >= value[rest].max() - 3e-9))
                best = max(close, key=lambda i: (round(float(value[i]), 9), -place[i])) if len(close) > 1 else close[0]
                rest[best] = False
                chosen.append(best)
                if new[best].any():
                    new[:, new[best] > 0] = 0
                    fresh = new.sum(1, dtype=float)
                near = np.maximum(near, like[best])
        order = np.r_[np.array(chosen, np.int64), np.flatnonzero(rest)]
        return pd.DataFrame({"qid": x["qid"].to_numpy(), "paper_id": x["paper_id"].to_numpy()[order], "place": np.arange(1, n + 1, dtype=np.int32)})

    kept = ranked.where(F.col("rank") <= limit)
    types = dict(kept.dtypes)
    return kept.groupBy("qid").applyInPandas(choose, f"qid {types['qid']}, paper_id {types['paper_id']}, place int")


def anchors(profile: Column, target: Column) -> tuple[Column, Column]:
    """How many rows keep their places, and how many of the first rows may be moved up, by profile."""
    many, one = profile.isin(*features.MANY), profile.isin(*features.ONE)
    part = lambda n: F.floor(target / n)
    stay = F.when(many, F.least(F.lit(6), F.greatest(F.lit(3), part(8)))).when(one, F.least(F.lit(8), F.greatest(F.lit(4), part(7)))).otherwise(F.least(F.lit(7), F.greatest(F.lit(4), part(7))))
    return stay, F.when(many, 500).when(one, 180).otherwise(220)


def backfilled(ranked: DataFrame, bonus: Column, k: int = 50) -> DataFrame:
    """qid, paper_id, place: anchors keep their places, then up to three rows with strong academic evidence follow by their
    academic ranks, then the others by score and bonus; with at most 12 rows nothing moves. ranked: qid, paper_id, rank,
    score, profile, r_api, r_api_snippet."""
    w = Window.partitionBy("qid")
    stay, front = anchors(F.col("profile"), F.col("target"))
    academic = (F.col("r_api") <= 50) & (F.col("r_api_snippet") <= 80)
    x = ranked.withColumn("total", F.count("*").over(w)).withColumn("target", F.least(F.lit(k), F.col("total"))).withColumn("stay", stay).withColumn("front", F.greatest(F.col("target"), front))
    x = x.withColumn("is_academic", F.coalesce(academic, F.lit(False)) & (F.col("rank") > F.col("stay")))
    x = x.withColumn("turn", F.row_number().over(w.orderBy(F.desc("is_academic"), "r_api", "r_api_snippet", "rank")))
    early = F.col("is_academic") & (F.col("turn") <= F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("target") / 12))))
    still = (F.col("rank") <= F.col("stay")) | (F.col("total") <= 12)
    x = x.withColumn("block", F.when(still, 0).when(early, 1).when(F.col("rank") <= F.col("front"), 2).otherwise(3)).withColumn("adjusted", F.round(F.col("score") + bonus, 9))
    key = [F.asc("block"), F.when(F.col("block") == 1, F.col("turn")).otherwise(0).asc(), F.when(F.col("block") == 2, -F.col("adjusted")).otherwise(0).asc(), F.when(F.col("block") == 2, -F.col("score")).otherwise(0).asc(), F.asc("rank")]
    return x.withColumn("place", F.row_number().over(w.orderBy(*key))).where(F.col("place") <= k).select("qid", "paper_id", "place")
