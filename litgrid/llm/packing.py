"""Packing token sequences into fixed windows: non-negative least squares over shallow length combinations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tokens, id_in, id_out, lean, new_path, prepared

STEPS = 200
#: Tasks that tokenize, at most. Each later has a row of up to a window's number of ranks (some 25 KB for 2,048), and these
#: rows are broadcast, at most 200 MB.
TASKS = 8192


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Every pair and triple of the lengths that fills the window, ascending; a pair has 0 as its first length."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    found = []
    for a in [0, *lengths[lengths <= window // 3].tolist()]:
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        b = b[there[b] & there[window - a - b]]
        found.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def repeats(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to use each combination: min |A x - counts|^2 over x >= 0, by accelerated projected gradients."""
    if not len(combos):
        return np.zeros(0)
    target = counts.astype(float)
    target[0] = 0
    real = (combos > 0).astype(float)

    def made(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, k], x * real[:, k], len(target)) for k in range(3))
        return out

    degree = made(np.ones(len(combos)))
    bound = np.maximum((degree[combos] * real).sum(1), 1)  # row sums of A'A: a step for each variable
    x = y = (target[combos] / np.maximum(degree[combos], 1) + np.where(real > 0, 0, np.inf)).min(1)
    t = 1.0
    for _ in range(steps):
        gap = made(y) - target
        new = np.maximum(0, y - (gap[combos] * real).sum(1) / bound)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (before - 1) / t * (new - x)
    return x


def plan(counts: np.ndarray, window: int) -> dict[str, np.ndarray | int]:
    """Places for counts[l] pieces of each length l under the window.

    The least-squares repeats are rounded up as far as pieces remain, the largest first. What then remains is packed
    greedily, one length after the other, cut where a window is full. Size: about window squared / 12 places at most.
    """
    combos = combinations(np.flatnonzero(counts[:window]), window)
    x = repeats(combos, counts)
    left = counts.astype(np.int64).tolist()
    left[0] = 0
    used, places, sequence = [0] * window, [], 0
    for j in np.argsort(-x, kind="stable").tolist():
        parts = combos[j].tolist()
        own = [p for p in parts if p]
        most = min(left[p] // own.count(p) for p in own)
        n = min(most, int(np.ceil(x[j] - 1e-6)))
        if n <= 0:
            continue
        offset = 0
        for p in own:
            places.append((p, used[p], sequence, offset))
            used[p] += n
            left[p] -= n
            offset += p
        sequence += n
    places = np.array(sorted(places), np.int64).reshape(-1, 4)
    lengths = np.arange(window)
    stream = np.r_[0, np.cumsum(np.array(left) * lengths)]
    return {
        "key": places[:, 0] * (1 << 44) + places[:, 1], "sequence": places[:, 2], "offset": places[:, 3], "rank": places[:, 1],
        "used": np.array(used, np.int64), "stream": stream[:-1].astype(np.int64), "first": sequence, "after": sequence + int(-(-stream[-1] // window)),
    }


def place(made: dict, window: int, length: int, rank: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, length) of the one or two parts of the rank-th piece of this length."""
    if rank < made["used"][length]:
        k = int(np.searchsorted(made["key"], length * (1 << 44) + rank, "right")) - 1
        return [(int(made["sequence"][k]) + rank - int(made["rank"][k]), int(made["offset"][k]), length)]
    at = int(made["stream"][length]) + (rank - int(made["used"][length])) * length
    room = min(length, window - at % window)
    parts = [(made["first"] + at // window, at % window, room)]
    return parts + [(made["first"] + at // window + 1, 0, length - room)] * (room < length)


def tokenized(docs: DataFrame, path: str, vocabulary: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Writes the ids of each text, with what a global ranking needs: its task, and ranks among the task's rows."""

    @lean
    def encode(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, task = Tokens.of(vocabulary), TaskContext.get().partitionId()
        seen, full, end = np.zeros(window, np.int64), 0, np.uint32(end_id).astype("<u4").tobytes()
        for x in rows:
            out = []
            for i, ids in zip(x["doc_id"], tokens.encode(x["text"].tolist()), strict=True):
                n = len(ids) // 4 + 1
                rest = n % window
                out.append((i, n, rest, task, int(seen[rest]), full, ids + end))
                seen[rest] += 1
                full += n // window
            yield pd.DataFrame(out, columns=["doc_id", "n", "rest", "task", "rank", "whole", "ids"])

    plain = docs.select(id_in(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).coalesce(TASKS)
    plain.mapInPandas(encode, "doc_id long, n long, rest int, task int, rank long, whole long, ids binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs texts into sequences of at most `window` tokens; one row per piece, with its ids.

    A text's ids are the tokenizer's and then end_id. Whole windows of a text are sequences of their own. What remains
    of each text is counted by length (a histogram of `window` numbers, whatever the input), non-negative least squares
    choose how often each pair or triple of lengths fills a window, and residual pieces are packed greedily with cuts.
    Only the last sequence is not full. The ids are written once to the shared folder and read back with their places; they
    are never shuffled. Beyond TASKS input partitions a task reads several. A very long text is one row and one call of the
    tokenizer, cut into as many pieces as it has windows.

    Null texts count as empty (one piece with end_id alone). Repeated rows and repeated or null ids are packed row by
    row. An empty table gives no rows. Other columns are not used. Columns: doc_id, start (ids of the text before the
    piece), length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit integers).
    """
    prepared(spark)
    rows = tokenized(docs, new_path(spark, "packing"), vocabulary, end_id, window, id_col, text_col)
    counts = np.zeros(window, np.int64)
    for r in rows.groupBy("rest").count().collect():
        counts[r["rest"]] = r["count"]
    made = plan(counts, window)

    # one row for each task: windows before it, and for each rest the pieces before it
    by_task = rows.groupBy("task").agg(F.sum(F.expr(f"n div {window}")).alias("whole_n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("task", F.coalesce(F.sum("whole_n").over(before), F.lit(0)).alias("whole_base"))
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("task", "rest").count().select("task", F.struct("rest", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")).alias("x"))
    base = base.groupBy("task").agg(F.map_from_entries(F.collect_list("x")).alias("bases")).join(by_task, "task")

    @lean
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i, n, rest, rank, whole, ids in zip(x["doc_id"], x["n"], x["rest"], x["rank"] + x["rank_base"], x["whole"] + x["whole_base"], x["ids"], strict=True):
                for k in range(n // window):
                    out.append((i, k * window, window, n, made["after"] + whole + k, 0, ids[k * window * 4 : (k + 1) * window * 4]))
                at = n - rest
                for sequence, offset, length in place(made, window, rest, rank) if rest else []:
                    out.append((i, at, length, n, sequence, offset, ids[at * 4 : (at + length) * 4]))
                    at += length
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    ranked = rows.join(F.broadcast(base), "task").withColumn("rank_base", F.element_at("bases", F.col("rest"))).drop("bases")
    found = ranked.mapInPandas(pieces, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return found.withColumn("doc_id", id_out())
