"""Removal of repeated substrings: merged count-min sketches of partitions, then exact grouping of windows they leave."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, batches, hashed_words, id_in, id_out, lean, prepared, runs, settled, words_of

#: Words of a window, and of the anchor within it that the sketch counts.
WINDOW, ANCHOR = 20, 10
#: Binary logarithms of the cells of a row of the sketch, by the size of the texts, and of a slice; rows of the sketch.
LEAST_BITS, MOST_BITS, SLICE_BITS, ROWS = 18, 29, 16, 2
#: Anchors that a task counts at once, and windows among which it settles what starts first.
COUNTED, SETTLED = 1 << 20, 1 << 20
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` successive words, by doubling: each step joins two runs of half the length."""
    out, have = hashes, 1
    for bit in bin(size)[3:]:
        out, have = out[: len(out) - have] * _MIX + out[have:] if len(out) > have else out[:0], have * 2
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        if bit == "1":
            out, have = out[: max(0, len(out) - 1)] * _MIX + hashes[have:] if len(hashes) > have else out[:0], have + 1
            out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out


def word_runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: the place of the first, all their words' hashes, and where each text's words begin."""
    for i, j in batches(texts):
        yield i, *words_of(texts[i:j])


def anchors(hashes: np.ndarray, at: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, the place of each one's anchor, and the hashes of all runs of `size`.

    A window's anchor is that of its runs with the least hash, the first such: it depends on its words only. Equal windows
    at different places have anchors at different places, so an anchor stands there at least as often as such a window.
    """
    run, n = runs(hashes, size), len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), run
    place, low = np.arange(n), run[:n].copy()
    for k in range(1, window - size + 1):
        less = np.flatnonzero(run[k : k + n] < low)
        low[less], place[less] = run[less + k], less + k
    starts = np.flatnonzero(np.repeat(at[1:], np.diff(at))[:n] - np.arange(n) >= window)
    return starts, place[starts], run


def cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch."""
    return [((anchor >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - bits) for k in range(ROWS)]


def sketch(docs: DataFrame, bits: int, window: int, size: int) -> list[np.ndarray]:
    """For each row of the sketch a bit a cell: whether all documents' anchors count to two or more there.

    A task adds up the cells it meets, slice by slice, and a slice's parts are merged wherever it is dealt to. A merged
    counter is never less than an anchor's count, so a window without the bits stands in the documents once.
    """
    slices = 1 << max(0, bits - SLICE_BITS)
    low = (1 << SLICE_BITS) - 1

    @lean
    def count(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def out() -> Iterator[pd.DataFrame]:
            for k, cell in enumerate(cells(np.concatenate(held), bits)):
                cell, times = np.unique(cell, return_counts=True)
                edges = np.searchsorted(cell, np.arange(slices + 1) << SLICE_BITS).tolist()
                once, again = (cell & low).astype("<u2"), times > 1
                found = [(k * slices + i, once[a:b].tobytes(), once[a:b][again[a:b]].tobytes()) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                for i in range(0, len(found), 2000):
                    yield pd.DataFrame(found[i : i + 2000], columns=["slice", "once", "again"])
            held.clear()

        for x in rows:
            for _, hashes, at in word_runs(list(map(bytes, x["text"].tolist()))):
                _, place, run = anchors(hashes, at, window, size)
                if len(place):
                    held.append(run[np.unique(place)])
                    n += len(held[-1])
                if n >= COUNTED:
                    yield from out()
                    n = 0
        if held:
            yield from out()

    @lean
    def merge(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for x in rows:
            for i, once, again in zip(x["slice"].tolist(), x["once"].tolist(), x["again"].tolist(), strict=True):
                counts = total.setdefault(i, np.zeros(low + 1, np.uint8))  # 0, 1, or 2 for more
                once = np.frombuffer(once, "<u2")
                counts[once] = np.minimum(counts[once] + 1, 2)
                counts[np.frombuffer(again, "<u2")] = 2
        for i, counts in total.items():
            yield pd.DataFrame([(i, np.packbits(counts == 2).tobytes())], columns=["slice", "bits"])

    parts = docs.mapInPandas(count, "slice int, once binary, again binary")
    merged = parts.repartition("slice").mapInPandas(merge, "slice int, bits binary")
    table = np.zeros((ROWS, slices, (low + 1) // 8), np.uint8)
    for i, found in merged.toLocalIterator(prefetchPartitions=True):  # as many bytes as the sketch has, whatever the documents
        table[i // slices, i % slices] = np.frombuffer(found, np.uint8)
    return [row.ravel() for row in table]


def repeated(hashes: np.ndarray, at: np.ndarray, table: list[np.ndarray], bits: int, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that the sketch estimates to stand in the documents twice or more."""
    starts, place, run = anchors(hashes, at, window, size)
    if not len(starts):
        return starts, run[:0]
    places, own = np.unique(place, return_inverse=True)
    often = np.ones(len(places), bool)
    for row, cell in zip(table, cells(run[places], bits), strict=True):
        often &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    starts = starts[often[own]]
    return starts, windows(hashes, window)[starts] if len(starts) else run[:0]


def _ranges(starts: np.ndarray) -> np.ndarray:
    """Ascending starts as first, last, first, last, ... of their runs."""
    if not len(starts):
        return starts
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.stack([starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]], 1).ravel()


def without(text: bytes, gone: list[np.ndarray], window: int) -> tuple[int, int, str]:
    """Words, words that windows cover (given as ranges of starts), and the other words, one space between them, hashed."""
    _, start, end = hashed_words(text)
    n = len(start)
    edge = np.zeros(n + 1, np.int64)
    for x in gone:
        np.add.at(edge, x[0::2], 1)
        np.add.at(edge, x[1::2] + window, -1)
    stays = np.cumsum(edge[:-1]) == 0
    digest, raw = hashlib.sha256(), memoryview(text)
    first = True
    for i in range(0, n, 1 << 16):
        own = np.flatnonzero(stays[i : i + (1 << 16)]) + i
        part = b" ".join([raw[a:b] for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)])
        if len(own):
            digest.update(part if first else b" " + part)
            first = False
    return n, n - int(stays.sum()), digest.hexdigest()


def later(docs: DataFrame, table: list[np.ndarray], bits: int, window: int, size: int) -> DataFrame:
    """doc_id, key and ranges of starts of windows whose words also start earlier; docs has doc_id, key and text.

    Among about SETTLED windows at a time a task knows which start later than another; of each window only its first
    start there is dealt out by hash, and marked if another task has an earlier one. So a window that a third of all
    documents share makes a row for each of these turns, and no join.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((table, bits))

    @lean
    def first(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (table, bits), held, n = sent.value, [], 0

        def out() -> Iterator[pd.DataFrame]:
            held.sort(key=lambda x: (x[0] == NULL_ID, x[0], x[1]))
            begin = np.r_[0, np.cumsum([len(x[2]) for x in held])].tolist()
            starts, hashes = (np.concatenate([x[k] for x in held]) for k in (2, 3))
            leads = np.zeros(len(hashes), bool)
            leads[np.unique(hashes, return_index=True)[1]] = True  # the first of each hash, as places ascend
            many = []
            for k, (i, key, own, _) in enumerate(held):
                a, b = begin[k], begin[k + 1]
                if k and held[k - 1][:2] == (i, key):  # a repeated row starts its windows where the other does, not later
                    leads[a:b] = leads[begin[k - 1] : a]
                elif not leads[a:b].all():
                    many.append((i, key, 0, -1, _ranges(own[~leads[a:b]]).astype("<i8").tobytes()))
            own = np.repeat(np.arange(len(held)), np.diff(begin))
            ids, keys = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
            yield pd.DataFrame(many, columns=["doc_id", "key", "hash", "start", "ranges"])
            to = np.flatnonzero(leads)
            for k in range(0, len(to), 50_000):
                x = to[k : k + 50_000]
                yield pd.DataFrame({"doc_id": ids[own[x]], "key": keys[own[x]], "hash": hashes[x].view(np.int64), "start": starts[x], "ranges": None})
            held.clear()

        for x in rows:
            ids, keys = x["doc_id"].tolist(), x["key"].tolist()
            for i, hashes, at in word_runs(list(map(bytes, x["text"].tolist()))):
                starts, found = repeated(hashes, at, table, bits, window, size)
                cut = np.searchsorted(starts, at).tolist()
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if a < b:
                        held.append((ids[i + k], keys[i + k], starts[a:b] - at[k], found[a:b]))
                n += len(starts)
                if n >= SETTLED:
                    yield from out()
                    n = 0
        if held:
            yield from out()

    with Scratch(spark, "windows") as scratch:
        found = scratch.keep(docs.mapInPandas(first, "doc_id long, key long, hash long, start long, ranges binary"))
        leads = found.where("start >= 0").select(id_out(), "key", "hash", "start")
        place = F.rank().over(Window.partitionBy("hash").orderBy(F.asc_nulls_last("doc_id"), "key", "start"))
        after = leads.withColumn("place", place).where("place > 1").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "key", "start")
        starts = after.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("start")).alias("starts"))
        known = found.where("start < 0").groupBy("doc_id", "key").agg(F.collect_list("ranges").alias("ranges"))
        return settled(starts.join(known, ["doc_id", "key"], "full"))


def kept(spark: SparkSession, docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words that stay, one space between them) of each row of docs.

    A word goes if it lies in a window of that many words whose words also start earlier: in a document of a smaller id,
    or before it in the same one. Null ids come after all others; of different texts under one id that of the smaller
    hash comes first; of rows that repeat both id and text one is a document and the others are copies of it. Windows are
    judged on the texts as they are given. Null and empty texts have no words. Texts of any length are read whole: their
    words, and the starts of their repeated windows, are what a task holds of them. An empty table gives no rows. No other
    column is read.

    First pass: a count-min sketch of anchors (runs of ANCHOR words, the least by hash of each window), two rows of up
    to 2 ** MOST_BITS cells by the size of the texts. It rules out windows that stand once, and never one that stands
    twice. Second pass: the others are grouped by a 64-bit hash of all their words. Texts that hold any of these windows
    meet their starts by a shuffle; all others are settled in the task that reads them. A larger corpus than the sketch
    has cells for loses nothing: the second pass then groups more windows.
    """
    prepared(spark)
    key = F.xxhash64("text").alias("key")
    rows = docs.select(id_in(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).select("doc_id", key, "text")
    size = min(ANCHOR, window)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(total / 12).bit_length()))
    table = sketch(rows, bits, window, size)
    found = later(rows, table, bits, window, size)
    sent = spark.sparkContext.broadcast((table, bits))

    @lean
    def parted(x: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bits = sent.value
        for part in x:
            out, texts, often = [], list(map(bytes, part["text"].tolist())), []
            for _, hashes, at in word_runs(texts):
                often += np.diff(np.searchsorted(repeated(hashes, at, table, bits, window, size)[0], at)).tolist()
            for i, k, text, some in zip(part["doc_id"].tolist(), part["key"].tolist(), texts, often, strict=True):
                out.append((i, k, 0, 0, None, text) if some else (i, k, *without(text, [], window), None))
            yield pd.DataFrame(out, columns=["doc_id", "key", "n_words", "n_removed", "kept_sha256", "text"])

    @lean
    def cut(x: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in x:
            out = []
            for i, n, text, again, starts, ranges, *done in zip(*(part[c].tolist() for c in ("doc_id", "n_words", "text", "copy", "starts", "ranges", "n_removed", "kept_sha256")), strict=True):
                if text is None:
                    out.append((i, n, *done))
                    continue
                gone, text = [np.frombuffer(r, "<i8") for r in (ranges if ranges is not None else [])], bytes(text)
                if starts is not None:
                    gone.append(_ranges(np.asarray(starts, np.int64)))
                if again > 1:  # a copy is later as a whole; its text holds a window
                    gone = [np.array([0, len(hashed_words(text)[0]) - window])]
                out.append((i, *without(text, gone, window)))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    # texts whose windows are all settled send their result, not the text
    each = rows.mapInPandas(parted, "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, text binary").join(found, ["doc_id", "key"], "left")
    each = each.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(F.lit(0))))
    done = each.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return settled(done.withColumn("doc_id", id_out()))
