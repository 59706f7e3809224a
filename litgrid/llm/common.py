"""Helpers that several training-data operators share: settings, shared tables, folds, word hashing and tokenizing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import json
import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of an Arrow batch, which keep a Python worker small: rows, and bytes (one text may exceed them).
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20
#: Bytes that the word hasher treats at once.
SEGMENT = 1 << 18
_UNSET = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(ARROW_ROWS)), "spark.sql.execution.arrow.maxBytesPerBatch": ("268435456b", str(ARROW_BYTES))}
_made: list[str] = []


def prepared(spark: SparkSession) -> SparkSession:
    """Small Arrow batches where the session has Spark's own bounds, and a checkpoint folder.

    The bounds stay, as results are computed later than operators return; a session that sets its own keeps them.
    """
    for key, (usual, own) in _UNSET.items():
        if spark.conf.get(key, usual).lower().removesuffix("b") in (usual.removesuffix("b"), "256m"):
            spark.conf.set(key, own)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="litgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(path := f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def clean_up(spark: SparkSession) -> None:
    """Deletes the folders that operators made so far; call it once their results are stored elsewhere."""
    while _made:
        delete(spark, _made.pop())


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, for mapInPandas or mapInArrow; after its last batch the worker gives the memory it freed back to the system.

    Workers live on and serve later stages, whose memory would come on top.
    """

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    """Gives the memory that this process freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has its own ways
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: lost executors cost no recomputation."""
    prepared(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int) -> DataFrame:
    """A hint to broadcast df if it is counted to hold at most that many rows; else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def spread_join(rows: DataFrame, other: DataFrame, key: str, how: str, least: int = 200) -> DataFrame:
    """rows joined with other, which has a row for each key; how: inner or left. Keys that hold over a thousandth of the
    rows, of which there can be a thousand at most, are joined by broadcast, so that no task gets all rows of such a key."""
    n = rows.count()
    hot = F.broadcast(settled(rows.groupBy(key).count().where(F.col("count") > max(least, n // 1000)).select(key)))
    few = F.broadcast(other.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, how).union(rows.join(hot, key, "left_anti").join(other, key, how))


#: Stands for a null id inside Python workers, where pandas would turn ids beside nulls into floats.
NULL_ID = -(1 << 63)


def id_in(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID)).alias("doc_id")


def id_out(col: str = "doc_id") -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias(col)


def fold_of(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C55 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m, inverse = max(n, SEGMENT + 1), pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(m - 1, x, np.uint64)], dtype=np.uint64) for x in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every maximal run of bytes other than ASCII white space."""
    found, at = [], 0
    while at < len(text):
        to = min(len(text), at + SEGMENT)
        if to < len(text):  # cut at white space, so that no word is split
            back = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, to - at, at)])
            while not len(back) and to < len(text):
                to = min(len(text), to + SEGMENT)
                back = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, to - at, at)])
            to = at + int(back[-1]) + 1 if len(back) else len(text)
        raw = np.frombuffer(text, np.uint8, to - at, at)
        edge = np.diff(np.r_[True, _SPACE[raw], True].astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _powers(len(raw) + 1)
        total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)]
        found.append((mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start + at, end + at))
        at = to
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after the other, and where each text's words begin (one more at the end)."""
    joined = b"\n".join(texts)
    hashes, start, _ = hashed_words(joined)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    return hashes, np.r_[0, np.searchsorted(start, ends)].astype(np.int64)


def batches(texts: list[bytes], most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many bytes together."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n successive words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : m + k]
    return mixed(out)


#: Letters, numbers and white space up to U+024F, of which the pre-tokenizer makes its pieces there.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-\u024f]")


class _Ids(dict):
    """Ids of pieces. What is not known is taken from an earlier generation, or merged by the model."""

    def __init__(self, merge: Callable[[str], list], table: dict[int, int], before: dict[str, bytes]):
        self.merge, self.table, self.before = merge, table, before

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array("I", [t.id for t in self.merge(piece.encode("utf-8").decode("latin-1").translate(self.table))]).tobytes()
        self[piece] = ids
        return ids


class Tokens:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers.

    A byte-level vocabulary parts a text into pieces and merges bytes within each, so a piece's ids can be kept. Texts with
    characters up to U+024F only are parted here by the same rule, and the library's model merges pieces that are new; each
    worker keeps two generations of up to `keep` pieces. Other texts, and texts under any other kind of vocabulary, are
    encoded whole by the library. Strings of special tokens are ordinary text.
    """

    _of: dict[str, Tokens] = {}

    def __init__(self, path: str, keep: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.keep = Tokenizer.from_file(path), keep
        self.lib.encode_special_tokens = True
        # the byte-level vocabulary writes printable bytes as themselves and the others as characters from 256 up
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.table = {b: b if b in own else 256 + sum(x not in own for x in range(b)) for b in range(256)}
        self.by_pieces, self.ids = self._mergeable(), _Ids(self.lib.model.tokenize, self.table, {})

    def _mergeable(self) -> bool:
        before, model = self.lib.pre_tokenizer, self.lib.model
        rules = json.loads(before.__getstate__()) if before is not None else {}
        plain = not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges) if type(model).__name__ == "BPE" else False
        return plain and self.lib.normalizer is None and rules.get("type") == "ByteLevel" and not rules.get("add_prefix_space") and rules.get("use_regex", True)

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for i, j in batches([t.encode("utf-8", "replace") for t in texts], 1 << 18) for e in self.lib.encode_batch_fast(texts[i:j], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_pieces:
            return self._plain(texts)
        pieces, out = _PIECE.findall, []
        for text in texts:
            if len(self.ids) > self.keep:  # what was not met since the last turn goes
                self.ids = _Ids(self.ids.merge, self.table, dict(self.ids))
            out.append(None if not text.isascii() and _BEYOND.search(text) else b"".join(map(self.ids.__getitem__, pieces(text))))
        odd = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(odd, self._plain([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out


class Scratch:
    """Tables in a folder of their own under the shared folder, deleted at the end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = prepared(spark), new_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(to := f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(to)

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.path)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and label, the least node it is linked with over any number of edges (a, b), for every node of an edge.

    Labels pass along edges and then jump to their label's label, so the rounds grow with the logarithm of a path.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = scratch.keep(labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        root = new.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = scratch.keep(new.join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label"), "old"))
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
