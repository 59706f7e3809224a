"""Token ids in files of fixed-width packed bits, with block offsets for unpacking by numpy and random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tokens, id_in, id_out, lean, prepared, small

#: Ids of a block; a text is never parted, so a block holds at least one text.
BLOCK = 1 << 16


def width(vocabulary_size: int) -> int:
    """Bits that the largest id takes."""
    return max(1, (vocabulary_size - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """The low bits of each id, most significant first, without gaps; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    ids, out = ids.astype(np.uint64), np.zeros((len(ids) * bits + 7) // 8 + 8, np.uint8)
    at = np.arange(len(ids), dtype=np.uint64) * np.uint64(bits)
    first, shift = (at >> np.uint64(3)).astype(np.int64), np.uint64(64 - bits) - (at & np.uint64(7))
    # up to 39 bits from the start of a byte hold an id; ids eight apart share no byte, as eight take `bits` whole bytes
    for lane in range(8):
        word = (ids[lane::8] << shift[lane::8]).astype(">u8").view(np.uint8).reshape(-1, 8)
        for k in range((bits + 14) // 8):
            out[first[lane::8] + k] |= word[:, k]
    return out[: (len(ids) * bits + 7) // 8].tobytes()


def unpacked(data: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """Ids start to start + n of a block; only the bytes that hold them are read."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n, start * bits // 8).astype("<u4")
    first = start * bits // 8
    raw = np.r_[np.frombuffer(data, np.uint8, ((start + n) * bits + 7) // 8 - first, first), np.zeros(8, np.uint8)]
    at = np.arange(n, dtype=np.int64) * bits + start * bits - first * 8
    word = np.zeros(n, np.uint64)
    for k in range(5):  # 32 bits from any bit of a byte on lie in five bytes
        word = word << np.uint64(8) | raw[(at >> 3) + k]
    return (word >> (40 - bits - (at & 7)).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype("<u4")


def write(spark: SparkSession, docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, in ascending order of the id column, as files under path.

    Rows are range-partitioned by the id column, so shard k's ids all precede shard k + 1's; a shard is a sequence of
    blocks. A block is a row: shard, block, first (ids of the shard before it), n_ids, bits, doc_ids, offsets (of each
    text in the block, and its end) and data; a null id is the least long. Spark's Parquet writer is the container: it
    commits whole tasks only and reaches any store that Spark reaches. Null texts are empty; null ids come first; equal
    ids are ordered by their texts' hash.
    """
    prepared(spark)

    @lean
    def encode(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, shard = Tokens.of(vocabulary), TaskContext.get().partitionId()
        bits, end = width(max(tokens.lib.get_vocab_size(), end_id + 1)), np.uint32(end_id).astype("<u4").tobytes()
        first = block = size = 0
        ids: list[bytes] = []
        doc_ids: list[int] = []

        def done() -> pd.DataFrame:
            nonlocal first, block, size, ids, doc_ids
            row = (shard, block, first, size, bits, doc_ids, [0, *np.cumsum([len(x) // 4 for x in ids]).tolist()], packed(np.frombuffer(b"".join(ids), "<u4"), bits))
            first, block, size, ids, doc_ids = first + size, block + 1, 0, [], []
            return pd.DataFrame([row], columns=["shard", "block", "first", "n_ids", "bits", "doc_ids", "offsets", "data"])

        for x in rows:
            for i, got in zip(x["doc_id"].tolist(), tokens.encode(x["text"].tolist()), strict=True):
                ids.append(got + end)
                doc_ids.append(i)
                size += len(got) // 4 + 1
                if size >= BLOCK:
                    yield done()
        if ids:
            yield done()

    plain = docs.select(id_in(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = plain.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    schema = "shard int, block int, first long, n_ids long, bits int, doc_ids array<bigint>, offsets array<bigint>, data binary"
    ordered.mapInPandas(encode, schema).write.parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, with the number of ids in all shards before theirs; the totals are a row for each shard."""
    blocks = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return blocks.join(small(totals, 1_000_000), "shard")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The texts that write() wrote: doc_id, start (ids of all texts before), n_tokens and ids (unsigned 32-bit)."""
    prepared(spark)

    @lean
    def decode(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in rows:
            for doc_ids, offsets, base, bits, data in zip(x["doc_ids"], x["offsets"], x["base"] + x["first"], x["bits"], x["data"], strict=True):
                at = np.asarray(offsets, np.int64)
                raw = unpacked(data, int(bits), 0, int(at[-1])).tobytes()
                yield pd.DataFrame({
                    "doc_id": doc_ids, "start": base + at[:-1], "n_tokens": np.diff(at),
                    "ids": [raw[i * 4 : j * 4] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)],
                })

    # a block's unpacked ids are large; a few at a time are enough
    blocks = _blocks(spark, path).select("doc_ids", "offsets", "base", "first", "bits", "data")
    return blocks.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids binary").withColumn("doc_id", id_out())


def read_range(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Ids start to start + n of the whole collection; only the blocks that hold them are fetched."""
    at = F.col("base") + F.col("first")
    rows = _blocks(spark, path).where((at < start + n) & (at + F.col("n_ids") > start)).select(at.alias("at"), "n_ids", "bits", "data").orderBy("at").collect()
    parts = []
    for r in rows:
        i, j = max(0, start - r["at"]), min(r["n_ids"], start + n - r["at"])
        parts.append(unpacked(r["data"], r["bits"], i, j - i))
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")
