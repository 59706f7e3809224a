"""Similarity join on word shingles: token-combination prefixes, exact verification and link classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, components, id_in, id_out, lean, mixed, prepared, runs, settled, small, spread_join, words_of

#: Slots of the frequency sketch: 2 to this power, in slices that add up in parallel.
SKETCH_BITS, SLICES = 20, 1024
#: Shingles that a task counts at once for the sketch.
COUNTED = 1 << 21
#: A list is frequent if its nodes of different link classes make more pairs than the square of this has halves: then
#: combinations of one more token are indexed, up to LONGEST tokens.
FREQUENT, LONGEST = 1000, 4
#: Rows up to which a side of a join is broadcast, by count.
BROADCAST_ROWS = 200_000
#: Bits of each set's bitmap of parities, and the shingles beyond which a set has a second, longer one.
BITS, LARGE = 512, 256


def shingle_sets(texts: list[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """The distinct hashed shingles of each text, ascending: every `size` words, or all words if there are fewer."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    for i, j in batches(raw):
        hashes, at = words_of(raw[i:j])
        shingles = runs(hashes, size)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(shingles[a : b - size + 1])
            else:
                yield mixed(runs(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else hashes[:0]


def shared_least(n: int, percent: int) -> int:
    """The least number of shingles that a set of n shares with any set at that similarity."""
    return -(-percent * n // 100)


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """For each slot of the hashed shingles, about 8 times the binary logarithm of a count over all documents.

    Every task counts its shingles, a few million at a time, and adds those that it met more than once: so the slots
    tell what is common, and the many shingles that stand in a text or two do not blur them, however large the input.
    """
    each = (1 << SKETCH_BITS) // SLICES

    @lean
    def count(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, n = np.zeros(1 << SKETCH_BITS, np.int64), [], 0

        def add() -> None:
            shingle, times = np.unique(np.concatenate(held), return_counts=True)
            again = times > 1
            np.add.at(total, (shingle[again] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), times[again])
            held.clear()

        for x in rows:
            raw = [(t or "").encode("utf-8", "replace").lower() for t in x["text"].tolist()]
            for i, j in batches(raw):
                held.append(runs(words_of(raw[i:j])[0], size))  # a few stand across texts, which the order may heed
                n += len(held[-1])
                if n >= COUNTED:
                    add()
                    n = 0
        if held:
            add()
        there = [(k, np.flatnonzero(part), part) for k, part in enumerate(total.reshape(SLICES, each))]
        there = [(k, at.astype("<u2").tobytes(), np.minimum(part[at], 2**32 - 1).astype("<u4").tobytes()) for k, at, part in there if len(at)]
        yield pd.DataFrame(there, columns=["slice", "at", "counts"])

    @lean
    def add_up(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for x in rows:
            for k, at, counts in zip(x["slice"], x["at"], x["counts"], strict=True):
                np.add.at(total.setdefault(k, np.zeros(each, np.int64)), np.frombuffer(at, "<u2"), np.frombuffer(counts, "<u4"))
        yield pd.DataFrame({"slice": list(total), "level": [np.minimum(255, np.round(8 * np.log2(1 + v))).astype(np.uint8).tobytes() for v in total.values()]})

    parts = docs.select("text").mapInPandas(count, "slice int, at binary, counts binary").repartition("slice").mapInPandas(add_up, "slice int, level binary")
    out = np.zeros((SLICES, each), np.uint8)
    for r in parts.collect():  # a megabyte, whatever the input
        out[r["slice"]] = np.frombuffer(r["level"], np.uint8)
    return out.reshape(-1)


def parities(s: np.ndarray, bits: int) -> np.ndarray:
    """One bit for each slot: whether an odd number of the shingles is in it."""
    odd = np.bincount(((s >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def featured(docs: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """For each document: n, node (a hash of its set), and where its task meets the node first: bits (parities of its
    shingles in BITS slots), wide (in twice as many slots as shingles, of large sets), and the prefix: its tokens, common
    slots last, as far as a similar set must share one; more are the LONGEST - 1 tokens after it."""

    @lean
    def feature(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for x in rows:
            out = []
            for i, key, s in zip(x["doc_id"], x["key"], shingle_sets(x["text"].tolist(), size), strict=True):
                if not len(s):
                    out.append((i, key, 0, None, None, None, None, None))
                    continue
                node = int(mixed(np.array([(mixed(s) * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])
                if node in seen:
                    out.append((i, key, len(s), node, None, None, None, None))
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                tokens = (levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                length = len(s) - shared_least(len(s), percent) + 1
                upto = min(len(s), length + LONGEST - 1)
                if upto < len(s):
                    tokens = np.partition(tokens, upto - 1)[:upto]
                tokens = (np.sort(tokens) ^ np.uint64(1 << 63)).view(np.int64)  # signed order as unsigned
                wide = parities(s, 1 << (2 * len(s) - 1).bit_length()).tobytes() if len(s) > LARGE else None
                out.append((i, key, len(s), node, parities(s, BITS).view("<i8"), wide, tokens[:length], tokens[length:]))
            i, key, n, node, bits, wide, prefix, more = zip(*out, strict=True)
            yield pd.DataFrame({"doc_id": i, "key": key, "n": n, "node": pd.array(node, "Int64"), "bits": bits, "wide": wide, "prefix": prefix, "more": more})

    return docs.mapInPandas(feature, "doc_id long, key long, n long, node long, bits array<bigint>, wide binary, prefix array<bigint>, more array<bigint>")


def _near(percent: int):
    """Neither the numbers of shingles nor the parities, which bound the difference, prove the sets dissimilar."""
    apart = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(BITS // 64)), F.lit(0))
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def _plausible(pairs: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    a, b = (meta.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").where(_near(percent)).select("a", "b", "n_a", "n_b")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class _Sets:
    """Verifies pairs of nodes by their whole sets, which are made only for nodes that need it, once for each."""

    def __init__(self, scratch: Scratch, plain: DataFrame, first: DataFrame, meta: DataFrame, size: int, percent: int):
        self.scratch, self.plain, self.first, self.meta, self.size, self.percent = scratch, plain, first, meta, size, percent
        self.sets: DataFrame | None = None

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The links among plausible pairs (a, b, n_a, n_b)."""
        pairs = self._close(pairs)
        self._make(pairs)
        percent = self.percent

        @lean
        def verify(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in rows:
                keep = []
                for p, q in zip(x["p"], x["q"], strict=True):
                    u, v = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    keep.append(100 * both >= percent * (len(u) + len(v) - both))
                yield x.loc[keep, ["a", "b"]]

        # only the sets that these pairs name are shuffled
        p, q = (self.sets.select(F.col("node").alias(k), F.col("tokens").alias(name)).join(small(pairs.select(k).distinct(), BROADCAST_ROWS), k) for k, name in (("a", "p"), ("b", "q")))
        return self.scratch.keep(pairs.select("a", "b").join(p, "a").join(q, "b").mapInPandas(verify, "a long, b long"))

    def _close(self, pairs: DataFrame) -> DataFrame:
        """Without pairs of large sets whose long bitmaps prove them dissimilar."""
        large = self.scratch.keep(pairs.where((F.col("n_a") > LARGE) & (F.col("n_b") > LARGE)))
        others = pairs.where((F.col("n_a") <= LARGE) | (F.col("n_b") <= LARGE)).select("a", "b")
        named = self.scratch.keep(large.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        wide = self.scratch.keep(self.first.select("node", "wide").join(small(named, BROADCAST_ROWS), "node").dropDuplicates(["node"]))
        percent = self.percent

        @lean
        def close(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in rows:
                keep = []
                for p, q, n in zip(x["p"], x["q"], x["n_a"] + x["n_b"], strict=True):
                    u, v = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
                    while len(u) != len(v):  # one more bit of the slot's number is left out of the longer
                        u, v = (y[: len(y) // 2] ^ y[len(y) // 2 :] if len(y) > len(z) else y for y, z in ((u, v), (v, u)))
                    keep.append((100 + percent) * int(np.bitwise_count(u ^ v).sum()) <= (100 - percent) * n)
                yield x.loc[keep, ["a", "b"]]

        p, q = (wide.select(F.col("node").alias(k), F.col("wide").alias(name)) for k, name in (("a", "p"), ("b", "q")))
        return self.scratch.keep(large.join(p, "a").join(q, "b").mapInPandas(close, "a long, b long").union(others))

    def _make(self, pairs: DataFrame) -> None:
        size = self.size

        @lean
        def gather(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()
            for x in rows:
                x = x[[k not in seen and not seen.add(k) for k in x["node"]]]
                yield pd.DataFrame({"node": x["node"], "tokens": [s.astype("<u8").tobytes() for s in shingle_sets(x["text"].tolist(), size)]})

        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.sets is not None:
            named = named.join(self.sets.select("node"), "node", "left_anti")
        named = self.scratch.keep(self.meta.select("node", "key").join(named, "node", "left_semi"))
        texts = self.plain.select("key", "text").join(small(named, BROADCAST_ROWS), "key").select("node", "text")
        found = self.scratch.keep(texts.mapInPandas(gather, "node long, tokens binary").dropDuplicates(["node"]))
        self.sets = found if self.sets is None else self.sets.union(found)


def classed(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As link_classes, with the class itself: doc_id, key (a hash of the text), n_shingles and root, which rows of a
    class have in common. A text without words has a root of its own key, and stands for nothing else."""
    prepared(spark)
    plain = docs.select(id_in(id_col), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    levels = frequencies(plain, size)
    feats = settled(featured(plain, levels, size, percent))
    with Scratch(spark, "ngram-join") as scratch:
        labels = _labels(scratch, plain, feats, size, percent, frequent)
        labels = settled(labels) if labels is not None else None
    rows = feats.select(id_out(), "key", F.col("n").alias("n_shingles"), "node")
    wordless = rows.where("node is null").select("doc_id", "key", "n_shingles", F.col("key").alias("root"))
    rows = rows.where("node is not null")
    if labels is not None:
        rows = spread_join(rows, labels, "node", "left").withColumn("node", F.coalesce("label", "node"))
    return rows.select("doc_id", "key", "n_shingles", F.col("node").alias("root")).union(wordless)


def link_classes(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by shingle sets with at least percent / 100 Jaccard similarity.

    Two similar sets share the first k of their common tokens, in any order of all tokens, within prefixes of
    n - ceil(t n) + k tokens. The order is by a frequency sketch over all documents, common slots last. Equal sets are one
    node. Postings of tokens that only one node holds end there.

    1. In each token's list every node is compared with one centre: first the least node, then two others drawn by
       hash. Verified links join nodes into classes, so long lists of near copies need no more pairs.
    2. In lists that still hold several classes, all pairs of nodes from different classes and of like size are compared.
       Where these are too many, single tokens say little: there the lists are of combinations of two, three and four
       tokens, as far as that makes fewer pairs. Pairs are dropped only if sizes or parity bitmaps prove them dissimilar.

    So every link between different classes is found: classes are exact (but for collisions of 64-bit hashes).

    Returns a row for each input row: doc_id, n_shingles and component_id (the smallest id in its class). Null and empty
    texts have 0 shingles and their own class. Texts with fewer words than `size` are one shingle. Repeated rows and ids
    are kept as rows. A null id is in no class' minimum (a class of null ids alone has a null component_id). An empty
    table gives no rows; other columns are not used.
    """
    rows = settled(classed(spark, docs, size, percent, frequent, id_col, text_col))
    with_words = rows.where("n_shingles > 0")
    least = settled(with_words.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    found = spread_join(with_words.select("doc_id", "n_shingles", "root"), least, "root", "inner").select("doc_id", "n_shingles", "component_id")
    return found.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _labels(scratch: Scratch, plain: DataFrame, feats: DataFrame, size: int, percent: int, frequent: int) -> DataFrame | None:
    first = feats.where("prefix is not null")
    posts = first.select("node", F.explode("prefix").alias("token"))
    met = scratch.keep(posts.groupBy("token").count().where("count > 1").select("token"))
    shared = scratch.keep(posts.join(met.hint("shuffle_hash"), "token").distinct())  # met grows with the input
    nodes = scratch.keep(shared.select("node").distinct())
    own = first.select("node", "n", "bits", "key").join(small(nodes, BROADCAST_ROWS), "node")
    meta = scratch.keep(own.groupBy("node").agg(F.min_by(F.struct("n", "bits", "key"), "key").alias("x")).select("node", "x.*"))
    sets = _Sets(scratch, plain, first, meta, size, percent)

    tried = edges = labels = None
    lists = shared.select("token", "node", F.col("node").alias("label"))
    for turn in range(3):
        centre = lists.groupBy("token").agg((F.min if not turn else lambda x: F.min_by(x, F.xxhash64("node", F.lit(turn))))(F.struct("node", "label")).alias("c"))
        pairs = lists.join(centre, "token").where("label <> c.label").select(*_ordered("node", "c.node")).distinct()
        pairs = scratch.keep(_plausible(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs, meta, percent))
        links = sets.similar(pairs)
        tried = tried.union(pairs.select("a", "b")) if tried is not None else pairs.select("a", "b")
        edges = edges.union(links) if edges is not None else links
        if turn and links.isEmpty():
            break
        labels = components(edges, scratch)
        # lists of one class are done with
        lists = lists.drop("label").join(labels, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
        several = lists.groupBy("token").agg((F.min("label") < F.max("label")).alias("several")).where("several").select("token")
        lists = scratch.keep(lists.join(several, "token"))

    # lists by combinations of k tokens; each is known by a hash of its tokens, of which the last is kept
    lists = lists.select(F.col("token").alias("combination"), F.col("token").alias("last"), "node", "label")
    pairs = None

    def crossing(x: DataFrame, *keys: str) -> DataFrame:
        parts = x.groupBy(*keys, "label").count()
        all_n, own_n = F.sum("count").cast("double"), F.sum(F.col("count").cast("double") * F.col("count"))
        return parts.groupBy(*keys).agg((all_n * all_n - own_n).alias("crossing")).where("crossing > 0")

    for k in range(1, LONGEST + 1):
        several = scratch.keep(crossing(lists, "combination"))
        hot = scratch.keep(several.where((F.col("crossing") > float(frequent) ** 2) & F.lit(k < LONGEST)))
        longer, gain = None, hot
        if not hot.isEmpty():
            own = lists.join(small(hot.select("combination"), BROADCAST_ROWS), "combination")
            tails = first.select("node", "prefix", "more").join(small(scratch.keep(own.select("node").distinct()), BROADCAST_ROWS), "node")
            tails = scratch.keep(tails.dropDuplicates(["node"]).select("node", F.concat("prefix", F.slice("more", 1, k)).alias("tail")))
            longer = own.join(tails, "node").select(F.col("combination").alias("from"), "node", "label", F.explode(F.filter("tail", lambda t: t > F.col("last"))).alias("last"))
            longer = scratch.keep(longer.withColumn("combination", F.xxhash64("from", "last")))
            # tokens of one passage stand together in all their combinations, which then are no shorter lists
            then = crossing(longer, "from", "combination").groupBy(F.col("from").alias("combination")).agg(F.sum("crossing").alias("then"))
            gain = scratch.keep(hot.join(then, "combination", "left").where("coalesce(then, 0) < crossing").select("combination"))
        now = several.select("combination").join(gain.select("combination"), "combination", "left_anti")
        few = scratch.keep(_crossing(lists.join(now, "combination"), meta, percent))
        pairs = few if pairs is None else pairs.union(few)
        if longer is None or gain.isEmpty():
            break
        lists = longer.join(gain.withColumnRenamed("combination", "from"), "from").select("combination", "last", "node", "label")
    pairs = scratch.keep(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
    if pairs.isEmpty():
        return labels
    links = sets.similar(pairs)
    return components(edges.union(links), scratch) if not links.isEmpty() else labels


def _crossing(lists: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (a, b, n_a, n_b) of nodes from different classes in a list. Sizes within the threshold of each
    other fall into the same step of a geometric scale or the next one, so only these meet."""
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9) if percent < 100 else F.col("n")
    x = lists.select("combination", "node", "label").join(meta.select("node", "n", "bits"), "node").withColumn("step", step)
    a = x.select("combination", F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("step").alias("step_a"), F.explode(F.array("step", F.col("step") + 1)).alias("step"))
    b = x.select("combination", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), "step")
    near = (F.col("label_a") != F.col("label_b")) & ((F.col("step_a") < F.col("step")) | (F.col("a") < F.col("b"))) & _near(percent)
    found = a.join(b, ["combination", "step"]).where(near)
    turned = F.col("a") > F.col("b")
    return found.select(*_ordered("a", "b"), F.when(turned, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(turned, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b")).distinct()
