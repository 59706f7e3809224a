"""Divergence of the sources of each language: hash-consed segment trees over term ids, traversed two at a time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, prepared, settled, small

#: Documents of its language that must hold a term, what is added to each count, and shares' denominator.
LEAST_DOCS, ADDED, SHARE = 30, 5, 1_000_000_000
#: Terms that a part of a tree spans, and groups of a language whose trees meet in one row: what a task holds at once.
BLOCK, TILE = 256, 64
#: Counted terms that a task holds before it passes them on, and bytes of a text that are counted at once.
HELD, SEGMENT = 200_000, 1 << 20
#: Rows up to which tables of groups and of languages are broadcast, by count.
BROADCAST_ROWS = 100_000
_TERMS = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about SEGMENT bytes, so that a very long text is never one list."""
    at = 0
    while at < len(text):
        to = min(len(text), at + SEGMENT)
        part = text[at:to].translate(_TERMS)
        while to < len(text) and _TERMS[text[to]] != 32:  # up to the end of the term
            more = text[to : to + SEGMENT].translate(_TERMS)
            cut = more.find(b" ")
            part, to = part + (more if cut < 0 else more[:cut]), to + (len(more) if cut < 0 else cut)
        yield part.split()
        at = to


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, tf, df of every group, and a row of an empty term for each group, even one without terms.

    Each task adds up what it reads, so a group's and a term's rows are as many as tasks and not as documents.
    """

    @lean
    def tally(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tf: dict[tuple, Counter] = {}
        df: dict[tuple, Counter] = {}

        def out() -> Iterator[pd.DataFrame]:
            for (lang, source), found in tf.items():
                here = df[lang, source]
                names = list(found)
                x = pd.DataFrame({"term": [b"", *names], "tf": [0, *found.values()], "df": [0, *map(here.__getitem__, names)]})
                for k in range(0, len(x), 50_000):
                    yield x[k : k + 50_000].assign(lang=lang, source=source)[["lang", "source", "term", "tf", "df"]]
            tf.clear(), df.clear()

        for x in rows:
            for lang, source, text in zip(x["lang"].tolist(), x["source"].tolist(), x["text"].tolist(), strict=True):
                own, docs_of = tf.setdefault((lang, source), Counter()), df.setdefault((lang, source), Counter())
                met: set[bytes] = set()
                for words in terms_of(bytes(text)):
                    own.update(words)
                    met.update(words)
                docs_of.update(met)
            if sum(map(len, tf.values())) > HELD:
                yield from out()
        yield from out()

    asked = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    parts = docs.select(*asked, F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInPandas(tally, "lang string, source string, term binary, tf long, df long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """SHARE * count div total, by long division in steps of a thousand: 64 bits hold each step."""
    out, rest = np.zeros_like(count), count
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out


class Forest:
    """Segment trees over the same positions, a tree a row of counts. Equal subtrees are one node, whichever tree they are of.

    A node of level 0 is a count; one of level k is a pair of nodes of level k - 1, stored once.
    """

    def __init__(self, counts: np.ndarray):
        self.values, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(self.values)
        while ids.shape[1] > 1:
            nodes, found = np.unique(ids[:, 0::2] * n + ids[:, 1::2], return_inverse=True)
            self.children.append((nodes // n, nodes % n))
            ids, n = found.reshape(ids.shape[0], -1), len(nodes)
        self.roots = ids[:, 0]
        self.empty = [int(np.flatnonzero(self.values == 0)[0])] if (self.values == 0).any() else [-1]
        for left, right in self.children:  # the node of each level all of whose counts are zero
            at = np.flatnonzero((left == self.empty[-1]) & (right == self.empty[-1])) if self.empty[-1] >= 0 else []
            self.empty.append(int(at[0]) if len(at) else -1)

    def compared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of trees (a[i], b[i]): i, two counts and at how many positions they meet, without pairs of zeros.

        Both trees of a pair are gone down together. Node pairs that come up again are merged with their number, so that
        each is opened, and each pair of counts is priced, once for a pair of trees.
        """
        pair, x, y, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        for level in range(len(self.children), -1, -1):
            some = (x != self.empty[level]) | (y != self.empty[level])
            pair, x, y, times = pair[some], x[some], y[some], times[some]
            if level:
                left, right = self.children[level - 1]
                n = len(self.children[level - 2][0]) if level > 1 else len(self.values)
                key = (np.r_[pair, pair] * n + np.r_[left[x], right[x]]) * n + np.r_[left[y], right[y]]
                key, again = np.unique(key, return_inverse=True)
                merged = np.zeros(len(key), np.int64)
                np.add.at(merged, again, np.r_[times, times])
                pair, x, y, times = key // (n * n), key // n % n, key % n, merged
        return pair, self.values[x], self.values[y], times


def _priced(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, a, b and the price of the pair of groups above that of two groups without any term, over the rows' blocks."""
    total: dict[tuple, np.ndarray] = {}

    def out() -> Iterator[pd.DataFrame]:
        for (lang, ta, tb), price in total.items():
            i, j = np.nonzero(price)
            yield pd.DataFrame({"lang": lang, "a": i + ta * TILE, "b": j + tb * TILE, "price": price[i, j]})
        total.clear()

    for x in rows:
        for lang, ta, tb, sides, da, db in zip(*(x[c].tolist() for c in ("lang", "ta", "tb", "sides", "da", "db")), strict=True):
            d = np.concatenate([np.asarray(da, np.int64), np.asarray(db, np.int64)[: 0 if ta == tb else None]])
            counts = np.zeros((len(d), BLOCK), np.int64)
            for side in sides:
                g = np.asarray(side["g"], np.int64) - side["tile"] * TILE + (len(da) if side["tile"] == tb != ta else 0)
                counts[g, np.asarray(side["pos"], np.int64)] = side["tf"]
            if ta == tb:
                a, b = np.triu_indices(len(d), 1)
            else:
                a, b = (z.ravel() for z in np.meshgrid(np.arange(len(da)), len(da) + np.arange(len(db)), indexing="ij"))
            pair, ca, cb, times = Forest(counts).compared(a, b)
            none = scaled(np.full(len(d), ADDED), d)
            f = np.abs(scaled(ca + ADDED, d[a[pair]]) - scaled(cb + ADDED, d[b[pair]])) - np.abs(none[a[pair]] - none[b[pair]])
            price = total.setdefault((lang, ta, tb), np.zeros((TILE, TILE), np.int64))
            np.add.at(price, (a[pair], b[pair] - (0 if ta == tb else len(da))), f * times)
            if len(total) > 200:
                yield from out()
    yield from out()


def audit(spark: SparkSession, docs: DataFrame, ranks: int = 50, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: how far every (lang, source) group is from each other source of its language
    (part `pair`, all of them), and the terms it holds oftener than its language (part `term`, up to that many).

    A group's share of a term is 1 + SHARE * (count + 5) div (N + 5 V), over the V terms that at least 30 documents of the
    language hold. The terms of a language are dealt into blocks by hash; a block is a part of each group's segment tree,
    with frequent terms first, so that the tails of small groups are equal nodes. A row brings the parts of up to two
    tiles of groups together, and prices are added up over blocks: no task holds a whole vocabulary, or all groups.
    A price counts from that of two groups without terms, so blocks that neither group has anything in cost nothing.

    Null text, lang and source are ''. Texts of any length are counted in segments. Repeated rows count as often as they
    stand there. A group without kept terms has its pairs, and 0 for each where the language keeps no term. Equal values
    are ranked by the item's UTF-8 bytes. No rows come from an empty table. Other columns are not read.
    """
    prepared(spark)
    with Scratch(spark, "divergence") as scratch:
        counts = scratch.keep(counted(docs))
        terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("df").alias("docs"), F.sum("tf").alias("total")).where(F.col("docs") >= least_docs)
        terms = scratch.keep(terms)
        langs = scratch.keep(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n")))
        dealt = terms.join(small(langs, BROADCAST_ROWS), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") * 2 / BLOCK)))
        placed = dealt.withColumn("pos", F.row_number().over(Window.partitionBy("lang", "block").orderBy(F.desc("docs"), "term")) - 1)
        # a block takes twice BLOCK / 2 terms on average; what hashing puts above that goes to further blocks of the same hash
        placed = scratch.keep(placed.select("lang", "term", "total", "block", (F.col("pos") / BLOCK).cast("int").alias("more"), (F.col("pos") % BLOCK).cast("int").alias("pos")))
        kept = scratch.keep(counts.where("tf > 0").join(placed, ["lang", "term"]).select("lang", "source", "term", "tf", "total", "block", "more", "pos"))
        n = kept.groupBy("lang", "source").agg(F.sum("tf").alias("n"))
        groups = counts.where("term = ''").select("lang", "source").join(n, ["lang", "source"], "left").join(small(langs, BROADCAST_ROWS), "lang", "left")
        v, own = F.coalesce("v", F.lit(0)), F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        d = F.coalesce("n", F.lit(0)) + ADDED * v
        groups = scratch.keep(groups.select("lang", "source", v.alias("v"), own.alias("g"), (own / TILE).cast("int").alias("tile"), d.alias("d"), (F.col("lang_n") + ADDED * v).alias("lang_d")))
        few = small(groups, BROADCAST_ROWS)
        tiles = scratch.keep(groups.groupBy("lang", "tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]).alias("d")))
        parts = kept.join(few.select("lang", "source", "g", "tile"), ["lang", "source"]).groupBy("lang", "block", "more", "tile")
        parts = parts.agg(F.collect_list(F.struct("g", "pos", "tf")).alias("x")).select("lang", "block", "more", "tile", *(F.col(f"x.{c}").alias(c) for c in ("g", "pos", "tf")))
        last = tiles.groupBy("lang").agg(F.max("tile").alias("last"))
        meets = parts.join(small(last, BROADCAST_ROWS), "lang").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        meets = meets.groupBy("lang", "block", "more", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb")).agg(F.collect_list(F.struct("tile", "g", "pos", "tf")).alias("sides"))
        side = small(tiles, BROADCAST_ROWS // TILE)
        for t in ("a", "b"):
            meets = meets.join(side.select("lang", F.col("tile").alias(f"t{t}"), F.col("d").alias(f"d{t}")), ["lang", f"t{t}"])
        prices = meets.select("lang", "ta", "tb", "sides", "da", "db").mapInPandas(lean(_priced), "lang string, a int, b int, price long")
        prices = scratch.keep(prices.groupBy("lang", "a", "b").agg(F.sum("price").alias("price")))

        x = few.select("lang", "v", "source", "g", "d")
        y = few.select("lang", F.col("source").alias("item"), F.col("g").alias("other"), F.col("d").alias("other_d"))
        pairs = x.join(y, "lang").where("g <> other").withColumns({"a": F.least("g", "other"), "b": F.greatest("g", "other")}).join(prices, ["lang", "a", "b"], "left")
        none = F.abs(F.expr(f"{ADDED * SHARE}L div nullif(d, 0L)") - F.expr(f"{ADDED * SHARE}L div nullif(other_d, 0L)"))
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") > 0, F.col("v") * none + F.coalesce("price", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("value"))
        share = lambda count, total: F.expr(f"cast({SHARE} as decimal(10,0)) * cast({count} + {ADDED} as decimal(20,0)) div cast({total} as decimal(20,0))")
        often = kept.join(few.select("lang", "source", "d", "lang_d"), ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (share("tf", "d") - share("total", "lang_d")).alias("value"))
        by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        often = often.where("value > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= ranks)
        return settled(pairs.withColumn("rank", F.row_number().over(by)).unionByName(often))

