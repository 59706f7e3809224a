"""Language identification by prediction with partial matching: byte context trees under frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SEGMENT, batches, fold_of, give_back, id_in, id_out, lean, prepared, settled

#: Expected training documents of a language, drawn by hash, whole texts.
SAMPLE = 2000
#: A context of three bytes is in the tree if the training texts hold it so often, and, where all documents are learned
#: from, at least once in so many bytes, so that the tree does not grow with the input.
LEAST, ONE_IN = 8, 1 << 21
#: Different byte quadruples that a task counts before it passes them on.
COUNTED = 1 << 20
#: Times the usual bits a byte of its language, up to which a text is learned from when trees are learned again, and up to
#: which a text is kept; and bits that any text may take beside.
LEARNED, KEPT, FREE = 2.0, 4.0, 64
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _grams(raw: bytes) -> np.ndarray:
    """Each byte with the three before it, as one integer; a text follows three line ends."""
    x = np.frombuffer(b"\n\n\n" + raw, np.uint8).astype(np.uint32)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


def _bits(chance: np.ndarray) -> np.ndarray:
    return (-np.log2(chance)).astype(np.float32)


class Trees:
    """Code lengths in bits of every byte after every context of the tree, for all languages.

    With counts c, total t and d different bytes after a context, a byte seen there has probability c / (t + d); any
    other escapes with d / (t + d) to the context without its first byte (method C, without exclusion). Below the empty
    context all bytes are alike. A context that a language has not met passes on to the shorter one at no cost.
    """

    def __init__(self, languages: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray, deep: np.ndarray | None = None):
        """deep: which counts are of contexts of three bytes in the tree, where that is decided; the others count for shorter
        contexts only."""
        self.languages = languages
        if not languages:
            return
        own = np.unique(np.concatenate([gram >> 24, gram >> 16 & 255, gram >> 8 & 255, gram & 255])) if len(gram) else np.zeros(0, np.int64)
        self.symbol = np.full(256, len(own), np.int64)
        self.symbol[own] = np.arange(len(own))
        a, n = len(own) + 1, len(languages)
        self.a = a
        s3, s2, s1, s0 = (self.symbol[gram >> k & 255] for k in (24, 16, 8, 0))
        parent = np.full((1, a, n), 1.0 / a)
        rows = [self._level(np.zeros(len(gram), np.int64), 1, s0, language, count, parent)]
        at1 = s1
        rows.append(self._level(at1, a, s0, language, count, np.repeat(rows[0], a, 0)))
        self.node = np.repeat(np.arange(a), 1)[None, :].repeat(a * a, 0).reshape(-1)  # by three symbols: their tree node
        code2 = s2 * a + s1
        seen2 = np.unique(code2)
        rows.append(self._level(np.searchsorted(seen2, code2), len(seen2), s0, language, count, rows[1][seen2 % a]))
        two = np.tile(np.arange(a), a)
        two[seen2] = a + np.arange(len(seen2))
        self.node = np.tile(two, a)
        code3 = s3 * a * a + code2
        seen3, where = np.unique(code3, return_inverse=True)
        often = np.bincount(where, count) >= LEAST if deep is None else np.bincount(where, deep) > 0
        keep = often[where] if deep is None else deep
        seen3 = seen3[often]
        if len(seen3):
            shorter = two[seen3 % (a * a)] - a
            rows.append(self._level(np.searchsorted(seen3, code3[keep]), len(seen3), s0[keep], language[keep], count[keep], rows[2][shorter]))
            self.node[seen3] = a + len(seen2) + np.arange(len(seen3))
        self.node = self.node.astype(np.int32)
        self.bits = np.concatenate([_bits(x) for x in rows[1:]]).reshape(-1, n)

    @staticmethod
    def _level(at: np.ndarray, size: int, symbol: np.ndarray, language: np.ndarray, count: np.ndarray, parent: np.ndarray) -> np.ndarray:
        _, a, n = parent.shape
        out = np.empty((size, a, n))
        for k in range(n):  # one language's counts at a time, as they are the driver's largest arrays
            own = language == k
            c = np.bincount(at[own] * a + symbol[own], count[own], size * a).reshape(size, a)
            t, d, before = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True), parent[:, :, k]
            whole = np.maximum(t + d, 1)
            out[:, :, k] = np.where(t == 0, before, np.where(c > 0, c / whole, d / whole * before))
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; long texts are gone through in segments."""
        raw = np.frombuffer(b"".join(b"\n\n\n" + t for t in texts), np.uint8)
        sizes, a = np.array([len(t) for t in texts], np.int64), self.a
        begin = np.r_[0, np.cumsum(sizes + 3)[:-1]] + 3
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(3, len(raw), SEGMENT):
            symbol = self.symbol[raw[at - 3 : at + SEGMENT]]
            node = self.node[(symbol[:-3] * a + symbol[1:-2]) * a + symbol[2:-1]]
            bits = self.bits[node.astype(np.int64) * a + symbol[3:]]
            total = np.vstack([np.zeros((1, bits.shape[1])), np.cumsum(bits, 0, dtype=np.float64)])
            out += total[np.clip(begin + sizes - at, 0, len(bits))] - total[np.clip(begin - at, 0, len(bits))]
        return out

    def identified(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        for i, j in batches(raw, 1 << 19) if self.languages else ():
            bits = self.code_lengths(raw[i:j])
            for k in range(i, j):
                own = bits[k - i]
                best = int(np.argmin(own))
                if any(c.isalpha() for c in texts[k] or ""):
                    lang[k], score[k] = self.languages[best], 1 / np.exp2(np.maximum(-1000, own[best] - own)).sum()
        return lang, score


def drawn(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, sample: int) -> tuple[DataFrame, list[str]]:
    """lang and text of about `sample` documents of each language, by a hash of id and text, of the rows to learn from; and
    the languages."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    chance = F.lit(1.0)
    for x, n in sizes.items():
        chance = F.when(F.col("lang") == x, min(1.0, sample / n)).otherwise(chance)
    found = rows.where(F.pmod(F.xxhash64("i", "text"), F.lit(1 << 20)) < chance * (1 << 20))
    return found.select("lang", "text"), sorted(sizes)


def learned(rows: DataFrame, languages: list[str]) -> Trees:
    """Counts the bytes after contexts in rows (lang, text): Spark adds them up over all partitions.

    The counts are of byte quadruples, so their number is bounded by the rows drawn, whatever the input.
    """
    index = {x: k for k, x in enumerate(languages)}

    @lean
    def count(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batch:
            for lang, texts in x.groupby("lang")["text"]:
                gram, n = np.unique(np.concatenate([_grams(t.encode("utf-8", "replace")) for t in texts]), return_counts=True)
                yield pd.DataFrame({"language": index[lang], "gram": gram.astype(np.int64), "n": n})

    found = rows.select("lang", "text").mapInPandas(count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Trees(languages, found["language"].to_numpy(np.int64), found["gram"].to_numpy(np.int64), found["n"].to_numpy(float))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Trees:
    """Trees of about `sample` documents of each language among the rows to learn from."""
    return learned(*drawn(docs, learn, id_col, text_col, lang_col, sample))


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row: the language of the shortest code, and its share of 2 ** -bits.

    Null texts, texts without a letter, and all texts if nothing was learned are `und` with score 0. Equal code lengths
    go to the first language by name. Rows are judged one by one, so repeated rows and ids are kept.
    """

    @lean
    def judge(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batch:
            lang, score = trees.identified(x["text"].tolist())
            yield pd.DataFrame({"doc_id": x["doc_id"], "lang_pred": lang, "score": score})

    return docs.select(id_in(id_col), F.col(text_col).alias("text")).mapInPandas(judge, "doc_id long, lang_pred string, score double").withColumn("doc_id", id_out())


def predict(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learns from all folds but 0 and predicts every row; a null id is not learned from and not held out.

    An empty table gives no rows; extra columns are not used. Columns: doc_id, held_out, lang_pred, score.
    """
    prepared(spark)
    found = identify(docs, train(docs, F.coalesce(fold_of("doc_id") != 0, F.lit(False))))
    return found.select("doc_id", F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _sent(spark: SparkSession, trees: list[Trees]) -> Broadcast:
    """The trees as a broadcast, of which a worker keeps one copy. In a function's closure each worker would hold them twice
    over, as bytes and as arrays, and the driver as well."""
    return spark.sparkContext.broadcast([vars(x) for x in trees])


def _received(sent: Broadcast) -> list[Trees]:
    trees = [Trees.__new__(Trees) for _ in sent.value]
    for x, own in zip(trees, sent.value, strict=True):
        vars(x).update(own)
    return trees


def _half(text: str) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def _counts(rows: DataFrame, languages: list[str], judged: tuple[Broadcast, dict[str, float]] | None = None) -> DataFrame:
    """half, language (its place), gram and n: the byte quadruples of all rows (lang, text, half), counted in their tasks and
    added up; with judged (trees as _sent gives them, and the usual bits), of rows that take up to LEARNED times these only."""
    index = {x: k for k, x in enumerate(languages)}

    @lean
    def count(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, trees = {}, 0, _received(judged[0]) if judged is not None else []

        def add(key: tuple[int, int], gram: np.ndarray, n: np.ndarray) -> int:
            if key in held:
                gram, n = np.r_[held[key][0], gram], np.r_[held[key][1], n]
            found, at = np.unique(gram, return_inverse=True)
            before, held[key] = len(held[key][0]) if key in held else 0, (found, np.bincount(at, n).astype(np.int64))
            return len(found) - before

        for x in batch:
            raw = [t.encode("utf-8", "replace") for t in x["text"]]
            if judged is not None:
                limit = x["lang"].map(judged[1]).to_numpy(float) * LEARNED
                fit = _rates(x, raw, trees) <= limit
                raw, x = [t for t, ok in zip(raw, fit, strict=True) if ok], x[fit]
            for key, own in x.reset_index(drop=True).groupby(["half", "lang"]).indices.items():
                for i, j in batches([raw[k] for k in own], 1 << 21):
                    gram, n = np.unique(np.concatenate([_grams(raw[k]) for k in own[i:j]]), return_counts=True)
                    size += add((int(key[0]), index[key[1]]), gram.astype(np.int64), n)
            if size > COUNTED:
                yield from passed(held)
                size = 0
        yield from passed(held)

    def passed(held: dict) -> Iterator[pd.DataFrame]:
        while held:
            (half, language), (gram, n) = held.popitem()
            yield pd.DataFrame({"half": half, "language": language, "gram": gram, "n": n})

    return rows.mapInPandas(count, "half int, language int, gram long, n long").groupBy("half", "language", "gram").agg(F.sum("n").alias("n"))


def _halves(counts: DataFrame, languages: list[str]) -> list[Trees]:
    """For either half, the trees that learned from the other half's counts. What is rarer than a tree holds is added up to
    contexts of two bytes in Spark, so that the driver gets the trees' own counts only."""
    found = settled(counts.withColumn("context", F.shiftright("gram", 8)).withColumn("often", F.sum("n").over(Window.partitionBy("half", "context"))))
    total = {r["half"]: r["n"] for r in found.groupBy("half").agg(F.sum("n").alias("n")).collect()}
    deep = F.col("often") >= F.greatest(F.lit(LEAST), F.lit(0.0) + sum((F.when(F.col("half") == h, n / ONE_IN).otherwise(0.0) for h, n in total.items()), F.lit(0.0)))
    short = F.col("gram").bitwiseAND((1 << 24) - 1)
    gram = F.when(F.col("deep"), F.col("gram")).otherwise(short + F.shiftright(short, 16) * (1 << 24))
    kept = found.withColumn("deep", deep).groupBy("half", "language", "deep", gram.alias("gram")).agg(F.sum("n").alias("n"))

    @lean
    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in rows:
            yield pd.DataFrame([{c: x[c].to_numpy(np.int64).tobytes() for c in x.columns}])

    names = ("half", "language", "deep", "gram", "n")
    packed = kept.select(*names).mapInPandas(pack, ", ".join(f"{c} binary" for c in names)).collect()
    half, language, is_deep, grams, n = (np.frombuffer(b"".join(r[c] for r in packed), np.int64) for c in names)
    out = []
    for h in (0, 1):
        own = half == 1 - h
        out.append(Trees(languages, language[own], grams[own], n[own].astype(float), is_deep[own] > 0))
    return out


def _rates(x: pd.DataFrame, raw: list[bytes], trees: list[Trees]) -> np.ndarray:
    """Bits a byte of rows (lang, half) with these texts, under their language's tree of the other half."""
    out, halves = np.zeros(len(raw)), x["half"].to_numpy()
    at = x["lang"].map({z: k for k, z in enumerate(trees[0].languages)}).to_numpy()
    for h in (0, 1):
        own = np.flatnonzero(halves == h)
        texts = [raw[i] for i in own]
        for i, j in batches(texts, 1 << 19):
            bits = trees[h].code_lengths(texts[i:j])
            out[own[i:j]] = bits[np.arange(j - i), at[own[i:j]].astype(np.int64)] / np.maximum(1, [len(t) for t in texts[i:j]])
    return out


def crossed(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[Trees], dict[str, float]]:
    """For either half of the texts, trees that learned from all texts of the other half; and the usual bits a byte of a
    language.

    Halves are by the text's hash, so no tree ever learned from the text that it judges, under whatever id or label. What
    is usual is the median over all texts, held out. Trees are learned twice: the second time without texts that took over
    LEARNED times the usual bits, so junk or other tongues under a language's name leave it. Texts are not stored or
    shuffled; each step is one pass over the documents.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.col(text_col) != "")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("half", _half("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return [], {}
    first = _sent(docs.sparkSession, _halves(_counts(rows, languages), languages))

    @lean
    def rate(batch: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = _received(first)
        for x in batch:
            yield pd.DataFrame({"lang": x["lang"], "rate": _rates(x, [t.encode("utf-8", "replace") for t in x["text"]], trees)})

    usual = {r["lang"]: r["usual"] for r in rows.mapInPandas(rate, "lang string, rate double").groupBy("lang").agg(F.percentile_approx("rate", 0.5).alias("usual")).collect()}
    trees = _halves(_counts(rows, languages, (first, usual)), languages)
    first.unpersist()
    give_back()
    return trees, usual


def keep_known(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, all columns, of which some language's tree tells the text.

    A row is judged by trees that did not learn from its text (see crossed), so its own label decides nothing. Rejected:
    null texts, texts without a letter, and texts for which the language of the shortest code takes over KEPT times its
    usual bits a byte, beyond FREE bits that a text of a few words may cost. Where nothing was learned, documents with a
    letter stay. Repeated rows and null ids are judged row by row; very long texts are gone through in segments; an empty
    table gives no rows; other columns are not read.
    """
    prepared(spark)
    trees, usual = crossed(docs, text_col=text_col, lang_col=lang_col)
    # what a language may take of each half's trees is known here; the trees themselves are read by workers only
    limits = [np.array([KEPT * usual.get(z, np.log2(x.a)) for z in x.languages]) for x in trees]
    sent, half = _sent(spark, trees), "language_id_half"
    del trees
    give_back()

    @lean
    def judge(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _received(sent)
        for x in batch:
            texts, halves = x.column(text_col).to_pylist(), np.array(x.column(half).to_pylist())
            keep = np.array([any(c.isalpha() for c in t or "") for t in texts], bool)
            for h in (0, 1) if trees else ():
                own = np.flatnonzero(keep & (halves == h))
                raw = [texts[i].encode("utf-8", "replace") for i in own]
                limit = limits[h]
                for i, j in batches(raw, 1 << 19):
                    bits, size = trees[h].code_lengths(raw[i:j]), np.array([len(t) for t in raw[i:j]])
                    best = bits.argmin(1)
                    keep[own[i:j]] = bits[np.arange(j - i), best] <= limit[best] * size + FREE
            yield x.drop_columns([half]).filter(pa.array(keep, pa.bool_()))

    return docs.withColumn(half, F.coalesce(_half(text_col), F.lit(0))).mapInArrow(judge, docs.schema)
