"""Views that give the driver's tables the shapes of a literature corpus, for Spark and as SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as papers, with more of their own columns."""
    title = F.regexp_extract("text", r"^([^.\n]*)", 1)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc:"), "doc_id").alias("paper_id"), title.alias("title"), F.substring("text", F.length(title) + 2, F.length("text")).alias("abstract"),
        (2010 + F.col("doc_id") % 15).cast("int").alias("year"), F.col("source").alias("venue"), "doc_id", *more,
    )


def cited_papers(spark: SparkSession, sf_dir: str, some: DataFrame | None = None) -> DataFrame:
    """Papers with a count of citations, for which the quality in labels stands; all of them, or those whose paper_id is in some."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("citation_count"))
    rows = papers(spark, sf_dir)
    return (rows if some is None else rows.join(some, "paper_id", "left_semi")).join(labels, "doc_id", "left").withColumn("citation_count", F.coalesce("citation_count", F.lit(0)))


PAPERS = """papers AS (SELECT 'doc:' || d.doc_id AS paper_id, regexp_extract(d.text, '^([^.\\n]*)', 1) AS title,
  substr(d.text, length(regexp_extract(d.text, '^([^.\\n]*)', 1)) + 2) AS abstract, CAST(2010 + d.doc_id % 15 AS INTEGER) AS year, d.source AS venue,
  coalesce(l.quality, 0) AS citation_count, d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")).where("text <> ''")
    return rows.select(F.concat(F.lit("doc:"), "doc_id").alias("paper_id"), F.concat(F.lit("doc:"), "doc_id", F.lit("#chunk:"), "chunk_index").alias("chunk_id"), F.col("chunk_index").cast("long"), F.when(F.col("chunk_index") == 0, "title_abstract").otherwise("section").alias("chunk_type"), "text", "doc_id")


CHUNKS = """chunks AS (SELECT 'doc:' || doc_id AS paper_id, 'doc:' || doc_id || '#chunk:' || (i - 1) AS chunk_id, CAST(i - 1 AS BIGINT) AS chunk_index,
  CASE WHEN i = 1 THEN 'title_abstract' ELSE 'section' END AS chunk_type, part AS text, doc_id
  FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE part <> '')"""


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("qid"), F.col("text").alias("query_text"))


BENCHMARK_QUERIES = "bq AS (SELECT 'q' || item_id AS qid, text AS query_text FROM benchmark)"


#: Shingles of queries that go to every task; beyond, documents' shingles are joined with them.
ASKED = 200_000


def _asked_shingles(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, shingle: the queries' shingles in each document. A document's words are looked up by pairs, and only where a
    pair begins a query's shingle are eight words put together."""
    asked = {r["shingle"] for r in items.select("shingle").distinct().collect()}
    heads = {tuple(x.split(" ")[:2]) for x in asked}

    def find(rows):
        for x in rows:
            ids, found = [], []
            for i, text in zip(x["doc_id"], x["text"], strict=True):
                words = text.split(" ")
                own = {" ".join(words[k : k + 8]) for k, pair in enumerate(zip(words, words[1:], strict=False)) if pair in heads} & asked
                ids.extend([i] * len(own))
                found.extend(own)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "shingle": pd.Series(found, dtype=object)})

    return docs.select(F.col("doc_id").cast("string"), T.normalize_title(F.col("text")).alias("text")).mapInPandas(find, "doc_id string, shingle string")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that share eight successive words with the query's text."""
    # words are a column of their own: as part of the expression of shingles they would be made for each of its slices
    words = lambda df, key: df.select(key, F.split(T.normalize_title(F.col("text")), " ").alias("words"))
    shingles = lambda df, key: words(df, key).select(key, F.explode(F.array_distinct(T.ngrams(F.col("words"), 8))).alias("shingle"))
    items = shingles(table(spark, sf_dir, "benchmark"), "item_id")
    if items.select("shingle").distinct().count() > ASKED:
        docs = shingles(table(spark, sf_dir, "documents"), "doc_id")
    else:
        docs = _asked_shingles(table(spark, sf_dir, "documents"), items)
    return docs.join(items, "shingle").select(F.concat(F.lit("q"), "item_id").alias("qid"), F.concat(F.lit("doc:"), "doc_id").alias("paper_id")).distinct()


def fold_sql(x: str) -> str:
    return f"regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')"


def title_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({fold_sql(x)}), '[^a-z0-9]+', ' ', 'g'))"


def space_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s]+', ' ', 'g'))"


def tokens_sql(x: str, stop: bool = True) -> str:
    words = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
    return f"list_filter(list_transform(regexp_extract_all(lower({fold_sql(x)}), '[a-z0-9][a-z0-9-]+'), lambda t: trim(t, '-')), lambda t: length(t) > 1" + (f" AND t NOT IN ({words})" if stop else "") + ")"


def shingles_sql(x: str, key: str, source: str, n: int = 8) -> str:
    parts = " || ' ' || ".join(["w"] + [f"lead(w, {k}) OVER (PARTITION BY {key} ORDER BY i)" for k in range(1, n)])
    return f"SELECT DISTINCT {key}, shingle FROM (SELECT {key}, {parts} AS shingle FROM (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT {key}, string_split({title_sql(x)}, ' ') AS ws FROM {source}))) WHERE shingle IS NOT NULL"


GOLD = f"gold AS (SELECT DISTINCT 'q' || i.item_id AS qid, 'doc:' || d.doc_id AS paper_id FROM ({shingles_sql('text', 'doc_id', 'documents')}) d JOIN ({shingles_sql('text', 'item_id', 'benchmark')}) i USING (shingle))"
