"""The corpus pipeline: known languages, one document of each group of near copies, no test items, no personal data, packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.llm import common, decontamination, language_id, ngram_join, packing, pii


#: Hash of the text, beside the columns of documents for a while; not a name that a table would have.
KEY = "corpus_pipeline_text_key"
#: Rows up to which what is to go is broadcast, by count.
BROADCAST_ROWS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the language trees reject: null texts, texts without a letter, and texts that no learned
    language codes in fewer bits than bytes that are all alike. The trees are learned anew from the documents' own lang.

    Each row is judged by itself, so repeated rows and null ids stay or go alike. An empty table gives no rows.
    """
    return language_id.keep_known(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id (null ids after all others), then text hash.

    Decided by row: of repeated rows one stays (where they differ in other columns, any), different texts under the same
    id are different documents, and null ids are compared like others. Null and empty texts, which have no words, are
    copies of nothing and all stay. An empty table gives no rows.
    """
    rows = ngram_join.classed(spark, docs).where("n_shingles > 0")
    each = common.settled(rows.groupBy("root", "doc_id", "key").count())
    best = each.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key", "count")).alias("x")).select("x.doc_id", "x.key", "x.count")
    best = common.settled(best)
    same = F.col("o.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("o.key") == F.col("k.key"))
    others = each.alias("o").join(best.alias("k"), same, "left_anti").select("doc_id", "key")
    keyed, same = docs.withColumn(KEY, F.xxhash64("text")), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col(f"d.{KEY}") == F.col("o.key"))
    stay = keyed.alias("d").join(common.small(others, BROADCAST_ROWS).alias("o"), same, "left_anti")
    repeated = common.small(best.where("count > 1").select("doc_id", "key"), BROADCAST_ROWS)
    once = stay.join(repeated.alias("o"), same, "left_anti")
    one = stay.join(repeated.alias("o"), same, "left_semi").dropDuplicates(["doc_id", KEY])
    return once.union(one).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold test items. Decided by text, so null and repeated ids are judged like others, and a
    clean text under the id of another stays. Null and empty texts stay. An empty table gives no rows."""
    keyed = docs.withColumn(KEY, F.xxhash64("text"))
    found = decontamination.matches(spark, keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=KEY)
    found = common.settled(found.select(F.col("doc_id").alias(KEY)).distinct())
    return keyed.join(common.small(found, BROADCAST_ROWS), KEY, "left_anti").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind in brackets. Contexts are learned from these
    documents. Null texts stay null; repeated rows and null ids stay. An empty table gives no rows."""
    return pii.redact(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: a row for each piece of a document. A null or empty text is one piece, of the end id alone;
    repeated rows and null ids are packed row by row. An empty table gives no rows."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("PII", redacted),
    ("packing", packed),
]

#: Trained trees, tokenizing and packing cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on sf_dir's documents. Each stage's rows are written to the shared folder and read again for the next.

    Repeated rows, null ids, null texts and columns beyond those of documents are handled by each stage as it says, and
    an empty table gives no rows. The folders stay, as the result is computed later; common.clean_up deletes them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = common.new_path(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
