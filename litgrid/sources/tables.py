"""Scans, conversion, upserts and checks of tables."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def held(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder where there is one, so that several readers compute them once and lost
    executors cost nothing; without such a folder the rows as they are, computed for each reader."""
    return df.checkpoint(eager=True) if df.sparkSession.sparkContext.getCheckpointDir() else df


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, which driver and executors share; it must be set, but in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(root := "file://" + tempfile.mkdtemp(prefix="litgrid-"))  # tests on one machine
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as a table of their own under the checkpoint folder. Unlike held, what the optimizer knows of them
    starts anew, so loops that make one table from the last keep plans of one size."""
    df.write.parquet(path := fresh_path(df.sparkSession, "table"))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df to be broadcast if it is counted to hold at most that many rows, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


#: Rows of a task where several groupings and windows follow from one shuffle, as each of them holds the task's rows.
TASK_ROWS = 1 << 17


def parted(df: DataFrame, key: str, n: int) -> DataFrame:
    """df, of n rows, shuffled by key into tasks of about TASK_ROWS rows, whatever n. A partition that follows from the
    session's number of them would grow with the input, and with it the memory of a task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), key)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines; blank lines and lines that cannot be parsed are dropped."""
    names = schema + ", _corrupt string"
    return spark.read.schema(names).option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")


def write_jsonl(df: DataFrame, path: str, sorted_keys: bool = False) -> None:
    """JSON lines, one file per partition; with sorted_keys in the order of the columns' names."""
    (df.select(*sorted(df.columns)) if sorted_keys else df).write.mode("overwrite").json(path)


def conversion(raw: DataFrame, dataset: str, split: str, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries, gold_labels and eval_sets of raw rows (place, qid, question, answer, answers), the first `limit` by place.

    A missing id becomes dataset_split_place; a single answer stands for a list of one; blank answers go.
    """
    c = F.col
    rows = raw.where(c("place") <= limit).withColumn("qid", F.coalesce(F.nullif(c("qid"), F.lit("")), F.concat(F.lit(f"{dataset}_{split}_"), c("place").cast("string"))))
    every = F.filter(F.coalesce("answers", F.array("answer")), lambda a: F.coalesce(F.trim(a), F.lit("")) != "")
    rows = rows.withColumn("all", every)
    named = lambda df, *cols: df.select(F.lit(dataset).alias("dataset_name"), F.lit(split).alias("split_name"), *cols)
    queries = named(rows, "qid", c("question").alias("query_text"), F.size("all").alias("answer_count"))
    labels = rows.select("qid", F.posexplode("all").alias("label_rank", "answer"))
    return queries, labels, named(rows, "qid", c("all").alias("gold_paper_ids"))


def chunked(papers: DataFrame, sections: DataFrame, most: int = 80) -> DataFrame:
    """chunk_id, chunk_index, chunk_type, text: chunk 0 is title and abstract, then one for each section with references, of
    which the first `most` are joined. sections: paper_id, place, title, references (array)."""
    c = F.col
    zero = papers.select("paper_id", F.lit(0).cast("long").alias("chunk_index"), F.lit("title_abstract").alias("chunk_type"), F.concat_ws("\n", "title", "abstract").alias("text"))
    order = Window.partitionBy("paper_id").orderBy("place")
    kept = sections.where(F.size("references") > 0).withColumn("chunk_index", F.row_number().over(order).cast("long"))
    rest = kept.select("paper_id", "chunk_index", F.lit("section").alias("chunk_type"), F.concat(c("title"), F.lit(": "), F.array_join(F.slice("references", 1, most), "; ")).alias("text"))
    return zero.unionByName(rest).select(F.concat("paper_id", F.lit("#chunk:"), c("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "chunk_type", "text")


def unpacked(archives: DataFrame, suffix: str = ".json") -> DataFrame:
    """archive, member, content: the members of zip files given as rows (path, content), as the binaryFile source gives them;
    every archive is gone through member by member in one task."""

    def unpack(batches):
        for x in batches:
            for name, data in zip(x["path"], x["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in sorted(z.namelist()):
                        if m.endswith(suffix):
                            yield pd.DataFrame({"archive": [name.rsplit("/", 1)[-1]], "member": [m], "content": [z.read(m).decode("utf-8", "replace")]})

    return archives.select("path", "content").mapInPandas(unpack, "archive string, member string, content string")


def read_archives(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """The members of all zip files under path."""
    return unpacked(spark.read.format("binaryFile").load(path), suffix)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based identifier of RFC 9562, version 5, from the namespace's UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    version = F.concat(F.lit("5"), F.substring(digest, 14, 3))
    variant = F.concat(F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 8))), F.substring(digest, 18, 3))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), version, variant, F.substring(digest, 21, 12))


def scoped_delete(df: DataFrame, scope: Column) -> tuple[DataFrame, DataFrame]:
    """The rows outside the scope, and one row with the counts before, deleted and after."""
    counts = df.agg(F.count("*").alias("before"), F.count_if(scope).alias("deleted"), F.count_if(~scope).alias("after"))
    return df.where(~scope), counts


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key, by the order; rows without a key go."""
    given = df
    for k in key:
        given = given.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return given.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows, and the old ones whose key no new row has."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def first_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def ordered_list(value: str, order: str) -> Column:
    """A group's values in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference has no parent; null references are allowed."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def in_shard(key: Column, n: int, i: int) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(n)) == i


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """store and n for every table, in one union."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("store"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
