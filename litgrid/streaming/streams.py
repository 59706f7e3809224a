"""Structured Streaming forms: windowed roll-ups, late-safe de-duplication and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litgrid.sources.tables import fresh_path, latest


def event_windows(events: DataFrame, size: str, late: str = "1 day") -> DataFrame:
    """Counts and totals by tumbling window and type; state of windows older than the watermark is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def deduplicated(rows: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def upserts(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str):
    """Keeps the last row of each key under path. A batch is reduced to its keys' last rows and appended as a log of changes
    under its own number, which a repeated batch overwrites; nothing else is rewritten. upserted() reads the table."""

    def write(batch: DataFrame, n: int) -> None:
        latest(batch, key, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """The last row of each key over all batches, by the order column and then by batch."""
    return latest(spark.read.parquet(path), key, [F.desc(order), F.desc("batch")]).drop("batch")


def compacted(spark: SparkSession, path: str, key: list[str], order: str, to: str) -> None:
    """Writes the table that the batches so far make as the first batch of a new folder."""
    upserted(spark, path, key, order).write.mode("overwrite").parquet(f"{to}/batch=0")


class LastRows:
    """The last row of each key of a stream, with a side table of rows that came too late, and compaction while writing.

    A row is late if its time is before the greatest time of all earlier batches, less the delay. Each batch appends its
    keys' last rows, its late rows and its clock under its own number, which a repeated batch overwrites, so that a run that
    broke off leaves nothing twice. After every `compact` batches the changes so far become a snapshot; readers take the
    last snapshot and the batches after it, so a snapshot that is being written disturbs none.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, time: str, delay: str, compact: int = 10):
        self.spark, self.path, self.key, self.order, self.time, self.delay, self.compact = spark, path.rstrip("/"), key, order, time, delay, compact

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes all that the stream has so far."""
        stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def _batch(self, batch: DataFrame, n: int) -> None:
        clock = self._clock(n)
        seen = batch.withColumn("_late", F.lit(False) if clock is None else F.coalesce(F.col(self.time) < F.lit(clock) - F.expr(f"interval {self.delay}"), F.lit(False)))
        latest(seen.where("not _late").drop("_late"), self.key, [F.desc(self.order)]).write.mode("overwrite").parquet(f"{self.path}/changes/batch={n}")
        seen.where("_late").drop("_late").write.mode("overwrite").parquet(f"{self.path}/late/batch={n}")
        batch.agg(F.max(self.time).alias("clock")).write.mode("overwrite").parquet(f"{self.path}/clock/batch={n}")
        if (n + 1) % self.compact == 0:
            self._rows(n).write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={n}")

    def _clock(self, n: int):
        """The greatest time of the batches before the n-th."""
        if not self._numbers("clock", "batch"):
            return None
        return self.spark.read.parquet(f"{self.path}/clock").where(F.col("batch") < n).agg(F.max("clock")).first()[0]

    def _numbers(self, part: str, name: str) -> list[int]:
        """Numbers of the folders of a part that were written whole."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        store = there.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(there):
            return []
        whole = lambda x: store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))
        return sorted(int(f.getPath().getName().removeprefix(f"{name}=")) for f in store.listStatus(there) if f.getPath().getName().startswith(f"{name}=") and whole(f.getPath()))

    def _rows(self, upto: int | None) -> DataFrame:
        snapshots = [n for n in self._numbers("snapshots", "upto") if upto is None or n < upto]
        after = snapshots[-1] if snapshots else -1
        parts = [f"{self.path}/changes/batch={n}" for n in self._numbers("changes", "batch") if n > after and (upto is None or n <= upto)]
        rows = self.spark.read.option("basePath", f"{self.path}/changes").parquet(*parts) if parts else None
        if snapshots:
            old = self.spark.read.parquet(f"{self.path}/snapshots/upto={after}").withColumn("batch", F.lit(after))
            rows = old if rows is None else rows.unionByName(old)
        return latest(rows, self.key, [F.desc(self.order), F.desc("batch")]).drop("batch")

    def rows(self) -> DataFrame:
        """The table now."""
        return self._rows(None)

    def late(self) -> DataFrame:
        """The rows that came too late, with their batch."""
        return self.spark.read.parquet(f"{self.path}/late")


def run_once(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], mode: str, flush: bool = False) -> DataFrame:
    """Runs a streaming plan over a table until all of it is read, and returns its result as a table.

    With flush, windows that the watermark has not yet closed are added by the same plan over the whole table.
    """
    at = fresh_path(spark, "stream")
    whole = spark.read.parquet(path)
    stream = spark.readStream.schema(whole.schema).parquet(path.rsplit("/", 1)[0] + "/" + path.rsplit("/", 1)[1].replace(".parquet", ".parque[t]"))
    plan(stream).writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(plan(whole).schema).parquet(f"{at}/out")
    if not flush:
        return done
    return done.unionByName(plan(whole).join(done.select("window", "event_type"), ["window", "event_type"], "left_anti"))


def scored(rows: DataFrame, text: str, scorer: Callable[[list[str]], list[float]]) -> DataFrame:
    """Rows with a score from any scorer of text lists, in Arrow batches; works on tables and streams. Null texts are empty."""

    def apply(batches):
        for x in batches:
            yield x.assign(score=scorer(x[text].fillna("").tolist()))

    return rows.mapInPandas(apply, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", score double")
