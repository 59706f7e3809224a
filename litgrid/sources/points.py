"""An index table of points (id, vector, payload) in buckets of ids, of which an upsert rewrites those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import small, stored


class PointTable:
    """Points under path, a folder for each bucket of their ids' hash. Columns: point_id, vector, payload columns, bucket.

    An upsert is planned from the new rows: only buckets that they fall into are read, merged and overwritten, so that
    indexing a shard anew costs its buckets and not the table.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("point_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def write(self, points: DataFrame) -> None:
        """The whole table anew; of rows of one id the last by payload order stays (see upsert)."""
        self._overwrite(_once(points).withColumn("bucket", self.bucket()), whole=True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def upsert(self, points: DataFrame, order: str | None = None) -> DataFrame:
        """New points in place of those of the same id. Of several new rows of one id the last by `order` counts (without it
        any). Returns bucket, before, after: points of the touched buckets."""
        new = stored(_once(points, order).withColumn("bucket", self.bucket()))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        old = self.read().where(F.col("bucket").isin(touched)) if touched else self.read().limit(0)
        before = stored(old.groupBy("bucket").agg(F.count("*").alias("before")))
        stay = old.join(small(new.select("point_id")), "point_id", "left_anti")
        merged = stored(new.unionByName(stay.select(*new.columns)))  # written apart first: a table is not read and overwritten at once
        if touched:
            self._overwrite(merged, whole=False)
        return merged.groupBy("bucket").agg(F.count("*").alias("after")).join(before, "bucket", "left").select("bucket", F.coalesce("before", F.lit(0)).alias("before"), "after")

    def _overwrite(self, rows: DataFrame, whole: bool) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("bucket").parquet(self.path)


def _once(points: DataFrame, order: str | None = None) -> DataFrame:
    """A row for each id; points without an id go."""
    given = points.where(F.col("point_id").isNotNull())
    if order is None:
        return given.dropDuplicates(["point_id"])
    rest = [c for c in given.columns if c not in ("point_id", order)]
    return given.groupBy("point_id").agg(F.max_by(F.struct(*rest, order), F.col(order)).alias("x")).select("point_id", *(f"x.{c}" for c in (*rest, order))).select(*given.columns)
