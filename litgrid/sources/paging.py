"""Scans in pages of a key, which stop and go on."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class PagedScan:
    """Rows of a table in pages by ranges of a key, each written before the next begins.

    Page borders are quantiles of the key within the bounds, found by one pass of mergeable sketches and kept with the
    cursor under path, so that a later run of the same scan has the same pages. Each page is a filter of two bounds,
    which reaches the scan; it is written as a folder of its own, which overwrites what a run that broke off has left.
    The key's rows without a value are in no page.
    """

    def __init__(self, spark: SparkSession, source: DataFrame, key: str, path: str, pages: int = 8, lower: object = None, upper: object = None, shard: Column | None = None):
        self.spark, self.key, self.path = spark, key, path.rstrip("/")
        rows = source.where(F.col(key).isNotNull())
        if lower is not None:
            rows = rows.where(F.col(key) > F.lit(lower))
        if upper is not None:
            rows = rows.where(F.col(key) <= F.lit(upper))
        self.rows = rows if shard is None else rows.where(shard)
        if (cursor := self._cursor()) is None:
            inner = rows.agg(F.percentile_approx(key, [k / pages for k in range(1, pages)] or [0.5], 100 * pages)).first()[0] or []
            cursor = {"borders": sorted(set(inner if pages > 1 else [])), "done": 0}
            self._store(cursor)
        self.cursor = cursor

    @property
    def pages(self) -> int:
        return len(self.cursor["borders"]) + 1

    def page(self, k: int) -> DataFrame:
        """Rows of a page: above the border before it, up to its own."""
        borders, out = self.cursor["borders"], self.rows
        if k > 0:
            out = out.where(F.col(self.key) > F.lit(borders[k - 1]))
        return out.where(F.col(self.key) <= F.lit(borders[k])) if k < len(borders) else out

    def run(self, most: int | None = None, each=lambda page: page) -> int:
        """Writes the next pages, up to `most` of them, as each(page) gives their rows; returns how many."""
        first = self.cursor["done"]
        upto = self.pages if most is None else min(self.pages, first + most)
        for k in range(first, upto):
            each(self.page(k)).write.mode("overwrite").parquet(f"{self.path}/pages/page={k}")
            self._store(self.cursor | {"done": k + 1})
        return upto - first

    def result(self) -> DataFrame:
        """The rows of all pages that are done, with their page."""
        done = [f"{self.path}/pages/page={k}" for k in range(self.cursor["done"])]
        return self.spark.read.option("basePath", f"{self.path}/pages").parquet(*done)

    def _store(self, cursor: dict) -> None:
        self.cursor = cursor
        text = self.spark.createDataFrame([(cursor["done"], json.dumps(cursor))], "done int, cursor string")
        text.coalesce(1).write.mode("append").json(f"{self.path}/cursor")

    def _cursor(self) -> dict | None:
        """What was stored last: a row is added for each page, so a run that breaks off leaves the one before."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/cursor")
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return None
        rows = self.spark.read.schema("done int, cursor string").json(f"{self.path}/cursor")
        last = rows.orderBy(F.desc("done")).first()
        return json.loads(last["cursor"]) if last else None
