"""Connected components by alternating stars, with no component and no busy node in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.sources.tables import held, stored


def spread_join(rows: DataFrame, other: DataFrame, key: str, how: str = "inner", least: int = 1000) -> DataFrame:
    """rows joined with other, which has a row for each key. Keys that hold over a thousandth of the rows, of which there
    can be a thousand at most, meet their row by broadcast, so that rows of such a key stay where they are."""
    n = rows.count()
    many = [r[key] for r in rows.groupBy(key).count().where(F.col("count") > max(least, n // 1000)).collect()]  # a thousand at most
    if not many:
        return rows.join(other, key, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in many], f"{key} {rows.schema[key].dataType.simpleString()}"))
    few = F.broadcast(held(other.join(hot, key, "left_semi")))
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rows.join(hot, key, "left_anti").join(other, key, how))


def connected(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """node and label, the least node it is linked with over any number of edges (a, b), for every node of an edge.

    Two steps take turns. The large star hangs every greater neighbour of a node on the least node among the node and its
    neighbours; the small star hangs a node and its lesser neighbours on the least of them. Either keeps components as they
    are, and the edges end as one star a component, after rounds that grow with the square of the logarithm of its size at
    most. Least neighbours are found before the shuffle, and a busy node's edges meet their node's row by spread_join.

    keep writes a table that later steps read, so that lost executors repeat no earlier round. Loops and repeated edges
    change nothing; null ends go; an empty table gives no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = keep(now.distinct())
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, after = None, print_of(now)
    while after != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = keep(spread_join(now.select(F.col("v").alias("u"), F.col("u").alias("v")), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = spread_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(hung.unionByName(least.withColumnRenamed("m", "v")).distinct())
        before, after = after, print_of(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
