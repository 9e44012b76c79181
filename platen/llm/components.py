"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.common import small, written

#: Rows up to which the smallest neighbours of all ids are broadcast; beyond, Spark may split the join.
BROADCAST_IDS = 1_000_000


def _summary(edges: DataFrame) -> tuple[int, int]:
    n, digest = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return n, digest


def _star(pairs: DataFrame, lows: DataFrame) -> DataFrame:
    """An id of many links meets its one row of lows in every task, if these may be broadcast."""
    return pairs.join(small(lows, BROADCAST_IDS), "u").select("u", "v", "low")


def connected_components(links: DataFrame) -> DataFrame:
    """Links (u long, v long) to (u, root): root is the smallest id that u reaches; ids without links have no row.

    Each step keeps, for every id, only links to the smallest neighbour, so links never multiply and the number
    of steps grows with the logarithm of the size. A step is a min() with partial aggregation and a join that
    Spark may split where one id has many links; the links of a step are written to the shared folder.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _summary(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = written(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "lows")
        large = _star(both.where("v > u"), lows).select(F.col("v").alias("u"), F.col("low").alias("v"))
        # an id that is not its neighbours' smallest keeps a link to the smallest as well
        own = lows.where("low < u").select("u", F.col("low").alias("v"))
        large = written(large.unionByName(own).distinct(), "links")
        lows = written(large.groupBy("u").agg(F.min("v").alias("low")), "lows")
        fewer = _star(large, lows).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = written(fewer.unionByName(lows.select("u", F.col("low").alias("v"))).distinct(), "links")
        after = _summary(edges)
        if after == before:
            break
        before = after
    roots = edges.select("u", F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
