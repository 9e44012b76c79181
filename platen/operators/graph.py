"""Connected groups of linked things, as Spark steps: for links that no single task should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.sources.scratch import broadcast_if, kept

#: Rows of a table of roots that is broadcast at most.
SMALL = 200_000


def _to_roots(least: DataFrame) -> DataFrame:
    """(node, up), each up less than its node or the node itself, to (node, root): jumps twice as long each time until none goes further."""
    now = kept(least, "jumps")
    while True:
        further = broadcast_if(now.where("node <> up").select(F.col("node").alias("mid"), F.col("up").alias("far")), SMALL)
        moved = kept(now.join(further, F.col("up") == F.col("mid"), "left").select("node", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")), "jumps")
        now = moved.select("node", "up")
        if not moved.where("moved").limit(1).count():
            return now.select("node", F.col("up").alias("root"))


def connected(links: DataFrame) -> DataFrame:
    """Links (a, b) of any type that has an order to (node, root): root is the least node that can be reached. Nodes without a link have no row.

    Each round every node turns to the least of its neighbours and itself, chains of such turns are followed to their ends, and links go on
    between these ends alone. At least half of the nodes that are left drop out in each round. A round is minima with partial aggregation, joins on nodes
    and a written table; nothing of a group is gathered in one place.
    """
    rest = kept(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    known: DataFrame | None = None
    while rest.limit(1).count():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = kept(_to_roots(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("up"))), "roots")
        small = broadcast_if(roots, SMALL)
        ends = rest
        for side in ("a", "b"):
            ends = ends.join(small.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side)
        rest = kept(ends.where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
        if known is None:
            known = roots
        else:  # what stood at a node that has moved on stands where that has gone
            moved = small.select(F.col("node").alias("mid"), F.col("root").alias("far"))
            known = kept(known.join(moved, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("far", "root").alias("root")), "roots")
    return known if known is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
