"""Connected components of a table of links, by repeated joins; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import stage


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node that it reaches.

    Each round hangs every node and its root's neighbours under the smallest root seen, then shortens
    all paths (root of the root), so rounds grow with the logarithm of a component's width. A node that
    very many links share has one row a task after partial aggregation.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.filter("a <> b").distinct(), "links")
    roots = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "roots")
    while True:
        # The smallest root among the neighbours is offered to the node's own root as well.
        seen = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("near")), "b")
        own = seen.join(roots.select(F.col("node").alias("a"), "root"), "a").filter("near < root")
        offers = own.select(F.col("root").alias("node"), "near").union(own.select(F.col("a").alias("node"), "near"))
        better = offers.groupBy("node").agg(F.min("near").alias("near"))
        hung = roots.join(better, "node", "left").select("node", F.least("root", "near").alias("root"))
        above = hung.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = hung.join(above, "root", "left").select("node", F.least("root", "top").alias("root"))
        after = stage(after, "roots")
        if after.join(roots.withColumnRenamed("root", "old"), "node").filter("root <> old").isEmpty():
            return after
        roots = after
