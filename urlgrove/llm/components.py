"""Connected components of a table of links, by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``links`` (a, b) of any sortable type -> (node, root): the smallest node that each linked node reaches.

    Every node hooks to its smallest smaller neighbour; the trees are flattened by pointer
    jumping and contracted to their roots, at least halving the nodes, until no link is left.
    All tables are written between rounds, so joins on a hub are plain skewed joins that AQE
    splits, and a lost executor costs no more than the current step.
    """
    n = 0

    def save(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        return scratch.save(df, f"{tag}-{n}")

    links = save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    whole = None
    while not links.isEmpty():
        up = save(links.groupBy("a").agg(F.min("b").alias("up")))
        while True:
            far = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.a"), "left")
            up = save(far.select("x.a", F.coalesce("y.up", "x.up").alias("up"), F.col("y.up").isNotNull().alias("moved")))
            if up.where("moved").isEmpty():
                break
            up = up.select("a", "up")
        up = up.select("a", "up")
        if whole is None:
            whole = up
        else:
            on = whole.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.a"), "left")
            whole = save(on.select("x.a", F.coalesce("y.up", "x.up").alias("up")).unionByName(up.join(whole, "a", "left_anti")))
        root = lambda side: links.join(up.withColumnRenamed("a", side), side, "left").withColumn(side, F.coalesce("up", side)).drop("up")  # noqa: B023, E731
        links = root("a")
        links = links.join(up.withColumnRenamed("a", "b"), "b", "left").withColumn("b", F.coalesce("up", "b")).select("a", "b")
        links = save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    if whole is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = whole.select(F.col("up").alias("node")).distinct()
    return whole.select(F.col("a").alias("node"), F.col("up").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
