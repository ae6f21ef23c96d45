"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): the least id of its component for every id that has an edge. edges: (a, b).

    Alternates large-star and small-star steps; each round is a written table,
    and the rounds grow with the logarithm of the longest chain.
    """
    mark = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select("b", "m").where("b <> m").distinct().toDF("a", "b")
        large = scratch.table(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("x"), "m").union(low.select("a", "m")).where("x <> m").distinct().toDF("a", "b")
        small = scratch.table(small)
        is_ = mark(small)
        scratch.drop(large, now)
        now = small
        if is_ == was:
            break
        was = is_
    return scratch.table(now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct()))
