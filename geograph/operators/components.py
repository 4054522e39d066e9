"""Connected components in rounds of stars, and joins that hubs do not overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_written, written

#: A key with over 1 / HOT of all rows is a hub; there are at most HOT of them.
HOT = 2000


def join_unique(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left joined to right, which has each of left's keys once, and as `count` in how many
    of left's rows it stands. The hubs' rows of right, at most HOT, are broadcast, so
    that left's rows of a hub stay where they are; only the others are shuffled."""
    total = right.agg(F.sum(count)).first()[0] or 0
    hubs = right.where(F.col(count) * HOT > total)
    names = F.broadcast(hubs.select(key))
    rest = left.join(names, key, "left_anti").join(right.join(names, key, "left_anti"), key)
    return left.join(F.broadcast(hubs), key).unionByName(rest).drop(count)


def _stars(edges: DataFrame) -> tuple[DataFrame, str]:
    """Edges (x > y), and their folder, after each node has linked its larger neighbours, and
    then its smaller ones, to the least of its neighbourhood."""
    both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(edges.select(F.col("y").alias("u"), F.col("x").alias("v")))
    up = F.count_if(F.col("v") > F.col("u"))
    least, at_least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), up.alias("n")).where("n > 0"))
    large, at_large = written(join_unique(both.where("v > u"), least, "u", "n").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct())
    below, at_below = written(large.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")))
    told = join_unique(large, below, "x", "n").where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    made = written(told.unionByName(below.select("x", F.col("m").alias("y"))).distinct())
    drop_written(edges, at_least, at_large, at_below)
    return made


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least id that each node reaches over the pairs.

    Rounds of stars halve what lies between a node and its root at least, so a path of n
    nodes takes about log n of them; edges never grow in number, and no node's
    neighbours meet each other. Rounds are checkpointed.
    """
    named = pairs.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    edges, _ = written(named.distinct())
    alone = edges.where("x = y").select("x")
    edges, before, path = edges.where("x <> y"), None, None
    while True:
        last = path
        edges, path = _stars(edges)
        if last:
            drop_written(edges, last)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    ends = found.select("root").unionByName(alone.withColumnRenamed("x", "root"))
    return found.unionByName(ends.distinct().join(found, ends.root == found.node, "left_anti").select(F.col("root").alias("node"), "root"))
