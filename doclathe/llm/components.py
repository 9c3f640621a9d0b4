"""Connected components of a graph of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node, root: for every node of ``edges`` (a, b long) the smallest node that links reach.

    Each round sends edges to smaller nodes; the written table of a round is what the next one reads. Rounds grow
    with the logarithm of the longest path; if ``most_rounds`` weren't enough, that is an error and not a result. Nothing
    but a count and a checksum comes to the driver. Links to oneself and links that repeat change nothing, a link with a
    null end is none, no links give no rows; other columns are ignored.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(now)
    for _ in range(most_rounds):
        before = now
        # large star: larger neighbours go to the smallest neighbour (or the node itself)
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = written(small, "links")
        discard(before)
        was, mark = mark, _mark(now)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    # a star for each component
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
