"""Connected components by alternating large-star and small-star rounds.

Published method (Kiveris et al., "Connected Components in MapReduce and
Beyond").  A round is two joins with pre-aggregated minima; hubs are ordinary
join keys that adaptive execution can split.  Nothing is collected but two
numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: Edges of a round in one file, and files at least.
FILE_EDGES, FILES = 500_000, 6


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hooks = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooks.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the component's least node.

    Loops and repeated edges change nothing; an empty input gives no rows.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        seen = mark
        # a round's edges go into few files, however many partitions its joins had
        files = max(FILES, -(-mark[0] // FILE_EDGES))
        last, now = now, staged(_small_star(_large_star(now).distinct()).where("a <> b").distinct().repartition(files), "edges")
        discard(last)
