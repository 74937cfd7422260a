"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edges; nothing is gathered on the driver but a
count and a checksum. The edge table of each round is written to the shared folder, so a lost executor
costs one round at most, and takes the place of the table before. Rounds end when a round changes no edge; the edges then form stars around the
smallest id of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def checksum(edges: DataFrame):
    """(n, h): the number of distinct edges and the exclusive or of their hashes, which no number of edges overflows."""
    return edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of integer ids -> (id, root) for every id in an edge, where root is the component's smallest id.

    Loops and repeated edges are allowed; rows with a null end are ignored.
    """
    now = cut(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = checksum(now)
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        now = cut(_small_star(_large_star(now)), "edges", replaces=now)
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
