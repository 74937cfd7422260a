"""Similar pairs, single-linkage clusters and centroids of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.vector import cosine
from heliograph.operators import similarity
from heliograph.operators.components import connected_components
from heliograph.shared import cut


def similar_pairs(df: DataFrame, ident: str, vector: str, threshold: float, within: str | None = None, block: int = similarity.BLOCK) -> DataFrame:
    """(a, b, similarity) with a < b and a cosine of at least threshold, exact, among vectors of one length and group."""
    return similarity.pairs(similarity.directed(df, ident, vector, within), threshold, block)


def _first_copies(rows: DataFrame) -> DataFrame:
    """(g, v, first): the smallest id of each group's equal vectors; copies need not be compared."""
    return rows.groupBy("g", "v").agg(F.min("id").alias("first"))


def clusters(df: DataFrame, ident: str, vector: str, threshold: float, within: str | None = None, block: int = similarity.BLOCK) -> DataFrame:
    """(id, cluster) for every row with a vector: single linkage at the threshold; a cluster is named by its smallest id.

    Equal vectors are one, and squares of blocks give what joins their vectors, not their links. Vectors without a direction are alone.
    """
    rows = cut(similarity.directed(df, ident, vector, within), "directed")
    first = cut(_first_copies(rows), "copies")
    links = similarity.linked(first.select(F.col("first").alias("id"), "v", "g"), threshold, block)
    copies = rows.join(first, ["g", "v"]).where("id != first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    return _named(df, ident, vector, links.unionByName(copies))


def _named(df: DataFrame, ident: str, vector: str, links: DataFrame) -> DataFrame:
    """(id, cluster) for every row of df with a vector, by links(u, v)."""
    every = df.where(F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"))
    return every.join(connected_components(links), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def heaviest_links(df: DataFrame, ident: str, vector: str, threshold: float, within: str | None = None, block: int = similarity.BLOCK) -> DataFrame:
    """(a, b, similarity), a < b: links that hold the heaviest spanning forest of all, similarities rounded, of equals the first pair of ids.

    Equal vectors are compared as one. Each is linked to its first copy, and to a smaller id that is linked to the first copy by as much as copies are.
    """
    rows = cut(similarity.directed(df, ident, vector, within), "directed")
    first = cut(_first_copies(rows), "copies")
    links = cut(similarity.forest(first.select(F.col("first").alias("id"), "v", "g"), threshold, block), "links")
    copies = cut(rows.join(first, ["g", "v"]).where("id != first").select(F.col("first").alias("b"), F.col("id").alias("copy")), "copies")
    tied = links.where("similarity = 1").join(copies, "b").select("a", F.col("copy").alias("b"), "similarity")
    return cut(links.unionByName(copies.select(F.col("b").alias("a"), F.col("copy").alias("b"), F.lit(1.0).alias("similarity"))).unionByName(tied), "links", replaces=links)


def clusters_of(df: DataFrame, ident: str, vector: str, links: DataFrame) -> DataFrame:
    """(id, cluster) as clusters gives it, by a result of heaviest_links for df."""
    return _named(df, ident, vector, links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def constrained_clusters(
    df: DataFrame, ident: str, vector: str, threshold: float, pins: DataFrame, within: str | None = None, block: int = similarity.BLOCK, links: DataFrame | None = None
) -> DataFrame:
    """(id, cluster, pin): single linkage that keeps what was decided by hand, for every id with a vector or a pin.

    pins(id, pin) names the group that an id was put into (of several the smallest counts). Ids of one group stay together, ids of
    different groups apart, however similar; all others follow the links, the most similar first (of equals the
    first pair of ids), unless a link would join two groups. So what a pass gives can be the next pass's pins and comes out again.
    Several passes can share their ``links``, a result of heaviest_links for df.

    That is the heaviest spanning forest with a root for each group. It grows in rounds: each part without a pin takes
    its best link to another part, which halves their number.
    """
    edges, spent = links if links is not None else heaviest_links(df, ident, vector, threshold, within, block), None
    held = pins.where("id is not null and pin is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("pin").alias("pin"))
    together = held.groupBy("pin").agg(F.min("id").alias("part"))
    every = df.where(F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id")).union(held.select("id")).distinct()
    parts = cut(every.join(held.join(together, "pin"), "id", "left").select("id", F.coalesce("part", "id").alias("part"), "pin"), "parts")
    while True:
        end = lambda e: parts.select(F.col("id").alias(e), F.col("part").alias(f"p{e}"), F.col("pin").alias(f"pin{e}"))  # noqa: E731, B023
        apart = edges.join(end("a"), "a").join(end("b"), "b").where("pa != pb and (pina is null or pinb is null)")
        edges_left = cut(apart, "links", replaces=spent)
        if edges_left.isEmpty():
            break
        order = similarity.heavier(F.col("similarity"), F.col("a"), F.col("b"))
        sides = [edges_left.where(f"pin{x} is null").select(F.col(f"p{x}").alias("u"), F.col(f"p{y}").alias("v"), order.alias("order")) for x, y in ("ab", "ba")]
        taken = sides[0].unionAll(sides[1]).groupBy("u").agg(F.max_by("v", "order").alias("v"))
        roots = cut(connected_components(taken), "roots")
        named = parts.join(roots.withColumnRenamed("id", "part"), "part", "left").select("id", F.coalesce("root", "part").alias("part"), "pin")
        known = named.where("pin is not null").groupBy("part").agg(F.min("pin").alias("its"))
        parts = cut(named.join(known, "part", "left").select("id", "part", F.coalesce("pin", "its").alias("pin")), "parts", replaces=parts)
        edges, spent = edges_left.select("a", "b", "similarity"), edges_left
    name = parts.groupBy("part").agg(F.min("id").alias("cluster"))
    return parts.join(name, "part").select("id", "cluster", "pin")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, position, value): the mean of each group's vectors, scaled to unit length."""
    parts = df.select(group, F.posexplode(vector).alias("position", "x")).groupBy(group, "position").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = parts.groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"))
    return parts.join(length, group).select(group, "position", F.when(F.col("length") > 0, F.col("m") / F.col("length")).otherwise(F.col("m")).alias("value"))


def assign(df: DataFrame, middles: DataFrame, group: str, vector: str, threshold: float) -> DataFrame:
    """df with assigned: whether a row's vector has a cosine of threshold or more to its group's centroid.

    ``middles`` is a result of centroids; rows without a centroid are not assigned.
    """
    whole = middles.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda p: p["value"]).alias("__middle"))
    close = F.coalesce(cosine(vector, "__middle") >= threshold, F.lit(False))
    return df.join(whole, group, "left").withColumn("assigned", close).drop("__middle")
