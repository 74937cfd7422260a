"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are turned by pseudo-random rotations (three rounds of sign flips, each followed by a fast
Hadamard transform); the nearest signed axis is the hash. ROUNDS rotations make a bucket, TABLES
buckets make an index, and each vector also probes the PROBES next likely buckets of each table.
Rows of one bucket are compared by a blocked product of unit vectors in double precision, so every
link that is returned has its exact cosine at or above the threshold; which links are found is the
index's recall (measured in the tests and the README).

Equal vectors are one node: their links are counted, never listed. A pair that meets in several buckets
counts in the first one only, which each task tells from the bucket numbers that travel with the
vectors, so links are summed without listing pairs. Buckets with more than BLOCK rows are cut into
blocks that meet pairwise.

Vectors of every length link among themselves. Null vectors, zero vectors and vectors with null or non-finite
components link with nothing. Rows with a null id get no links, a null component and kept = false.
Repeated rows count as other vectors. Different vectors that share an id have links of their own; where it is the
smallest id that has each of them, they share a component.
An empty table gives no rows; columns of other names are left out, so none can clash; vectors may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import bound_batches
from heliograph.llm.simhash import spanning, whole_groups
from heliograph.operators.components import connected_components
from heliograph.shared import cut

TABLES = 8
ROUNDS = 3
PROBES = 6
BLOCK = 1024
SEED = 20


@lru_cache
def _signs(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], size=(TABLES * ROUNDS, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of the rows, up to scale; their length is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width)


def buckets(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The own bucket (n x TABLES) and the further probes (n x TABLES x PROBES) of unit vectors."""
    n, dims = unit.shape
    width = max(2, 1 << (dims - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dims] = unit
    shift = (2 * width - 1).bit_length()
    own, more = np.zeros((n, TABLES), np.int64), np.zeros((n, TABLES, PROBES), np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        best = np.zeros((ROUNDS, min(3, width), n), np.int64)
        gaps = np.zeros((ROUNDS, min(3, width), n))
        for r in range(ROUNDS):
            y = padded
            for s in _signs(width)[t * ROUNDS + r]:
                y = hadamard(y * s)
            size = np.abs(y) / np.abs(y).max(1, keepdims=True)
            top = np.argsort(-size, axis=1, kind="stable")[:, : best.shape[1]]
            for j in range(best.shape[1]):
                axis = top[:, j]
                best[r, j] = 2 * axis + (y[rows, axis] < 0)
                gaps[r, j] = 1 - size[rows, axis]
        choices = [[1 if r == a else 0 for r in range(ROUNDS)] for a in range(ROUNDS)]
        choices += [[2 if r == a else 0 for r in range(ROUNDS)] for a in range(ROUNDS) if width > 2]
        choices += [[1 if r != a else 0 for r in range(ROUNDS)] for a in range(ROUNDS)]
        code = lambda c: sum(best[r, j] << (shift * r) for r, j in enumerate(c))
        cost = np.stack([sum(gaps[r, j] ** 2 for r, j in enumerate(c)) for c in choices], axis=1)
        codes = np.stack([code(c) for c in choices], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        own[:, t] = code([0] * ROUNDS)
        more[:, t] = np.take_along_axis(codes, order, 1)
    return own, more


def _nodes(valid: DataFrame) -> DataFrame:
    """(node, h, n, v, own, more) for each distinct vector of valid(id, v)."""
    classes = valid.groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).select("node", F.xxhash64("v").alias("h"), "n", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len)
            for _, part in batch.groupby(sizes):  # vectors of one length
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                own, more = buckets(x / np.sqrt((x * x).sum(1, keepdims=True)))
                yield part.assign(own=list(own), more=list(more.reshape(len(x), -1)))

    return classes.mapInPandas(run, "node long, h long, n long, v array<double>, own array<long>, more array<long>")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ok = finite & F.col("id").isNotNull()
    valid = rows.where(ok).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 becomes 0.0
    nodes = cut(_nodes(valid), "vectors")

    homes = F.transform("own", lambda b, t: F.struct(t.alias("t"), b.alias("bucket"), F.lit(True).alias("home")))
    probes = F.transform("more", lambda b, i: F.struct((i / PROBES).cast("int").alias("t"), b.alias("bucket"), F.lit(False).alias("home")))
    at = nodes.select("node", "h", F.size("v").alias("d"), F.explode(F.concat(homes, probes)).alias("p")).select("d", "p.t", "p.bucket", "p.home", "node", "h")
    sizes = at.groupBy("d", "t", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("lived_in")).where("n > 1 and lived_in").select("d", "t", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    dealt = at.join(sizes, ["d", "t", "bucket"]).withColumn("part", F.pmod(F.xxhash64("node", "h"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = dealt.select("d", "t", "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "home", "node", "h").join(nodes, ["node", "h"])
    keys = ["d", "t", "bucket", "lo", "hi"]
    groups = groups.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (part for held in whole_groups(batches, keys, BLOCK // 2) for _, part in held.groupby("d")):
            x = np.stack(frame["v"].to_numpy())
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            t, bucket, lo, hi, part, home, node, digest, count = (frame[c].to_numpy() for c in [*keys[1:], "part", "home", "node", "h", "n"])
            own = np.stack(frame["own"].to_numpy())
            more = np.stack(frame["more"].to_numpy()).reshape(len(x), TABLES, PROBES)
            group = np.cumsum(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in (t, bucket, lo, hi)], axis=0)]))
            left, right = [], []
            for i in range(0, len(x), 512):
                near = x[i : i + 512] @ x.T >= threshold
                near &= group[i : i + 512, None] == group[None, :]
                a, b = np.nonzero(near)
                left.append(a + i)
                right.append(b)
            a, b = np.concatenate(left), np.concatenate(right)
            keep = (a < b) & (home[a] | home[b]) & ((lo[a] == hi[a]) | (part[a] != part[b]))
            a, b = a[keep], b[keep]
            # tables x pairs: whether a's home is among what b looks at, and the other way round
            ab = (own[a] == own[b]) | (own[a][:, :, None] == more[b]).any(2)
            ba = (own[a] == own[b]) | (own[b][:, :, None] == more[a]).any(2)
            first = (ab | ba).argmax(1)
            pick = np.arange(len(a))
            ab, ba = ab[pick, first], ba[pick, first]
            lower_a = node[a] <= node[b]
            owner = np.where(ab & (lower_a | ~ba), own[a, first], own[b, first])
            keep = (first == t[a]) & (owner == bucket[a])
            a, b = a[keep], b[keep]
            if len(a):
                links = np.zeros(len(x), np.int64)
                np.add.at(links, a, count[b])
                np.add.at(links, b, count[a])
                label = spanning(len(x), a, b)
                some = np.flatnonzero(links)
                yield pd.DataFrame({"node": node[some], "h": digest[some], "links": links[some], "root": node[label[some]]})

    found = cut(groups.select(*keys, "part", "home", "node", "h", "n", "v", "own", "more").mapInPandas(compare, "node long, h long, links long, root long"), "links")
    totals = found.groupBy("node", "h").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    info = nodes.select("node", "h", "n").join(totals, ["node", "h"], "left").join(roots.withColumnRenamed("id", "node"), "node", "left")
    info = info.select("node", "h", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    members = valid.join(nodes.select("v", "node", "h"), "v").select("id", "node", "h").join(info, ["node", "h"]).select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(ok, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = members.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
