"""Whitening of embeddings on a grid, with moments that merge exactly as they should.

Entries become whole numbers on a grid (``floor(64 c) + 1000000``). The fit list is every distinct grid vector once.
Each partition computes count, mean and centred scatter, batch by batch, and its exact sums; states merge pairwise by
Chan's formula in ``treeReduce``, so the driver gets a few d x d matrices however many partitions there are. The
driver's ``eigh`` gives the components. A second pass over the fit list measures how far the whitened
covariance is from the identity.

What moves: distinct grid vectors once (copies are merged before the shuffle), then d x d states. The model (at most 16
x d numbers and the exact sums for each length) is broadcast.

Dropped: null vectors, vectors that hold null or non-finite entries, vectors without entries, and vectors with an entry
of ``LARGEST`` or more, whose grid value is no long. Vectors of different lengths have no common covariance, so each
length is fitted by itself. Directions without variance (up to ``RANK_TOLERANCE`` of the largest) are no components: a
length with one distinct vector has none. A deviation beyond 64 bits is null. Repeated rows and ids, and null ids, give
rows of their own but count once in the fit; an empty table gives no rows. Other columns are left out, so none can clash.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import bound_batches
from heliograph.shared import cut

SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no 64-bit grid value.
LARGEST = 2.0**55
COMPONENTS = 16
RANK_TOLERANCE = 1e-10
#: Merged states that the driver gets at most, about.
FAN_IN = 8


@dataclass
class Moments:
    """Count, mean and centred scatter of some vectors, and their exact sums where they are whole numbers."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        whole = x.dtype == np.int64
        sums = exact_sums(x) if whole else []
        mean = np.array([s / len(x) for s in sums]) if whole else x.mean(0)
        centred = x - mean
        return Moments(len(x), mean, centred.T @ centred, sums)

    def merged(self, other: Moments) -> Moments:
        """Chan's pairwise formula."""
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), scatter, [a + b for a, b in zip(self.sums, other.sums)])


def exact_sums(x: np.ndarray) -> list[int]:
    top = max(abs(int(x.min())), abs(int(x.max())))
    return (x if top * len(x) < 1 << 62 else x.astype(object)).sum(0).tolist()


def merge(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """States by length."""
    return {d: a[d].merged(b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length among the lists."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]


def total(grid: DataFrame, project=None) -> dict[int, Moments]:
    """The moments of all vectors of grid(x) by length, of what project(d, x) makes of them if it is given."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, Moments] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                made = project(x.shape[1], x) if project else x
                if made.shape[1]:
                    state = merge(state, {x.shape[1]: Moments.of(made)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    states = grid.select("x").mapInArrow(partition, "state binary").rdd.map(lambda r: pickle.loads(r["state"]))
    parts = states.getNumPartitions()
    return states.treeReduce(merge, depth=max(2, math.ceil(math.log(parts, FAN_IN)))) if parts else {}


def on_grid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the vectors that can be whitened."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fits = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & fits).select("id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


@dataclass
class Whitener:
    """One length's model: exact sums, components scaled to unit variance, and the share of the variance each explains."""

    n: int
    sums: list[int]
    scaled: np.ndarray
    explained: list[float]

    @staticmethod
    def of(m: Moments, most: int) -> Whitener:
        values, vectors = np.linalg.eigh(m.scatter / m.n)
        kept = [i for i in np.argsort(values)[::-1] if values[i] > max(values[-1] * RANK_TOLERANCE, 0)][:most]
        return Whitener(m.n, m.sums, vectors[:, kept] / np.sqrt(values[kept]), (values[kept] / values.sum()).tolist())

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in whole numbers."""
        safe = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums)) < 1 << 62
        return self.n * (x if safe else x.astype(object)) - np.array(self.sums, np.int64 if safe else object)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        if centred.dtype == np.int64 and len(centred) and int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 62:
            return (centred * centred).sum(1).tolist()
        return [d if d < 1 << 63 else None for d in (sum(c * c for c in row) for row in centred.tolist())]

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.scaled


@dataclass
class Model:
    """The whiteners by length, and the largest entry of the whitened covariance less the identity, over all lengths."""

    lengths: dict[int, Whitener]
    identity_error: float


def fit(grid: DataFrame, components: int = COMPONENTS) -> Model:
    """The model of grid(x): its distinct vectors are fitted, then looked at again."""
    spark = grid.sparkSession
    bound_batches(spark)
    listed = cut(grid.select("x").distinct(), "fit")
    lengths = {d: Whitener.of(m, components) for d, m in total(listed).items()}
    shared = spark.sparkContext.broadcast(lengths)
    whitened = total(listed, lambda d, x: shared.value[d].project(shared.value[d].centred(x)))
    return Model(lengths, max((float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max()) for m in whitened.values()), default=0.0))


def transform(grid: DataFrame, model: Model) -> DataFrame:
    """grid(id, x) as (id, length, deviation, whitened): the exact sum of (n x - S)^2, and x on each component, the largest first."""
    spark = grid.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model.lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column(1)):
                whitener = shared.value[x.shape[1]]
                centred = whitener.centred(x)
                projected = whitener.project(centred)
                count, width = projected.shape
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * width), pa.array(projected.ravel()))
                columns = [batch.column(0).take(pa.array(rows)), pa.array(np.full(count, x.shape[1], np.int32)), pa.array(whitener.deviations(centred), pa.int64()), whitened]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "length", "deviation", "whitened"])

    return grid.select("id", "x").mapInArrow(run, "id long, length int, deviation long, whitened array<double>")


def components(grid: DataFrame, model: Model) -> DataFrame:
    """(id, component, n, deviation, whitened, explained): one row for each vector and component, numbered from 1."""
    table = [(d, w.n, w.explained) for d, w in model.lengths.items()]  # one row a length
    lengths = grid.sparkSession.createDataFrame(table, "length int, n long, explained array<double>")
    each = transform(grid, model).join(F.broadcast(lengths), "length").select("id", "n", "deviation", "explained", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", "at").alias("explained"))
