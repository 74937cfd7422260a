"""Exact similarity joins of vectors by cells around pivots, and the forests that span what they link.

Angles between vectors obey the triangle inequality. Every vector belongs to the cell of its nearest pivot; a cell is
described by the least and largest angle of its members to every pivot. Two vectors can only be within an angle of each
other if their angles to each pivot differ by no more, so a vector meets a cell only if it lies within the angle
of the cell's interval at every pivot. Cells that meet do so in blocks, one matrix product each; a task has the blocks of two
squares, of which there are a fixed number, so each vector is sent to a fixed number of tasks.

The pivots come from a bounded sample; they decide how much is compared, never what is found. The driver holds the pivots
(at most ``MOST_PIVOTS``) and the intervals (their square) for each length of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.shared import cut

#: Vectors in a block; two blocks meet in one matrix product.
BLOCK = 1024
#: Squares that a group's blocks lie in; two squares meet in one task, which holds one of them. Blocks of a square at most.
GRID = 24
MOST_BLOCKS = 256
#: Edges that a task gathers before it keeps their heaviest forest, and the heights of a forest at which its parts are known.
MOST_EDGES = 500_000
LEVELS = 32
#: Pairs of two blocks from which a whole matrix product is cheaper than a product a pair.
MANY = 4096
MOST_PIVOTS = 256
#: Vectors that the pivots are chosen from.
SAMPLE = 4096
#: Vectors shorter than this have no direction.
SHORTEST = 1e-6
#: What rounding may do to an angle, in radians.
SLACK = 1e-6
#: Similarities are ordered by so many decimals.
DECIMALS = 9


def directed(df: DataFrame, ident: str, vector: str, within: str | None = None) -> DataFrame:
    """(id, v, g) of the rows whose vector has a direction; g is the group that a row is compared within, with the vector's length."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    group = F.concat_ws("|", F.size("v").cast("string"), *([F.col("w")] if within else []))
    rows = df.select(F.col(ident).cast("long").alias("id"), v.alias("v"), *([F.coalesce(F.concat(F.lit("="), F.col(within).cast("string")), F.lit("")).alias("w")] if within else []))
    long = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c) >= SHORTEST**2
    return rows.where(F.col("v").isNotNull() & whole).where(long).select("id", "v", group.alias("g"))


def farthest_first(x: np.ndarray, number: int) -> np.ndarray:
    """number rows of x, each the farthest from those before."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(number, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length among the lists."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, unit(flat[offsets[rows][:, None] + np.arange(d)])


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def choose_pivots(rows: DataFrame, block: int) -> dict[int, np.ndarray]:
    """Pivots by length of the vectors: about one a block, from a bounded sample."""
    count = rows.count()
    number = max(1, min(MOST_PIVOTS, -(-count // block)))
    some = rows.select("v").sample(min(1.0, 3 * SAMPLE / max(count, 1)), seed=7).limit(SAMPLE).collect() if number > 1 else []
    sample: dict[int, list] = {}
    for r in some:
        sample.setdefault(len(r["v"]), []).append(r["v"])
    return {d: farthest_first(unit(np.array(found)), number) for d, found in sample.items()}


def intervals(rows: DataFrame, pivots) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the least and largest angle of each cell's members (rows) to each pivot (columns)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                chosen = pivots.value.get(x.shape[1])
                if chosen is not None:
                    low, high = bounds.setdefault(x.shape[1], (np.full([len(chosen)] * 2, 9.0), np.full([len(chosen)] * 2, -9.0)))
                    a = angles(x, chosen)
                    np.minimum.at(low, a.argmin(1), a)
                    np.maximum.at(high, a.argmin(1), a)
        for d, (low, high) in bounds.items():
            cell, pivot = np.nonzero(high >= 0)
            yield pa.RecordBatch.from_pydict({"d": np.full(len(cell), d, np.int32), "cell": cell.astype(np.int32), "pivot": pivot.astype(np.int32), "low": low[cell, pivot], "high": high[cell, pivot]})

    found = rows.select("v").mapInArrow(part, "d int, cell int, pivot int, low double, high double").groupBy("d", "cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in found.collect():  # at most MOST_PIVOTS squared for each length
        low, high = out.setdefault(r["d"], (np.full([len(pivots.value[r["d"]])] * 2, 9.0), np.full([len(pivots.value[r["d"]])] * 2, -9.0)))
        low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]] = r["low"], r["high"]
    return out


def celled(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """rows(id, v, g) with their cell and the cells (targets) that can hold a vector of that cosine or more."""
    context = rows.sparkSession.sparkContext
    pivots = context.broadcast(choose_pivots(rows, block))
    bounds = context.broadcast(intervals(rows, pivots) if pivots.value else {})
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int32)
            targets: list[list[int]] = [[0]] * batch.num_rows
            for rows_of, x in by_length(batch.column(1)):
                if x.shape[1] in bounds.value:
                    a = angles(x, pivots.value[x.shape[1]])
                    cells[rows_of] = a.argmin(1)
                    low, high = bounds.value[x.shape[1]]
                    near = np.stack([((a >= lo - reach) & (a <= hi + reach)).all(1) for lo, hi in zip(low, high)], 1)
                    for row, cell, meets in zip(rows_of.tolist(), cells[rows_of].tolist(), near):
                        targets[row] = sorted({cell, *np.flatnonzero(meets).tolist()})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(targets, pa.list_(pa.int32()))], names=["id", "v", "g", "cell", "targets"])

    return rows.mapInArrow(part, "id long, v array<double>, g string, cell int, targets array<int>")


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """One row of a block's rows: vectors as single numbers where these hold them."""
    frame = frame.sort_values("id", kind="stable")
    x = np.stack(frame["v"].to_numpy()).astype(np.float64)
    short = x.astype(np.float32)
    packed = {c: [frame[c].iloc[0]] for c in ("g", "own", "cell", "part")}
    targets = [np.unique(np.concatenate(frame["targets"].to_numpy()))]
    return pd.DataFrame(packed | {"targets": targets, "ids": [frame["id"].to_numpy(np.int64).tobytes()], "single": [bool((short == x).all())], "vs": [(short if (short == x).all() else x).tobytes()]})


def meetings(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(g, lo, hi, first, cell, part, targets, ids, single, vs): blocks dealt to the pairs of squares to compare, sorted.

    A block has vectors of one cell. A group's blocks lie in GRID squares at most, or more if one would have over MOST_BLOCKS, so what is
    shuffled grows as the input. first tells whether a block is of lo; those come first.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    dealt = cut(celled(rows, threshold, block), "cells")
    sizes = dealt.groupBy("g", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    group = Window.partitionBy("g")
    counted = sizes.withColumns({"before": F.sum("parts").over(group.orderBy("cell")) - F.col("parts"), "total": F.sum("parts").over(group)})
    spans = cut(counted.withColumn("grid", F.greatest(F.least("total", F.lit(GRID)), F.ceil(F.col("total") / MOST_BLOCKS))), "spans")
    square = lambda number: F.floor((F.col("before") + number) * F.col("grid") / F.col("total")).cast("int")
    placed = dealt.join(spans, ["g", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")).withColumn("own", square(F.col("part")))
    shape = "g string, own int, cell int, part int, targets array<int>, ids binary, single boolean, vs binary"
    blocks = cut(placed.select("g", "own", "cell", "part", "id", "v", "targets").groupBy("g", "own", "cell", "part").applyInPandas(_packed, shape), "blocks")
    asked = blocks.select("g", "cell", "part", F.explode("targets").alias("target")).join(spans.select("g", F.col("cell").alias("target"), square(F.lit(0)).alias("low"), square(F.col("parts") - 1).alias("high")), ["g", "target"])
    others = asked.withColumn("other", F.explode(F.sequence("low", "high"))).groupBy("g", "cell", "part").agg(F.collect_set("other").alias("others"))
    sent = blocks.join(others, ["g", "cell", "part"]).withColumn("other", F.explode("others"))
    sides = sent.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("first"), "cell", "part", "targets", "ids", "single", "vs")
    return sides.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", F.col("first").desc(), "cell", "part")


class _Block:
    def __init__(self, row: dict):
        self.ids, self.cell, self.targets = np.frombuffer(row["ids"], np.int64), row["cell"], set(row["targets"])
        self.x = unit(np.frombuffer(row["vs"], np.float32 if row["single"] else np.float64).astype(np.float64).reshape(len(self.ids), -1))
        self.short = self.x.astype(np.float32)
        self.at = 0

    def meets(self, other: _Block) -> bool:
        return self.cell in other.targets and other.cell in self.targets


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, _Block, _Block]]:
    """(pair of squares, block, block) of all blocks to compare, once each; blocks of one square meet where it meets itself, and each itself."""
    now, held, count = None, [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            key = (row["g"], row["lo"], row["hi"])
            if key != now:
                now, held, count = key, [], 0
            block = _Block(row)
            block.at, count = count, count + len(block.ids)
            if not row["first"] or row["lo"] == row["hi"]:
                for other in held:
                    if other.meets(block):
                        yield key, other, block
            if row["first"]:
                if row["lo"] == row["hi"]:
                    yield key, block, block
                held.append(block)


def _close(a: _Block, b: _Block, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, cosines) of the pairs of at least threshold; of a block with itself each pair once.

    Single numbers tell which pairs can reach the threshold, by a bound on their rounding; these are computed in double precision.
    """
    near = a.short @ b.short.T >= threshold - (a.x.shape[1] + 4) * 2.0**-23
    i, j = np.divmod(np.flatnonzero(np.triu(near, 1) if a is b else near), len(b.ids))
    s = np.einsum("ij,ij->i", a.x[i], b.x[j]) if len(i) < MANY else (a.x @ b.x.T)[i, j]
    keep = s >= threshold
    return i[keep], j[keep], s[keep]


def compared(rows: DataFrame, threshold: float, block: int = BLOCK) -> int:
    """How many pairs of vectors the blocks compare."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b in _met(batches):
            n = len(a.ids)
            yield pa.RecordBatch.from_pydict({"n": [n * (n - 1) // 2 if a is b else n * len(b.ids)]})

    return int(meetings(rows, threshold, block).mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0)


PAIR = "a long, b long, similarity double"


def _pairs(a, b, similarity) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(similarity, pa.float64())], names=["a", "b", "similarity"])


def pairs(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of all pairs of rows(id, v, g) with a < b in one group, of at least threshold."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b in _met(batches):
            i, j, s = _close(a, b, threshold)
            keep = a.ids[i] != b.ids[j]
            u, v = a.ids[i[keep]], b.ids[j[keep]]
            yield _pairs(np.minimum(u, v), np.maximum(u, v), s[keep])

    return meetings(rows, threshold, block).mapInArrow(meet, PAIR)


def _joined(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """label (the smallest index of each node's part) after nodes left and right are linked."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def heaviest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The heaviest spanning forest of edges (a, b, w), a < b, the heaviest first; of equals the first pair in order.

    It grows in rounds: each part takes its best edge to another part.
    """
    order = np.lexsort((b, a, -w))
    a, b, w = a[order], b[order], w[order]
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label, kept, left = np.arange(len(nodes)), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        x, y = label[u[left]], label[v[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return a[kept], b[kept], w[kept]
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        taken = best[best < len(a)]
        kept[taken] = True
        label = _joined(label, u[taken], v[taken])


def spanning_forest(s: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """The edges of the heaviest spanning forest of the pairs of at least threshold; of equals the first pair in order."""
    i, j = np.nonzero(np.triu(s >= threshold, 1))
    return list(zip(*(c.tolist() for c in heaviest(i, j, np.round(s[i, j], DECIMALS)))))


class _Forest:
    """The heaviest spanning forest of the edges added, of which about ``most``, or twice the forest's, are held.

    An edge is left out at once if edges that come before it join its ends; the parts of the forest are known after LEVELS shares of its edges.
    """

    def __init__(self, most: int):
        self.edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.least, self.most, self.nodes = 0, most, most, None

    def add(self, a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
        u, v = a.ids[i], b.ids[j]
        x, y, w = np.minimum(u, v), np.maximum(u, v), np.round(s, DECIMALS)
        keep = u != v
        if self.nodes is not None and len(i):
            level = self._level(x, y, w)
            keep &= self.parts[level, self._place(a.ids, 0)[i]] != self.parts[level, self._place(b.ids, 1)[j]]
        if keep.any():
            self.edges.append((x[keep], y[keep], w[keep]))
            self.held += int(keep.sum())
        if self.held > self.most:
            self._shrink()

    def forest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return heaviest(*(np.concatenate(c) for c in zip(*self.edges))) if self.edges else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _shrink(self) -> None:
        a, b, w = self.forest()
        self.edges, self.held, self.most = [(a, b, w)], len(a), max(self.least, 2 * len(a))
        self.nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        label, n = np.arange(len(self.nodes)), len(self.nodes)
        stops = np.unique(np.linspace(0, len(a), LEVELS + 1).astype(int)[1:])
        stops = stops[stops > 0]
        self.parts = np.empty((len(stops) + 1, n + 2), np.int64)
        self.parts[:, n:] = -1, -2  # of ids that no edge has yet
        self.parts[0, :n] = label
        for at, (start, stop) in enumerate(zip([0, *stops], stops), 1):
            label = _joined(label, ends[start:stop], ends[len(a) + start : len(a) + stop])
            self.parts[at, :n] = label
        self.last = a[stops - 1], b[stops - 1], w[stops - 1]

    def _place(self, ids: np.ndarray, missing: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.nodes, ids), len(self.nodes) - 1)
        return np.where(self.nodes[at] == ids, at, len(self.nodes) + missing)

    def _level(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A number of levels of which all edges come before (x, y, w)."""
        a, b, least = self.last
        level, tied = np.searchsorted(-least, -w), np.searchsorted(-least, -w, side="right")
        at = tied - 1
        return np.where((tied > level) & ((a[at] < x) | ((a[at] == x) & (b[at] < y))), tied, level)


def forest(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity), a < b: for each pair of squares the heaviest spanning forest of its links, in place of all of them.

    Whatever is linked stays so, and the heaviest spanning forest of all links is among these.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, _Forest(MOST_EDGES)
        for key, a, b in _met(batches):
            if key != now:
                yield _pairs(*found.forest())
                now, found = key, _Forest(MOST_EDGES)
            found.add(a, b, *_close(a, b, threshold))
        yield _pairs(*found.forest())

    return meetings(rows, threshold, block).mapInArrow(meet, PAIR)


def linked(rows: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(u, v): ids that links join, directly or not; for each pair of squares a row a vector at most. Whatever is linked is joined by these."""

    def ends(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, label, ids = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for key, a, b in _met(batches):
            if key != now:
                yield ends(ids, label)
                now, label, ids = key, np.zeros(0, np.int64), np.zeros(0, np.int64)
            for c in (a, b):
                if c.at + len(c.ids) > len(label):
                    label = np.concatenate([label, np.arange(len(label), c.at + len(c.ids))])
                    ids = np.concatenate([ids, np.zeros(len(label) - len(ids), np.int64)])
                ids[c.at : c.at + len(c.ids)] = c.ids
            i, j, _ = _close(a, b, threshold)
            label = _joined(label, i + a.at, j + b.at)
        yield ends(ids, label)

    return meetings(rows, threshold, block).mapInArrow(meet, "u long, v long")


def heavier(similarity: Column, a: Column, b: Column) -> Column:
    """What pairs are ordered by: the more similar first, then by ids."""
    return F.struct(similarity, -a, -b)
