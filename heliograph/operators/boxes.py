"""Greedy suppression of overlapping boxes, tile by tile.

A box stays unless a better one that stays overlaps it by more than a limit (intersection over union). Boxes that overlap
so much are of like size and lie close together, so a box only meets those of its size band and neighbouring bands
in the tiles around its centre; a picture of few boxes is one tile. A tile streams its boxes in order of score and decides those whose better neighbours it
knows for certain; the others wait for the next round, when what their tiles decided is known. The best waiting box is
decided in each round, so rounds end; chains of overlaps inside a tile take one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.shared import cut

#: Tiles are so many times as wide as the widest box of their band; a band spans a factor of eight.
TILE = 8
OCTAVES = 3
#: Factor for rounding where a box's reach is laid out.
ROOM = 1.0001
#: Pictures of so many boxes at most are one tile, and decided in one round.
WHOLE = 1 << 16
#: Boxes that are judged at once, and boxes of their tile that they are compared with at once.
CHUNK = 128
PIECE = 4096


def _tiles(limit: float):
    """An array of the tiles that a box may meet others in: (band of widths, band of heights, column, row)."""

    def bands(size: str):
        b = lambda x: F.floor(F.log2(x) / OCTAVES).cast("int")
        return F.sequence(b(F.col(size) * limit / ROOM), b(F.col(size) / limit * ROOM))

    def places(corner: str, size: str, band):
        widest = F.pow(F.lit(2.0), (band + 1) * OCTAVES)
        reach = (1 - limit) * F.greatest(F.col(size), F.least(F.col(size) / limit, widest)) * ROOM
        at = lambda x: F.floor(x / (widest * TILE)).cast("long")
        middle = F.col(corner) + F.col(size) / 2
        return F.sequence(at(middle - reach), at(middle + reach))

    columns = F.flatten(F.transform(bands("w"), lambda b: F.transform(places("x", "w", b), lambda p: F.struct(b.alias("bw"), p.alias("column")))))
    rows = F.flatten(F.transform(bands("h"), lambda b: F.transform(places("y", "h", b), lambda p: F.struct(b.alias("bh"), p.alias("row")))))
    return F.flatten(F.transform(columns, lambda c: F.transform(rows, lambda r: F.struct(c["bw"], r["bh"], c["column"], r["row"]))))


def _home():
    """The tile that a box's centre lies in, of its own bands."""
    band = lambda x: F.floor(F.log2(x) / OCTAVES).cast("int")
    at = lambda corner, size: F.floor((F.col(corner) + F.col(size) / 2) / (F.pow(F.lit(2.0), (band(size) + 1) * OCTAVES) * TILE)).cast("long")
    return F.struct(band("w").alias("bw"), band("h").alias("bh"), at("x", "w").alias("column"), at("y", "h").alias("row"))


def _overlaps(boxes: np.ndarray, others: np.ndarray, limit: float) -> np.ndarray:
    """Which of the others (columns; x, y, w, h) overlap which of the boxes (rows) by more than the limit."""
    a, b = boxes[:, None, :], others[None, :, :]
    w = np.minimum(a[..., 0] + a[..., 2], b[..., 0] + b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    shared = np.clip(w, 0, None) * np.clip(h, 0, None)
    return shared > limit * (a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - shared)


class _Tile:
    """The better boxes of one tile that stay (certain) or may stay."""

    def __init__(self):
        self.boxes, self.certain, self.count = np.zeros((64, 4)), np.zeros(64, bool), 0

    def add(self, boxes: np.ndarray, certain: np.ndarray) -> None:
        while self.count + len(boxes) > len(self.boxes):
            self.boxes, self.certain = np.vstack([self.boxes, self.boxes]), np.concatenate([self.certain, self.certain])
        self.boxes[self.count : self.count + len(boxes)], self.certain[self.count : self.count + len(boxes)] = boxes, certain
        self.count += len(boxes)

    def judge(self, boxes: np.ndarray, known: np.ndarray, home: np.ndarray, limit: float) -> np.ndarray:
        """Of boxes in order, few at a time: 0 if one that stays covers it, 1 if it stays, -1 if that is not known here; known ones stay."""
        gone, may = np.zeros(len(boxes), bool), np.zeros(len(boxes), bool)
        for at in range(0, self.count, PIECE):
            left = np.flatnonzero(~gone)
            over, certain = _overlaps(boxes[left], self.boxes[at : min(self.count, at + PIECE)], limit), self.certain[at : min(self.count, at + PIECE)]
            gone[left] = over[:, certain].any(1) & ~known[left]
            may[left] |= over[:, ~certain].any(1)
        left = np.flatnonzero(~gone)
        known, may, home = known[left], may[left], home[left]
        over = np.tril(_overlaps(boxes[left], boxes[left], limit), -1)
        here, certain = np.ones(len(left), bool), known | (~may & home)  # only a box's home tile holds all that it meets
        for i in np.flatnonzero(over.any(1) & ~known):
            mine = over[i] & here
            if (mine & certain).any():
                here[i] = certain[i] = False
            elif mine.any():
                certain[i] = False
        self.add(boxes[left[here]], certain[here])
        verdicts = np.zeros(len(boxes), np.int8)
        verdicts[left] = np.where(certain, 1, np.where(here, -1, 0))
        return verdicts


def _decide(limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, now = _Tile(), None
        for batch in batches:
            boxes, keys = batch[["x", "y", "w", "h"]].to_numpy(float), batch["tile"].to_numpy()
            known, home = batch["stays"].fillna(False).to_numpy(bool), batch["home"].to_numpy(bool)
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            verdicts = np.full(len(batch), -1, np.int8)
            for start, end in zip(starts[:-1], starts[1:]):
                if keys[start] != now:
                    tile, now = _Tile(), keys[start]
                for at in range(start, end, CHUNK):
                    some = slice(at, min(end, at + CHUNK))
                    verdicts[some] = tile.judge(boxes[some], known[some], home[some], limit)
            some = ~known & (verdicts >= 0)
            yield pd.DataFrame({"n": batch["n"].to_numpy()[some], "stays": verdicts[some] == 1})

    return run


def suppress(boxes: DataFrame, image: str, limit: float = 0.4) -> DataFrame:
    """boxes(image, id, x, y, w, h, score) without those that overlap a better one that stays in their image by more than limit.

    The better box has the higher score, of equal scores the smaller id (of repeated ids the one with the smaller corner);
    scores that are missing or no number come last. Boxes without a size, or with a missing or infinite number, overlap
    nothing. Of equal boxes only the best can stay. A null image is an image. The limit lies between 0 and 1.
    """
    if not 0 < limit < 1:
        raise ValueError("the limit has to lie between 0 and 1")
    number = lambda c: F.col(c).cast("double")
    good = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    row = F.struct(*boxes.columns)
    score = F.when(~F.isnan(number("score")), number("score"))
    plain = boxes.select(F.col(image).cast("string").alias("image"), F.struct(F.col("id")).alias("id"), *[number(c).alias(c) for c in "xywh"], score.alias("score"), row.alias("row"))
    sized = good(F.col("x")) & good(F.col("y")) & good(F.col("w")) & good(F.col("h")) & (F.col("w") > 0) & (F.col("h") > 0)
    alone = plain.where(~sized).select("row.*")
    order = F.struct((-F.coalesce("score", F.lit(-math.inf))).alias("worse"), "id")
    best = plain.where(sized).groupBy("image", "x", "y", "w", "h").agg(F.min_by(F.struct("id", "score", "row"), order).alias("b")).select("image", "x", "y", "w", "h", "b.*")
    known = cut(best.withColumn("n", F.monotonically_increasing_id()), "boxes")
    # Large pictures are few, at most one for WHOLE boxes.
    large = cut(known.groupBy("image").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > WHOLE).select(F.col("image").alias("large"), F.lit(True).alias("cut")), "large")
    waiting, stays = known.drop("row"), None
    while True:
        mine = waiting.withColumn("stays", F.lit(False))
        every = mine if stays is None else mine.unionByName(known.drop("row").join(stays, "n").withColumn("stays", F.lit(True)))
        tiles = F.when(F.col("cut"), _tiles(limit)).otherwise(F.array(F.lit(None)))
        dealt = every.join(large, F.col("image").eqNullSafe(F.col("large")), "left").withColumn("tile", F.explode(tiles)).withColumn("home", F.col("tile").isNull() | (F.col("tile") == _home()))
        dealt = dealt.withColumn("tile", F.to_json(F.struct("image", "tile"))).withColumn("worse", -F.coalesce("score", F.lit(-math.inf)))
        sorted_ = dealt.repartition("tile").sortWithinPartitions("tile", "worse", "id", "x", "y", "w", "h").select("tile", "home", "n", "x", "y", "w", "h", "stays")
        decided = cut(sorted_.mapInPandas(_decide(limit), "n long, stays boolean").groupBy("n").agg(F.min("stays").alias("stays")), "decided")
        more = decided.where("stays").select("n")
        stays = more if stays is None else stays.unionAll(more)
        waiting = cut(waiting.join(decided, "n", "left_anti"), "waiting")
        if waiting.isEmpty():
            return known.join(stays, "n").select("row.*").unionByName(alone)
