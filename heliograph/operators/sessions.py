"""Gap sessions: bursts, trips and streaks are all runs that a boundary condition cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, keys: list[str], order: list[str], is_new, least: int = 1, name: str = "session") -> DataFrame:
    """df with a session number per keys and the session's size, without sessions of fewer than ``least`` rows.

    is_new(before) gets a function that gives a column's value in the row before, and returns whether a
    row opens a session. One shuffle on the keys serves all windows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    opens = F.coalesce(is_new(before), F.lit(True)) | (F.row_number().over(w) == 1)
    out = df.withColumn("__open", opens.cast("long")).withColumn(name, F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__open")
    if least > 1:
        sized = out.withColumn("__size", F.count(F.lit(1)).over(Window.partitionBy(*keys, name)))
        out = sized.where(F.col("__size") >= least).drop("__size")
    return out


def seconds_since(before, column: str) -> Column:
    return F.col(column).cast("double") - before(column).cast("double")


def burst_candidates(photos: DataFrame, hidden: DataFrame, ident: str = "id") -> DataFrame:
    """photos(ident, media_type, camera, taken_at, burst_id, subtype) that may be frames of a burst: stills of a known camera and
    time that have no burst and no subtype yet, and are not hidden (the first column of hidden; its nulls hide nothing)."""
    from heliograph.operators.relational import without

    some = (F.col("media_type") == "photo") & F.col("taken_at").isNotNull() & F.col("camera").isNotNull() & (F.col("camera") != "")
    return without(photos.where(some & F.col("burst_id").isNull() & F.col("subtype").isNull()), ident, hidden)


def bursts(frames: DataFrame, camera: str, taken: str, ident: str, lat: str, lon: str, seconds: float = 2.0, km: float = 1.0) -> DataFrame:
    """Frames of one camera, each within ``seconds`` of the one before and, where both have coordinates, within ``km``."""
    from heliograph.functions.geo import haversine_km

    def is_new(before):
        far = haversine_km(before(lat), before(lon), F.col(lat), F.col(lon)) > km
        return (F.abs(seconds_since(before, taken)) > seconds) | F.coalesce(far, F.lit(False))

    return sessionize(frames, [camera], [taken, ident], is_new, least=2, name="burst")


def trips(df: DataFrame, place: list[str], taken: str, ident: str, cover: str, gap_days: int = 3, least: int = 5) -> DataFrame:
    """Stays in one place with at most ``gap_days`` between days: start, end, day count, number and first cover."""
    days = df.withColumn("day", F.to_date(taken))
    runs = sessionize(days, place, [taken, ident], lambda before: F.datediff("day", before("day")) > gap_days, name="trip")
    first_cover = F.min_by(cover, F.when(F.col(cover).isNotNull(), F.struct(taken, ident)))
    grouped = runs.groupBy(*place, "trip").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("photo_count"), first_cover.alias("cover"))
    return grouped.where(F.col("photo_count") >= least).withColumn("day_count", F.datediff("last_day", "first_day") + 1).drop("trip")


def failure_streaks(df: DataFrame, key: str, order: list[str], failed: Column, least: int) -> DataFrame:
    """Runs of ``least`` or more failures in a row per key, ended by any success."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("failed", failed).withColumn("streak", F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("failed").groupBy(key, "streak").agg(F.count(F.lit(1)).alias("failures"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at")).where(F.col("failures") >= least).drop("streak")
