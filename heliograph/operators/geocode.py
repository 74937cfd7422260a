"""Reverse geocoding against a gazetteer.

Places live in cubes around points of the unit sphere, so neither the poles nor the date line are special: places that
are near each other are near in space. Cubes form a tree by halving; a cube with more than ``CROWDED`` places is
split. The gazetteer's leaves, each with its weightiest place, are what points look at first; single places are only
compared where a leaf may hold the nearest or the best one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.geo import EARTH_KM, feature_weight, haversine_km
from heliograph.shared import cut

#: Places farther than this are never a point's place: what a block of 3 x 3 cells of one degree can hold.
REACH_KM = 315.0
#: A point looks into ever larger cubes until what it needs lies within this distance.
STEPS_KM = [10.0, 20.0, 40.0, 80.0, 160.0]
#: Sides of leaves, from the largest; a leaf with more places than CROWDED is split into leaves of the next size.
LEAF_KM = [2.0, 0.5, 0.125]
CROWDED = 256
#: What rounding may do to a distance.
SLACK_KM = 1e-6


def _space(lat: str, lon: str) -> dict[str, Column]:
    """A point's place in space, in kilometres from the earth's centre."""
    a, b = F.radians(lat), F.radians(lon)
    return {"sx": EARTH_KM * F.cos(a) * F.cos(b), "sy": EARTH_KM * F.cos(a) * F.sin(b), "sz": EARTH_KM * F.sin(a)}


def _cube(side: float) -> Column:
    return F.concat_ws(",", F.lit(str(side)), *[F.floor(F.col(c) / side).cast("string") for c in ("sx", "sy", "sz")])


def _cubes_around(radius: float) -> Column:
    """The cubes of twice the radius that a ball of that radius around a point touches: two in each direction."""
    side = 2 * radius
    both = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side)))
    return F.flatten(F.flatten(F.transform(both("sx"), lambda i: F.transform(both("sy"), lambda j: F.transform(both("sz"), lambda k: F.concat_ws(",", F.lit(str(side)), i.cast("string"), j.cast("string"), k.cast("string")))))))


def radius_around(nearest: Column) -> Column:
    """Within which distance a place competes with the nearest one."""
    return F.least(F.greatest(nearest * 2.5, nearest + 5), nearest + 12)


def gazetteer_leaves(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places with their leaf, leaves with centre, half diagonal, size and weightiest place).

    Places at one spot are one: the weightiest, of equals the first by name.
    """
    weight = feature_weight("feature_code") * (F.greatest(F.coalesce("population", F.lit(0)), F.lit(0)) + 1)
    valid = places.where("lat between -90 and 90 and lon between -180 and 180")
    rows = valid.select("name", "country_code", F.col("lat").cast("double").alias("plat"), F.col("lon").cast("double").alias("plon"), weight.alias("weight"))
    spots = rows.groupBy("plat", "plon").agg(F.min_by(F.struct("weight", "name", "country_code"), F.struct(-F.col("weight"), "name", "country_code")).alias("s"))
    placed = spots.select("plat", "plon", "s.*").withColumns(_space("plat", "plon"))
    placed = cut(placed.withColumn("leaf", _cube(LEAF_KM[0])).withColumn("side", F.lit(LEAF_KM[0])), "places")
    for side in LEAF_KM[1:]:
        crowded = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > CROWDED).select("leaf", F.lit(True).alias("__split"))
        split = placed.join(crowded, "leaf", "left").withColumns({"leaf": F.when(F.col("__split"), _cube(side)).otherwise(F.col("leaf")), "side": F.when(F.col("__split"), side).otherwise(F.col("side"))})
        placed = cut(split.drop("__split"), "places", replaces=placed)
    middle = lambda c: (F.floor(F.col(c) / F.col("side")) + 0.5) * F.col("side")
    boxed = placed.withColumns({f"c{c}": middle(c) for c in ("sx", "sy", "sz")})
    top = F.struct("weight", -F.col("plat"), -F.col("plon"))
    leaves = boxed.groupBy("leaf", "side", "csx", "csy", "csz").agg(F.count(F.lit(1)).alias("places"), F.max("weight").alias("most"), F.max_by(F.struct("plat", "plon"), top).alias("top"))
    return placed, cut(leaves.select("leaf", (F.col("side") * math.sqrt(3) / 2).alias("half"), F.col("csx").alias("sx"), F.col("csy").alias("sy"), F.col("csz").alias("sz"), "places", "most", "top.plat", "top.plon"), "leaves")


def _least_km() -> Column:
    """The least distance on the ground that a place in a leaf can have: the chord to its centre less half its diagonal."""
    chord = F.sqrt(sum((F.col(a) - F.col(f"l{a}")) ** 2 for a in ("sx", "sy", "sz"))) - F.col("half")
    return 2 * EARTH_KM * F.asin(F.least(F.greatest(chord, F.lit(0.0)) / (2 * EARTH_KM), F.lit(1.0))) - SLACK_KM


def nearest_place(points: DataFrame, places: DataFrame, reach_km: float = REACH_KM) -> DataFrame:
    """points(id, lat, lon) with the best place of places(name, lat, lon, feature_code, population, country_code).

    Of the places within a radius that grows with the nearest one's distance (which is at most reach_km), the weightiest for its
    distance wins; ties go to the nearer, then to the name. Points without a place in reach, or without coordinates, get
    nulls. Every row is answered, repeated and null ids too; points at one spot are looked up once.
    """
    placed, leaves = gazetteer_leaves(places)
    spots = cut(points.where("lat between -90 and 90 and lon between -180 and 180").select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).distinct().withColumns(_space("lat", "lon")), "spots")
    waiting, seen = spots, []
    for step in [*(s for s in STEPS_KM if s < reach_km), reach_km + 12]:
        # Every leaf stands in the one cube that its centre lies in, so a ball is widened by half a leaf's diagonal.
        wide = step + LEAF_KM[0]
        grid = leaves.select("leaf", "half", "places", "most", "plat", "plon", *[F.col(c).alias(f"l{c}") for c in ("sx", "sy", "sz")], _cube(2 * wide).alias("cube"))
        near = waiting.withColumn("cube", F.explode(_cubes_around(wide))).join(grid, "cube").drop("cube").withColumns({"least": _least_km(), "km": haversine_km("lat", "lon", "plat", "plon")}).where(F.col("least") <= step)
        bound = near.groupBy("lat", "lon").agg(F.min("km").alias("bound"))
        found = bound.where((F.col("bound") <= reach_km) & (radius_around(F.col("bound")) <= step) if step < reach_km else F.lit(True))
        seen.append(cut(near.join(found, ["lat", "lon"]).where(F.col("least") <= radius_around(F.col("bound"))).select("lat", "lon", "bound", "leaf", "least", "km", "places", "most"), "seen"))
        waiting = cut(waiting.join(seen[-1].select("lat", "lon").distinct(), ["lat", "lon"], "left_anti"), "waiting", replaces=waiting if waiting is not spots else None)
        if waiting.isEmpty():
            break
    near = reduce(DataFrame.unionAll, seen)
    single = placed.select("leaf", "plat", "plon", "weight", "name", "country_code")
    distance = haversine_km("lat", "lon", "plat", "plon")
    nearest = near.where("least <= bound").join(single, "leaf").groupBy("lat", "lon").agg(F.min(distance).alias("nearest")).where(F.col("nearest") <= reach_km)
    known = near.join(nearest.withColumn("radius", radius_around(F.col("nearest"))), ["lat", "lon"]).where(F.col("least") <= F.col("radius"))
    sure = known.where("km <= radius").groupBy("lat", "lon").agg(F.max(F.col("most") / (1 + F.col("km"))).alias("sure"))
    may = known.join(sure, ["lat", "lon"], "left").where(F.col("sure").isNull() | (F.col("most") / (1 + F.greatest("least", F.lit(0.0))) >= F.col("sure") * (1 - 1e-9)))
    tried = may.select("lat", "lon", "leaf", "radius").join(single, "leaf").withColumn("km", distance).where("km <= radius")
    score = F.col("weight") / (1 + F.col("km"))
    best = tried.groupBy("lat", "lon").agg(F.min_by(F.struct("name", "country_code", "km"), F.struct(-score, "km", "name", "country_code")).alias("best"))
    answered = points.join(best.withColumnsRenamed({"lat": "__lat", "lon": "__lon"}), (points["lat"].cast("double") == F.col("__lat")) & (points["lon"].cast("double") == F.col("__lon")), "left")
    return answered.select(points["id"], points["lat"], points["lon"], F.col("best.name").alias("place"), F.col("best.country_code").alias("country_code"), F.col("best.km").alias("km"))
