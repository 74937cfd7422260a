"""Distances, coordinate keys, place scores and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: How much a kind of place counts against nearer ones.
FEATURE_WEIGHTS = {"PPLC": 10.0, "PPLA": 6.0, "PPLA2": 3.0, "PPLA3": 1.5, "PPLA4": 1.5, "PPLA5": 1.5, "PPL": 1.0, "PPLS": 1.0, "PPLX": 0.05, "PPLQ": 0.1, "PPLH": 0.1, "PPLW": 0.1, "PPLR": 0.1}
OTHER_FEATURE = 0.5


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def feature_weight(code) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FEATURE_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _col(code)), F.lit(OTHER_FEATURE))


def coordinate_key(lat, lon) -> Column:
    """Both coordinates to four decimals, the same for points some metres apart."""
    return F.format_string("%.4f,%.4f", F.round(_col(lat), 4) + 0.0, F.round(_col(lon), 4) + 0.0)


def degrees(d, m, s, ref) -> Column:
    """Decimal degrees of degrees, minutes and seconds; south and west are negative."""
    value = _col(d) + _col(m) / 60 + _col(s) / 3600
    return F.when(F.upper(_col(ref)).isin("S", "W"), -value).otherwise(value)


def address_label(house, street, address, city, state) -> Column:
    """House and street, else the provider's text, then city and state; null if all are empty."""
    blank = lambda c: F.nullif(F.trim(_col(c)), F.lit(""))
    line = F.when(blank(street).isNotNull(), F.concat_ws(" ", blank(house), blank(street))).otherwise(blank(address))
    return F.nullif(F.concat_ws(", ", line, blank(city), blank(state)), F.lit(""))
