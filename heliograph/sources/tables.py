"""Parquet tables with one notion of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _utc(column: str) -> Column:
    """The instant that a timestamp without a zone names in UTC, in any session time zone."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without a zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    if spark.conf.get("spark.sql.session.timeZone") == "UTC":
        return df.withColumns({c: F.col(c).cast("timestamp") for c in plain})
    return df.withColumns({c: _utc(c) for c in plain})
