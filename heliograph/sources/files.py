"""Media folders, gazetteer files and import sidecars as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.functions import media
from heliograph.functions.text import original_of_edited
from heliograph.operators.relational import match_cascade, numbered
from heliograph.shared import cut
from heliograph.sources.ranges import system_of

#: Fields of a tab-separated gazetteer line, by position.
GAZETTEER = {"name": 1, "lat": 4, "lon": 5, "feature_code": 7, "country_code": 8, "admin1": 10, "population": 14}
GAZETTEER_FIELDS = 18
#: From so many folders of a level on, tasks list all that is below theirs; tasks of a level at most.
ENOUGH_FOLDERS, MOST_LISTERS = 64, 4096


def _list_folders(batches: Iterator[pd.DataFrame], deep: bool) -> Iterator[pd.DataFrame]:
    """The entries of some folders, without dot files; if deep, of all folders below them too, which are then no entries."""
    from pyarrow import fs

    for batch in batches:
        ahead = list(batch["path"])
        while ahead:
            path = ahead.pop()
            system, inner = system_of(path)
            found = [e for e in system.get_file_info(fs.FileSelector(inner)) if not e.base_name.startswith(".")]
            root = path.rstrip("/")
            if deep:
                ahead += [f"{root}/{e.base_name}" for e in found if not e.is_file]
                found = [e for e in found if e.is_file]
            yield pd.DataFrame({"path": [f"{root}/{e.base_name}" for e in found], "size": [e.size if e.is_file else None for e in found], "modified": [e.mtime_ns / 1e9 if e.mtime_ns else None for e in found], "folder": [not e.is_file for e in found]}).astype({"size": "Int64", "modified": "float64", "path": object})


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified) of all files below a folder that tasks can read, whatever their names but for dot files.

    Spark's own readers leave out names that begin with an underscore. Folders are listed in tasks: level by level until there
    are ENOUGH_FOLDERS, then each with all that is below it.
    """
    level, parts, count = spark.createDataFrame([(folder,)], "path string"), [], 1
    while count:
        deep = count >= ENOUGH_FOLDERS
        found = cut(level.mapInPandas(lambda batches, deep=deep: _list_folders(batches, deep), "path string, size long, modified double, folder boolean"), "listing")
        parts.append(found.where("not folder").select("path", "size", F.col("modified").cast("timestamp").alias("modified")))
        folders = found.where("folder").select("path")
        count = folders.count()
        level = folders.repartition(max(1, min(count, MOST_LISTERS)), "path")
    return reduce(DataFrame.unionAll, parts)


def scan_media(spark: SparkSession, folder: str, known: DataFrame | None = None, importable: bool = False) -> DataFrame:
    """(path, name, size, modified, mime_type) of the media files below folder, without dot files and known(path)."""
    files = list_files(spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -1))
    fits = media.is_media("name") | media.conversion_target("name").isNotNull() if importable else media.is_media("name")
    files = files.where(fits).select("path", "name", "size", "modified", media.mime_type("name").alias("mime_type"))
    return files.join(known.select("path").distinct(), "path", "left_anti") if known is not None else files


def import_listing(files: DataFrame, ident: str) -> DataFrame:
    """files(ident, name, size) to import, without originals whose edited twin is there, with total_size and place by lower-cased name."""
    low = F.lower("name")
    fits = files.where(media.is_media("name") | media.conversion_target("name").isNotNull())
    kept = fits.withColumn("low", low).join(files.select(F.lower(original_of_edited("name")).alias("low")).where("low is not null").distinct(), "low", "left_anti")
    total = kept.agg(F.sum("size").alias("total_size"))  # one row
    return numbered(kept, ["low", ident], "place").drop("low").join(F.broadcast(total))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Places of a tab-separated gazetteer; short lines and lines without coordinates are skipped."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(F.size(parts) >= GAZETTEER_FIELDS)
    field = lambda k: parts[GAZETTEER[k]]
    return lines.select(
        field("name").alias("name"),
        field("lat").try_cast("double").alias("lat"),
        field("lon").try_cast("double").alias("lon"),
        field("feature_code").alias("feature_code"),
        field("country_code").alias("country_code"),
        field("admin1").alias("admin1"),
        F.coalesce(field("population").try_cast("long"), F.lit(0)).alias("population"),
    ).where("lat is not null and lon is not null")


def read_admin1(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) of first-order divisions; none if there is no such file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "code string, name string")
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].alias("code"), parts[1].alias("name"))


_STAMP = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("formatted", T.StringType())])
_GEO = T.StructType([T.StructField(k, T.DoubleType()) for k in ("latitude", "longitude", "altitude")])
SIDECAR = T.StructType([*(T.StructField(k, T.StringType()) for k in ("title", "description", "imageViews", "url")), T.StructField("creationTime", _STAMP), T.StructField("photoTakenTime", _STAMP), T.StructField("geoData", _GEO)])


def first_bytes(c: Column, n: int) -> Column:
    """The longest prefix of whole characters within n bytes."""
    data = F.encode(F.left(c, F.lit(n)), "UTF-8")
    # A character takes four bytes at most, so one of four cuts falls between two characters.
    return F.coalesce(*[F.try_validate_utf8(F.substring(data, 1, n - k).cast("string")) for k in range(4)])


def parse_sidecar(json: Column) -> Column:
    """A normalised record of an import sidecar: times from epoch strings, zero coordinates as null, clipped texts."""
    raw = F.from_json(json, SIDECAR)
    when = lambda c: F.timestamp_seconds(c["timestamp"].try_cast("long"))
    return F.struct(
        first_bytes(raw["title"], 500).alias("title"),
        first_bytes(raw["description"], 2000).alias("description"),
        raw["imageViews"].try_cast("long").alias("views"),
        when(raw["creationTime"]).alias("created_at"),
        when(raw["photoTakenTime"]).alias("taken_at"),
        *[F.nullif(raw["geoData"][k], F.lit(0.0)).alias(k) for k in ("latitude", "longitude", "altitude")],
        first_bytes(raw["url"], 2048).alias("url"),
    )


def pair_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files(path) with the sidecar(path) that belongs to each: the long name before the short one."""
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    long = sidecars.select(F.col("path").alias("long_path"), F.regexp_extract("path", r"^(.*)\.supplemental-metadata\.json$", 1).alias("path")).where("path != ''")
    short = sidecars.select(F.col("path").alias("short_path"), F.regexp_extract("path", r"^(.*)\.json$", 1).alias("base")).where("base != ''")
    return files.withColumn("base", base).join(long, "path", "left").join(short, "base", "left").select("path", F.coalesce("long_path", "short_path").alias("sidecar"))


def unpaired_sidecars(sidecars: DataFrame, pairs: DataFrame, by_name: bool = False) -> DataFrame:
    """Sidecars that belong to no file, under either name (a sidecar of the short form that did pair is not listed).

    ``by_name`` asks only whether the name without the sidecar's ending is a file's: a short name has lost the file's
    extension, so sidecars of the short form are all listed, paired or not.
    """
    if not by_name:
        return sidecars.select("path").join(pairs.select(F.col("sidecar").alias("path")), "path", "left_anti")
    named = sidecars.select(F.col("path").alias("sidecar"), F.regexp_replace("path", r"(\.supplemental-metadata)?\.json$", "").alias("path"))
    return named.join(pairs.select("path"), "path", "left_anti").select(F.col("sidecar").alias("path"))


def match_metadata(files: DataFrame, sidecars: DataFrame, ident: str, value: str) -> DataFrame:
    """files(name, ...) with ``match``: the value of the sidecar(key, title, value) that describes each.

    By the first rule that fits: the file's name is the key; it is the title; its name without the extension is the key; it
    is an edited copy, and the original's name, or that without the extension, is the key. Of several sidecars the smallest value counts.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    name, original, key = F.col("name"), original_of_edited("name"), F.col("key")
    rules = [(name, key), (name, F.col("title")), (stem(name), key), (original, key), (stem(original), key)]
    return match_cascade(files, sidecars, ident, rules, value)
