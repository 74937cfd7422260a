"""Archives of library files in parts of a bounded size."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from heliograph.operators.packing import archive_entries
from heliograph.shared import cut
from heliograph.sources.ranges import system_of

MANIFEST = "manifest.json"
#: Kinds that are not exported, and the extension of a file without a name, by kind.
LEFT_OUT = ["thumbnail", "video_thumbnail"]
EXTENSIONS = {"photo": "jpg", "gif": "gif", "video": "mp4", "audio": "mp3", "album_manifest": "json"}


def entry_name(kind: str, name: str, ident: str) -> Column:
    """The path of a file in an archive: by its name, else by its id and kind; manifests of albums lie apart."""
    extension = F.coalesce(*[F.when(F.col(kind) == k, F.lit(e)) for k, e in EXTENSIONS.items()], F.lit("dat"))
    file = F.coalesce(F.col(name), F.concat(F.col(ident).cast("string"), F.lit("."), extension))
    return F.concat(F.when(F.col(kind) == "album_manifest", "metadata/").otherwise("photos/"), file)


def manifest(files: DataFrame, key: str, order: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a manifest consists of: (key, turn, order, piece) rows, and (key, bytes) of the whole.

    It is one JSON list for each key: a head with the number of files, then the named fields of each file, thumbnails too.
    It stays in pieces, a row a file, until a writer streams them into the archive.
    """
    said = files.select(key, *[c for c in order if c != key], F.concat(F.lit(","), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).alias("piece"))
    sums = said.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("piece")).alias("bytes"))
    head = F.concat(F.lit('[{"export_version":1,"count":'), F.col("n").cast("string"), F.lit("}"))
    empty = [F.lit(None).cast(files.schema[c].dataType).alias(c) for c in order if c != key]
    ends = sums.select(key, F.lit(0).alias("turn"), *empty, head.alias("piece")).unionAll(sums.select(key, F.lit(2).alias("turn"), *empty, F.lit("]")))
    pieces = ends.unionAll(said.select(key, F.lit(1).alias("turn"), *[c for c in order if c != key], "piece"))
    return pieces, sums.select(key, (F.col("bytes") + F.octet_length(head) + 1).alias("bytes"))


def plan_export(files: DataFrame, key: str, order: list[str], limit: float, overhead: float = 100.0, fields: list[str] | None = None) -> DataFrame:
    """(key, part, at, entry, data) of files(key, ident, kind, name, data, ...): what stands where in which archive.

    The manifest comes first in a key's first part, in pieces: rows of one entry that follow each other are one entry. Thumbnails
    and files without data are left out; names are free within their part, from the second use on with _(2) and so on. A part
    is closed when the next file and ``overhead`` bytes would pass the limit; a larger file is a part of its own. A null key is a key.
    """
    pieces, sizes = manifest(files, key, order, fields or [c for c in files.columns if c not in (key, "data")])
    rest = [c for c in order if c != key]
    kept = files.where(F.col("data").isNotNull() & ~F.coalesce(F.col("kind").isin(LEFT_OUT), F.lit(False)))
    sized = kept.select(key, *rest, entry_name("kind", "name", "ident").alias("path"), F.octet_length("data").alias("size"), "data")
    # A key's files are one task's fold, so their data stay out of it.
    held = cut(sized.withColumn("__row", F.monotonically_increasing_id()), "files")
    lengths = sizes.select(F.col(key).alias("__key"), F.col("bytes").alias("__first"))
    whole = held.drop("data").join(lengths, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    placed = archive_entries(whole, key, order, "size", "path", limit, overhead, "__first").join(held.select("__row", "data"), "__row")
    rows = placed.select(key, "part", F.struct(F.lit(3).alias("turn"), *rest).alias("at"), "entry", "data")
    first = pieces.select(key, F.lit(0).cast("long").alias("part"), F.struct("turn", *rest).alias("at"), F.lit(MANIFEST).alias("entry"), F.encode("piece", "UTF-8").alias("data"))
    return rows.unionAll(first)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (as written, as it will be called)


class ZipParts(DataSource):
    """``df.write.format("zip_parts").save(folder)`` of rows (name, entry, data), those of one archive together and in order.

    Rows of one entry that follow each other are its pieces.

    An archive streams to a file of its own attempt. Only the commit gives files their names; the files of attempts that
    failed are removed, so each archive is there once, whole, or not at all.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_parts"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ZipPartsWriter(self.options["path"])


class ZipPartsWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.attempts = f"{self.folder}/.attempts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, inner = system_of(self.attempts)
        system.create_dir(inner, recursive=True)
        done: list[tuple[str, str]] = []
        for name, mine in groupby(rows, key=lambda r: r["name"]):
            done.append((f"{inner}/{uuid.uuid4().hex}", name))
            with system.open_output_stream(done[-1][0]) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
                for entry, pieces in groupby(mine, key=lambda r: r["entry"]):
                    about = zipfile.ZipInfo(entry)
                    about.compress_type = zipfile.ZIP_DEFLATED
                    with archive.open(about, "w", force_zip64=True) as out:
                        for row in pieces:
                            out.write(bytes(row["data"]))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = system_of(self.folder)
        for made, name in [f for m in messages if m for f in m.files]:
            system.move(made, f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, inner = system_of(self.attempts)
        if system.get_file_info(inner).type != fs.FileType.NotFound:
            system.delete_dir(inner)


def archive_name(key: str) -> Column:
    """A name for an archive of a key and part that no other has: a digest of the key keeps odd ones apart."""
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    return F.concat(F.substring(F.sha2(text, 256), 1, 16), F.lit("-"), F.lpad((F.col("part") + 1).cast("string"), 6, "0"), F.lit(".zip"))


def write_archives(planned: DataFrame, key: str, folder: str) -> None:
    """Write what plan_export gives: one archive a key and part, each by one task, as its rows stream in order."""
    planned.sparkSession.dataSource.register(ZipParts)
    rows = planned.withColumn("name", archive_name(key)).repartition("name").sortWithinPartitions("name", "at").select("name", "entry", "data")
    rows.write.format("zip_parts").mode("append").save(folder)


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, data in zip(batch["name"], batch["data"]):
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                infos = archive.infolist()
                yield pd.DataFrame({"name": name, "place": range(len(infos)), "entry": [i.filename for i in infos], "size": [i.file_size for i in infos], "crc": [zlib.crc32(archive.read(i)) for i in infos]})


def list_archives(spark, folder: str) -> DataFrame:
    """(name, place, entry, size, crc) of all entries of the archives in a folder, as they are read back; an archive is one row in memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))
    return named.mapInPandas(_listed, "name string, place int, entry string, size long, crc long")
