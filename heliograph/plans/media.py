"""Pictures: their headers are made from table rows, written where that matters, and read back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from heliograph.plans.family import family
from heliograph.shared import cut, new_folder, remove_folder
from heliograph.sources import pictures, ranges
from heliograph.sources.tables import load

QUERIES, ORACLES, query = family()


def exif(order: str, main: list, photo: list, gps: list) -> bytes:
    """EXIF data in one byte order of three directories of (tag, type, values): text, shorts, or pairs of a fraction."""
    header = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    directories = [main + [(0x8769, 4, [0]), (0x8825, 4, [0])], photo, gps]
    starts = [8]
    for entries in directories[:2]:
        starts.append(starts[-1] + 6 + 12 * len(entries))
    directories[0][-2:] = [(0x8769, 4, [starts[1]]), (0x8825, 4, [starts[2]])]
    behind = starts[2] + 6 + 12 * len(gps)
    out, tail = header, b""
    for entries in directories:
        out += struct.pack(order + "H", len(entries))
        for tag, kind, values in entries:
            raw = values.encode() + b"\0" if kind == 2 else struct.pack(order + str(len(values) * (2 if kind == 5 else 1)) + {3: "H", 4: "I", 5: "I"}[kind], *(x for v in values for x in (v if kind == 5 else [v])))
            field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", behind + len(tail))
            out += struct.pack(order + "HHI", tag, kind, len(raw) if kind == 2 else len(values)) + field
            tail += raw if len(raw) > 4 else b""
        out += struct.pack(order + "I", 0)
    return out + tail


def segment(kind: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data


def frame(width: int, height: int) -> bytes:
    """The segment that tells a picture's size."""
    return segment(0xC0, struct.pack(">BHHB", 8, height, width, 0))


def _pictures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A picture's header for each customer; every thirteenth is cut off in its directories."""
    for batch in batches:
        made = []
        for k, maker in zip(batch["c_custkey"], batch["c_mktsegment"]):
            main = [(0x0110, 2, f"{maker} {k}" if k % 3 == 0 else f"M{k}")]
            main += [(0x010F, 2, maker)] if k % 7 else []
            main += [(0x0112, 3, [k % 9])] if k % 9 else []
            photo = [(0x9003, 2, f"{2000 + k % 20}:{1 + k % 12:02}:{1 + k % 28:02} {k % 24:02}:{k % 60:02}:{k % 59:02}"), (0xA002, 4, [k % 4000]), (0xA003, 4, [k % 3000])]
            if k % 11 == 0:
                place = [[(0, 1)] * 3] * 2
            else:
                place = [[(k % 90, 1), (k % 60, 1), (k % 6000, 100)], [(k % 180, 1), (k % 59, 1), (k % 4500, 100)]]
            gps = [(1, 2, "NS"[k % 2]), (2, 5, place[0]), (3, 2, "EW"[k % 5 == 0]), (4, 5, place[1])]
            size = frame(1000 + k % 500, 700 + k % 300) if k % 4 else b""
            data = b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + exif("<>"[k % 2], main, photo, gps)) + size + b"\xff\xda"
            made.append(data[:24] if k % 13 == 0 else data)
        yield pd.DataFrame({"c_custkey": batch["c_custkey"], "data": made})


@query("""
    WITH k AS (
        SELECT c_custkey, c_mktsegment AS maker, c_custkey % 13 <> 0 AS whole, c_custkey % 4 <> 0 AS own, c_custkey % 9 >= 5 AS turned,
            CASE WHEN c_custkey % 4 <> 0 THEN 1000 + c_custkey % 500 ELSE c_custkey % 4000 END AS w,
            CASE WHEN c_custkey % 4 <> 0 THEN 700 + c_custkey % 300 ELSE c_custkey % 3000 END AS h,
            c_custkey % 90 + (c_custkey % 60) / 60::DOUBLE + ((c_custkey % 6000) / 100::DOUBLE) / 3600 AS lat,
            c_custkey % 180 + (c_custkey % 59) / 60::DOUBLE + ((c_custkey % 4500) / 100::DOUBLE) / 3600 AS lon
        FROM customer)
    SELECT c_custkey,
        CASE WHEN NOT whole THEN 0 WHEN turned AND w > 0 AND h > 0 THEN h ELSE w END AS width, CASE WHEN NOT whole THEN 0 WHEN turned AND w > 0 AND h > 0 THEN w ELSE h END AS height,
        CASE WHEN NOT whole THEN NULL WHEN c_custkey % 3 = 0 THEN maker || ' ' || c_custkey WHEN c_custkey % 7 = 0 THEN 'M' || c_custkey ELSE maker || ' M' || c_custkey END AS camera,
        CASE WHEN whole AND c_custkey % 11 <> 0 THEN round(CASE WHEN c_custkey % 2 = 1 THEN -lat ELSE lat END, 9) END AS latitude,
        CASE WHEN whole AND c_custkey % 11 <> 0 THEN round(CASE WHEN c_custkey % 5 = 0 THEN -lon ELSE lon END, 9) END AS longitude,
        CASE WHEN whole THEN format('{}-{:02}-{:02}T{:02}:{:02}:{:02}Z', 2000 + c_custkey % 20, 1 + c_custkey % 12, 1 + c_custkey % 28, c_custkey % 24, c_custkey % 60, c_custkey % 59) END AS taken_at
    FROM k""")
def exif_metadata(spark, sf_dir):
    """What the EXIF fields of a picture made for each customer say."""
    made = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").mapInPandas(_pictures, "c_custkey long, data binary")
    return pictures.photo_metadata(made).withColumns({"latitude": F.round("latitude", 9), "longitude": F.round("longitude", 9)})


def _write_pictures(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A file for each supplier: a document in its first segment, up to 400 KB of picture, and a film at the end."""
        system, inner = ranges.system_of(folder)
        for batch in batches:
            for k, name in zip(batch["s_suppkey"], batch["s_name"]):
                words = ["", f"gcamera:MotionPhoto='{k % 3}' x:MotionVideoOffset=\"{k}\"", 'GPano:ProjectionType="Equirectangular"', "GPano:ProjectionType='fisheye' GCamera:BurstID='b'", f'GCamera:BurstID="{name}" hdrgm:Version="1.0"', 'hdrgm:Version="1.0"', 'Camera:MicroVideo="true"'][k % 7]
                item = f'<item Item:Mime="video/mp4" Item:Length="{k}" Item:Padding="8"/>' if k % 7 == 6 else ""
                document = b"http://ns.adobe.com/xap/1.0/\0" + f"<x:xmpmeta {words}>{item}</x:xmpmeta>".encode()
                late = b"\xff" * (400_000 if k % 10 == 3 else 0)  # the document comes too late to be found
                with system.open_output_stream(f"{inner}/{k}.jpg") as file:
                    file.write(b"\xff\xd8" + late + segment(0xE1, document) + b"\xfe" * (k % 5 * 100_000) + b"film")
            yield pd.DataFrame({"s_suppkey": batch["s_suppkey"]})

    return run


@query("""
    WITH k AS (SELECT s_suppkey AS k, s_name, s_suppkey % 10 <> 3 AS near, s_suppkey % 7 AS kind FROM supplier
    ), said AS (
        SELECT *, CASE WHEN NOT near THEN NULL WHEN kind = 1 AND k % 3 > 0 OR kind = 6 THEN 'motion' WHEN kind = 2 THEN 'equirectangular'
            WHEN kind = 3 THEN 'panorama' WHEN kind = 4 THEN 'burst' WHEN kind = 5 THEN 'hdr' END AS subtype FROM k)
    SELECT k AS s_suppkey, subtype, CASE WHEN near AND kind = 3 THEN 'b' WHEN near AND kind = 4 THEN s_name END AS burst_id,
        CASE WHEN subtype = 'motion' THEN k + CASE WHEN kind = 6 THEN 8 ELSE 0 END END AS motion_offset, 'film' AS ending, true AS bounded
    FROM said""")
def picture_kinds(spark, sf_dir):
    """Kinds and films of pictures written for each supplier, from the first 256 KB and the last four bytes of each file."""
    folder = new_folder(spark, "pictures")
    cut(load(spark, sf_dir, "supplier").select("s_suppkey", "s_name").mapInPandas(_write_pictures(folder), "s_suppkey long"), "written")
    ends = ranges.read_ranges(spark, folder, prefix=ranges.PREFIX, suffix=4)
    bounded = F.octet_length("prefix") <= ranges.PREFIX
    said = pictures.photo_kinds(ends.select(F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("long").alias("s_suppkey"), F.col("suffix").cast("string").alias("ending"), bounded.alias("bounded"), "prefix"), "prefix")
    found = cut(said.select("s_suppkey", "subtype", "burst_id", "motion_offset", "ending", "bounded"), "kinds")
    remove_folder(spark, folder)
    return found
