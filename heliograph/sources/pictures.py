"""What pictures say about themselves: sizes, camera, place and time from EXIF, kinds and films from XMP.

A parser reads the few segments and directories that matter, with every offset checked against the data; the rules that
make values of them are Column expressions. Corrupt or foreign data give nulls, never an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions import media

#: The tags that are read, by directory, and those that point to another directory.
TAGS = {
    "main": {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0100: "columns", 0x0101: "rows"},
    "photo": {0x9003: "taken", 0xA002: "pixel_x", 0xA003: "pixel_y"},
    "gps": {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"},
}
POINTERS = {0x8769: "photo", 0x8825: "gps"}
#: Bytes of one value, by type.
WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
#: Values of one entry that are read at most; texts are clipped there, and no numeric tag here has more than three.
MOST_VALUES = 1024

FIELDS = "width long, height long, make string, model string, orientation long, taken string, pixel_x long, pixel_y long, lat array<double>, lat_ref string, lon array<double>, lon_ref string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _value(data: bytes, order: str, kind: int, count: int, at: int):
    """An entry's value: text, the first whole number, or three fractions; None if it lies outside or makes no sense."""
    size = WIDTH.get(kind, 0) * count
    if not 0 < size or count > MOST_VALUES and kind != 2:
        return None
    if size > 4:
        (at,) = struct.unpack_from(order + "I", data, at)
    raw = data[at : at + min(size, MOST_VALUES)]
    if len(raw) < min(size, MOST_VALUES):
        return None
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None
    if kind in (1, 3, 4):
        return struct.unpack_from(order + {1: "B", 3: "H", 4: "I"}[kind], raw)[0]
    if kind == 5 and count >= 3:
        parts = struct.unpack_from(order + "6I", raw)
        return [a / b for a, b in zip(parts[::2], parts[1::2])] if all(parts[1::2]) else None
    return None


def directories(data: bytes) -> dict:
    """The wanted tags of the directories in EXIF data, in either byte order."""
    found: dict = {}
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        return found
    ahead = [("main", struct.unpack_from(order + "I", data, 4)[0])]
    while ahead:
        name, at = ahead.pop(0)
        if at + 2 > len(data):
            continue
        (entries,) = struct.unpack_from(order + "H", data, at)
        for entry in range(at + 2, min(at + 2 + 12 * entries, len(data) - 11), 12):
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if name == "main" and tag in POINTERS and kind == 4:
                ahead.append((POINTERS[tag], struct.unpack_from(order + "I", data, entry + 8)[0]))
            elif tag in TAGS[name]:
                value = _value(data, order, kind, count, entry + 8)
                if value is not None:
                    found.setdefault(TAGS[name][tag], value)
    return found


def _segments(data: bytes) -> dict:
    """Size and EXIF fields of a JPEG file, up to its picture data."""
    found: dict = {}
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:  # filling
            at += 1
            continue
        if kind in (0xD8, 0x01) or 0xD0 <= kind <= 0xD7:  # no length
            at += 2
            continue
        if kind in (0xD9, 0xDA):
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(data):
            found["height"], found["width"] = struct.unpack_from(">HH", data, at + 5)
        elif kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            found = directories(data[at + 10 : at + 2 + size]) | found
        at += 2 + max(2, size)
    return found


def _chunks(data: bytes) -> dict:
    """Size and EXIF fields of a PNG file."""
    found: dict = {}
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR" and at + 16 <= len(data):
            found["width"], found["height"] = struct.unpack_from(">II", data, at + 8)
        elif kind == b"eXIf":
            found = directories(data[at + 8 : at + 8 + size]) | found
        elif kind in (b"IDAT", b"IEND"):
            break
        at += 12 + size
    return found


def picture_fields(data: bytes | None) -> dict:
    """The raw fields of a picture's bytes; {} if there are none."""
    data = data or b""
    if data[:2] == b"\xff\xd8":
        return _segments(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _chunks(data)
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return dict(zip(("width", "height"), struct.unpack_from("<HH", data, 6)))
    found = directories(data)
    return found | {"width": found.get("columns"), "height": found.get("rows")} if found else found


_ARROW = pa.struct([(n, {"long": pa.int64(), "string": pa.string()}.get(k, pa.list_(pa.float64()))) for n, k in (f.split(" ", 1) for f in FIELDS.split(", "))])


def with_fields(df: DataFrame, data: str = "data") -> DataFrame:
    """df with a struct ``fields`` of what the binary column says, in place of that column."""
    kept = [c for c in df.columns if c not in (data, "fields")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [picture_fields(d.as_py()) for d in batch.column(data)]
            rows = [{n: f.get(n) if isinstance(f.get(n), list if n in ("lat", "lon") else str if n in ("make", "model", "taken", "lat_ref", "lon_ref") else int) else None for n in NAMES} for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, _ARROW)], names=[*kept, "fields"])

    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes if c in kept] + [f"fields struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>"])
    return df.select(*kept, data).mapInArrow(run, schema)


def photo_metadata(df: DataFrame, data: str = "data") -> DataFrame:
    """df with width, height, camera, latitude, longitude and taken_at from a binary column of whole files or their prefixes.

    Sizes are as shown (orientations 5 to 8 lie on their side), 0 if unknown; the fields' own sizes count only where the
    picture names none. A make that the model begins with is not repeated. South and west are negative; (0, 0), three
    numbers that make no fraction, or a missing letter are no place. Times are ``YYYY-MM-DDTHH:MM:SSZ``, as written.
    """
    f = F.col("fields")
    own = (F.coalesce(f["width"], F.lit(0)) > 0) & (F.coalesce(f["height"], F.lit(0)) > 0)
    size = lambda mine, theirs: F.when(own, f[mine]).otherwise(F.coalesce(f[theirs], f[mine], F.lit(0)))
    w, h = size("width", "pixel_x"), size("height", "pixel_y")
    turned = media.upright(w, h, F.when((w > 0) & (h > 0), f["orientation"]))
    decimal = lambda v, ref, back: (v[0] + v[1] / 60 + v[2] / 3600) * F.when(F.contains(ref, F.lit(back)), -1).otherwise(1)
    lat, lon = decimal(f["lat"], f["lat_ref"], "S"), decimal(f["lon"], f["lon_ref"], "W")
    placed = f["lat_ref"].isNotNull() & f["lon_ref"].isNotNull() & lat.isNotNull() & lon.isNotNull() & ((F.abs(lat) > 1e-7) | (F.abs(lon) > 1e-7))
    part = lambda at, n: F.substring(f["taken"], at, n)
    taken = F.when(F.length(f["taken"]) >= 19, F.concat(part(1, 4), F.lit("-"), part(6, 2), F.lit("-"), part(9, 2), F.lit("T"), part(12, 8), F.lit("Z")))
    return with_fields(df, data).withColumns({
        "width": turned["width"],
        "height": turned["height"],
        "camera": media.camera(f["make"], f["model"]),
        "latitude": F.when(placed, lat),
        "longitude": F.when(placed, lon),
        "taken_at": taken,
    }).drop("fields")


def photo_kinds(df: DataFrame, data: str = "data") -> DataFrame:
    """df with subtype, burst_id and, for films, motion_offset from the XMP document at the beginning of a binary column, which goes."""
    text = media.xmp_text(data)
    return df.withColumn("__xmp", text).withColumns({"subtype": media.xmp_subtype("__xmp"), "burst_id": media.xmp_attribute("__xmp", "BurstID"), "motion_offset": F.when(media.xmp_subtype("__xmp") == "motion", media.motion_offset("__xmp"))}).drop("__xmp", data)
