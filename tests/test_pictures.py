"""Ranged reads, EXIF and XMP of made files."""

import struct

import pytest
from pyspark.sql import functions as F

from heliograph.functions import media
from heliograph.plans.media import exif, frame, segment
from heliograph.sources import pictures, ranges


def _jpeg(main, photo=(), gps=(), order="<", size=(400, 300)):
    return b"\xff\xd8\xff\xff" + segment(0xE0, b"JFIF\0") + segment(0xE1, b"Exif\0\0" + exif(order, list(main), list(photo), list(gps))) + (frame(*size) if size else b"") + b"\xff\xda" + b"\0" * 50


def _said(spark, datas):
    rows = pictures.photo_metadata(spark.createDataFrame(list(enumerate(datas)), "id long, data binary").repartition(3)).collect()
    return {r["id"]: (r["width"], r["height"], r["camera"], r["latitude"], r["longitude"], r["taken_at"]) for r in rows}


GPS = [(1, 2, "N"), (2, 5, [(48, 1), (51, 1), (2952, 100)]), (3, 2, "E"), (4, 5, [(2, 1), (17, 1), (4020, 100)])]
TIME = [(0x9003, 2, "2024:01:15 14:30:00")]


@pytest.mark.parametrize("order", "<>")
def test_exif_rules(spark, order):
    lat, lon = 48 + 51 / 60 + 29.52 / 3600, 2 + 17 / 60 + 40.2 / 3600
    south = [(1, 2, "S"), GPS[1], (3, 2, "W"), GPS[3]]
    zero = [(1, 2, "N"), (2, 5, [(0, 1)] * 3), (3, 2, "E"), (4, 5, [(0, 1)] * 3)]
    cases = {
        "whole": (_jpeg([(0x010F, 2, "Canon"), (0x0110, 2, "Canon EOS"), (0x0112, 3, [1])], TIME, GPS, order), (400, 300, "Canon EOS", lat, lon, "2024-01-15T14:30:00Z")),
        "lying": (_jpeg([(0x010F, 2, "Apple"), (0x0110, 2, "iPhone"), (0x0112, 3, [6])], TIME, south, order), (300, 400, "Apple iPhone", -lat, -lon, "2024-01-15T14:30:00Z")),
        "eight": (_jpeg([(0x0112, 3, [8])], [], zero, order), (300, 400, None, None, None, None)),
        "nine": (_jpeg([(0x0112, 3, [9]), (0x010F, 2, "Only")], [(0x9003, 2, "2024:01:15")], [], order), (400, 300, "Only", None, None, None)),
        "own size": (_jpeg([(0x0112, 3, [5])], [(0xA002, 4, [800]), (0xA003, 3, [600])], [], order, size=None), (600, 800, None, None, None, None)),
        "no letter": (_jpeg([], [], [GPS[1], GPS[2], GPS[3]], order), (400, 300, None, None, None, None)),
        "no fraction": (_jpeg([], [], [GPS[0], (2, 5, [(48, 0), (1, 1), (1, 1)]), GPS[2], GPS[3]], order), (400, 300, None, None, None, None)),
        "two numbers": (_jpeg([], [], [GPS[0], (2, 5, [(48, 1), (1, 1)]), GPS[2], GPS[3]], order), (400, 300, None, None, None, None)),
        "case": (_jpeg([(0x010F, 2, "CANON"), (0x0110, 2, "Canon EOS")], [], [], order), (400, 300, "CANON Canon EOS", None, None, None)),
        "bare": (exif(order, [(0x010F, 2, "Scanner"), (0x0100, 4, [70]), (0x0101, 4, [50])], [], []), (70, 50, "Scanner", None, None, None)),
    }
    got = _said(spark, [d for d, _ in cases.values()])
    for i, (name, (_, want)) in enumerate(cases.items()):
        assert got[i][:3] + got[i][5:] == want[:3] + want[5:], name
        assert got[i][3:5] == (pytest.approx(want[3]) if want[3] is not None else None, pytest.approx(want[4]) if want[4] is not None else None), name


def test_other_kinds_and_corrupt_data(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII5s", 13, b"IHDR", 640, 480, b"\x08\x02\0\0\0") + b"crc!" + struct.pack(">I4s", 0, b"IDAT")
    inside = exif("<", [(0x0112, 3, [6])], [], [])
    exif_png = png[:-8] + struct.pack(">I4s", len(inside), b"eXIf") + inside + b"crc!" + struct.pack(">I4s", 0, b"IEND")
    got = _said(spark, [png, exif_png, b"GIF89a" + struct.pack("<HH", 30, 20), b"", None, b"\xff\xd8", b"\x89PNG\r\n\x1a\n", b"II*\0", b"text"])
    assert {i: w[:2] for i, w in got.items()} == {0: (640, 480), 1: (480, 640), 2: (30, 20)} | {i: (0, 0) for i in range(3, 9)}
    assert all(w[2:] == (None,) * 4 for w in got.values())
    whole = _jpeg([(0x010F, 2, "Canon"), (0x0112, 3, [6])], TIME, GPS)
    for end in range(len(whole)):
        pictures.picture_fields(whole[:end])
    for at in range(4, len(whole)):
        for value in (0, 0x7F, 0xFF):
            pictures.picture_fields(whole[:at] + bytes([value]) + whole[at + 1 :])


def test_xmp_rules(spark):
    cases = {
        "<x gcamera:MotionPhoto='1' GCamera:MotionVideoOffset='12'/>": ("motion", None, 12),
        '<x Camera:MicroVideo="True" MicroVideoOffset="7" MotionVideoOffset="8" GCamera:BurstID="b"/>': ("motion", "b", 7),
        '<x MotionPhoto="0" hdrgm:Version="1"/>': ("hdr", None, None),
        "<x MotionPhoto='False' MotionVideoOffset='8'/>": (None, None, None),
        '<x GPano:ProjectionType="Cylindrical" BurstID=" 9 "/>': ("panorama", "9", None),
        '<x ProjectionType="little planet" BurstID="9" HDRGainMap=""/>': ("burst", "9", None),
        '<x MotionPhoto="2"/><i Item:Length="5" Item:Mime="image/jpeg"/><i Item:Mime="video/mp4" Item:Length="500" Item:Padding="8"/>': ("motion", None, 508),
        '<x MotionPhoto="1" MicroVideoOffset="-3"/>': ("motion", None, None),
        "�": (None, None, None),
    }
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(cases)] + [(90, None), (91, b"\xff\xd8\xff" + next(iter(cases)).encode()), (92, b"\xfe" * (129 << 10) + next(iter(cases)).encode())], "id long, data binary")
    got = {r["id"]: (r["subtype"], r["burst_id"], r["motion_offset"]) for r in pictures.photo_kinds(df).collect()}
    assert got == dict(enumerate(cases.values())) | {90: (None, None, None), 91: ("motion", None, 12), 92: (None, None, None)}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    for name, size in (("a.jpg", 1_000_000), ("deep/_b.jpg", 300), ("deep/er/c d%.jpg", 5), ("empty", 0), (".dot", 9), (".hidden/x", 9)):
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(size)))
    return tmp_path


def test_only_the_ends_are_read(spark, folder, monkeypatch):
    whole = {str(p): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not any(x.startswith(".") for x in p.relative_to(folder).parts)}
    found = {r["path"]: r for r in ranges.read_ranges(spark, str(folder), suffix=7).collect()}
    assert set(found) == set(whole) and len(found) == 4
    for path, data in whole.items():
        r = found[path]
        assert (r["size"], bytes(r["prefix"]), bytes(r["suffix"])) == (len(data), data[: 256 << 10], data[-7:])
        assert len(r["prefix"]) <= 256 << 10
    asked = []
    real = ranges.read_slice
    monkeypatch.setattr(ranges, "read_slice", lambda path, spans: asked.append(spans) or real(path, spans))
    reader = ranges.FileRangesReader({"path": str(folder), "partitionBytes": "300000"})
    deals = reader.partitions()
    assert len(deals) == 2 and sum(len(d.files) for d in deals) == 4
    rows = [r for d in deals for r in reader.read(d)]
    assert all(len(r[2]) <= 256 << 10 and r[3] is None for r in rows) and all(s[0][1] < 256 << 10 for s in asked)
    assert spark.read.format("file_ranges").option("path", f"file://{folder}").option("prefix", 3).load().where("path like '%a.jpg'").first()["prefix"] == b"\0\1\2"


def test_slices_of_a_table_of_files(spark, folder):
    files = spark.createDataFrame([(str(folder / n), s, r) for n, s, r in (("a.jpg", 1_000_000, "bytes=5-9"), ("deep/_b.jpg", 300, "bytes=-4"), ("empty", 0, "bytes=0-"), ("gone", 10, "bytes=0-3"), ("a.jpg", 1_000_000, "junk"))] + [(None, 1, "bytes=0-0")], "path string, size long, spec string")
    got = ranges.read_slices(files, {"part": media.byte_range("spec", "size"), "head": ranges.prefix_span(2), "tail": ranges.suffix_span("size", 1)}).collect()
    seen = [tuple(None if v is None else bytes(v) for v in (r["part"], r["head"], r["tail"])) for r in got]
    assert seen == [(b"\5\6\7\10\11", b"\0\1", bytes([999_999 % 251])), (bytes(i % 251 for i in range(296, 300)), b"\0\1", bytes([299 % 251])), (None, b"", b""), (None, None, None), (None, b"\0\1", bytes([999_999 % 251])), (None, None, None)]
    assert [r["spec"] for r in got][:2] == ["bytes=5-9", "bytes=-4"]
    many = spark.createDataFrame([(str(folder / "a.jpg"), i) for i in range(40)], "path string, n long").coalesce(1)
    assert ranges.read_slices(many, {"part": ranges.prefix_span(900_000)}).agg(F.sum(F.octet_length("part"))).first()[0] == 40 * 900_000
