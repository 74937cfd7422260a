"""Boundary cases of the column functions and operators on small literal tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import geo, media, text, time, vector
from heliograph.operators import clustering, merge, packing, relational, sessions
from heliograph.sources import files
from heliograph.plans import texts


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,clean",
    [("a\u0000b\u0007\u001b", "ab"), ("‮evil​", "evil"), ("  日本 العربية é 🙂 ", "日本 العربية é 🙂"), ("", ""), ("a\tb", "a\tb"), ("x\u0085y", "x\u0085y")],
)
def test_sanitize(spark, raw, clean):
    assert _one(spark, text.sanitize(F.lit(raw))) == clean


def test_names(spark):
    assert _one(spark, text.display_name(F.lit("  a \n  b  "), 3)) == "a b"
    assert _one(spark, text.display_name(F.lit(" \t "), 3)) is None
    assert _one(spark, text.filename(F.lit("../a/b\\c.txt"), F.lit("f"))) == "abc.txt"
    assert _one(spark, text.filename(F.lit("../"), F.lit("f"))) == "f"
    assert [_one(spark, text.is_relative_path(F.lit(p))) for p in ("a/b", "/a", "a/../b", "C:\\x", "", "a..b")] == [True, False, False, False, False, True]
    assert _one(spark, text.normalise_tag(F.lit(" Été "))) == "été" and _one(spark, text.normalise_tag(F.lit("x" * 101))) is None
    assert _one(spark, text.tag("person", F.lit(None).cast("string"))) == "person:Unknown"
    assert [_one(spark, text.original_of_edited(F.lit(n))) for n in ("a-edited.jpg", "A-EDITED.JPG", "a-edited-b.jpg", "a.jpg")] == ["a.jpg", "A.JPG", None, None]
    assert _one(spark, files.first_bytes(F.lit("éé€"), 5)) == "éé" and _one(spark, files.first_bytes(F.lit("abc"), 5)) == "abc"


def test_stems():
    assert text.stems("running") == ["running", "runn", "run"] and text.stems("boxes") == ["boxes", "box"]
    assert text.stems("cats") == ["cats"] and text.stems("birds") == ["birds", "bird"] and text.stems("action") == ["action", "act"] and text.stems("quickly") == ["quickly", "quick"]


def test_fuzzy(spark):
    hit = lambda t, q: _one(spark, text.fuzzy_matches(F.lit(t), q))
    assert hit("a picture of mountains", "mountain picture") and hit("mountian", "mountain") is False and hit("mountaim", "mountain") and not hit("valley", "mountain")


def test_times(spark):
    read = lambda s: _one(spark, time.normalise_timestamp(F.lit(s)))
    want = "2024-01-15T14:30:00.000Z"
    assert all(read(s) == want for s in ("2024-01-15T14:30:00Z", "2024-01-15T16:30:00+02:00", "2024-01-15T14:30:00", "2024:01:15 14:30:00", "2024-01-15 14:30:00", "2024-01-15 14:30:00 UTC", "1705329000", "1705329000000", " 2024-01-15T14:30:00.000Z "))
    assert read("2024-01-15") == "2024-01-15T00:00:00.000Z" and read("2024-01-15T14:30:00.123") == "2024-01-15T14:30:00.123Z" and read("soon") == "soon" and read("") == ""
    day = lambda s: F.lit(s).cast("date")
    assert _one(spark, time.range_label(day("2024-01-05"), day("2024-01-05"))) == "Jan 5, 2024"
    assert _one(spark, time.range_label(day("2024-01-05"), day("2024-02-07"))) == "Jan 5 – Feb 7, 2024"


def test_shapes(spark):
    shape = lambda w, h, s=None: _one(spark, media.aspect_subtype(F.lit(w), F.lit(h), F.lit(s).cast("string")))
    assert [shape(4000, 2000), shape(3000, 1500), shape(3600, 2000), shape(1000, 2500), shape(2000, 900), shape(0, 0), shape(4000, 2000, "burst")] == ["equirectangular", "panorama", None, "panorama", None, None, "burst"]
    assert _one(spark, media.mime_type(F.lit("A.HEIC"))) == "image/jpeg" and _one(spark, media.conversion_target(F.lit("a.jpg"))) is None
    assert _one(spark, media.xmp_attribute(F.lit("<x GCamera:MotionPhoto='1' b=\"2\"/>"), "GCamera:MotionPhoto")) == "1"
    ranges = [_one(spark, media.byte_range(F.lit(s), F.lit(1000))) for s in ("bytes=0-99", "bytes=-500", "bytes=990-", "bytes=1000-", "bytes=5-2", "bytes=-0", "x")]
    assert [tuple(r) if r else None for r in ranges] == [(0, 99), (500, 999), (990, 999), None, None, None, None]
    assert tuple(_one(spark, media.edit_flags(F.lit('{"cropWidth":0.5,"rotation":90}')))) == (True, True, False, False)


def test_geo(spark):
    assert _one(spark, geo.coordinate_key(F.lit(52.52004), F.lit(-13.40496))) == "52.5200,-13.4050"
    assert _one(spark, geo.degrees(F.lit(10), F.lit(30), F.lit(36), F.lit("s"))) == pytest.approx(-10.51)
    label = lambda *a: _one(spark, geo.address_label(*[F.lit(x).cast("string") for x in a]))
    assert label("5", "Main St", "other", "Town", "") == "5 Main St, Town" and label("", "", "Somewhere", None, "State") == "Somewhere, State" and label("", None, "", "", None) is None


def test_vectors(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert _one(spark, vector.cosine(arr(1.0, 0.0), arr(1.0, 1.0))) == pytest.approx(0.70710678)
    assert _one(spark, vector.cosine(arr(1.0), arr(1.0, 1.0))) == 0 and _one(spark, vector.cosine(arr(0.0), arr(1.0))) == 0


def test_clusters(spark):
    def sizes(rows, t):
        got = clustering.clusters(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", t).groupBy("cluster").count().collect()
        return sorted(r["count"] for r in got)

    assert sizes([(i, [1.0, 0.0]) for i in range(3)], 0.9) == [3]
    assert sizes([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])], 0.5) == [1, 1, 1]
    assert sizes([], 0.5) == []
    pair = [(0, [1.0, 0.0]), (1, [0.6, 0.8])]
    assert sizes(pair, 0.7) == [1, 1] and sizes(pair, 0.5) == [2]
    assert sizes([(0, [1.0, 0.0]), (1, [1.0]), (2, [1.0, 0.1])], 0.5) == [1, 2]


def test_blocks_meet_like_one_block(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole = sorted(map(tuple, clustering.similar_pairs(df, "vec_id", "embedding", 0.42).select("a", "b").collect()))
    assert sorted(map(tuple, clustering.similar_pairs(df, "vec_id", "embedding", 0.42, block=60).select("a", "b").collect())) == whole


def test_bursts_and_collapse(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 12, 0, s)
    rows = [(1, "c", at(0), 1.0, 1.0), (2, "c", at(2), None, None), (3, "c", at(5), 1.0, 1.0), (4, "d", at(5), 1.0, 1.0), (5, "d", at(6), 2.0, 1.0), (6, "d", at(7), 2.0, 1.0)]
    found = sessions.bursts(spark.createDataFrame(rows, "id long, camera string, taken timestamp, lat double, lon double"), "camera", "taken", "id", "lat", "lon")
    assert sorted(r["id"] for r in found.collect()) == [1, 2, 5, 6]
    frames = spark.createDataFrame([(1, "b", 3), (2, "b", 1), (3, None, 2), (4, "", 4), (5, "", 5)], "id long, burst string, at int")
    kept = relational.collapse(frames, "burst", "id", ["at"]).collect()
    assert sorted((r["id"], r["burst_count"]) for r in kept) == [(2, 2), (3, None), (4, None), (5, None)]


def test_pages_lose_no_row(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(20)], "id long, at long")
    seen, after = [], None
    while got := relational.page(rows, "at", "id", 4, after).collect():
        seen += [r["id"] for r in got]
        after = (got[-1]["at"], got[-1]["id"])
    assert seen == sorted(range(20), key=lambda i: (-(i // 3), i))


def test_packing_resets(spark):
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate([4.0, 4.0, 4.0, 20.0, 1.0, 9.0])], "k string, i long, size double")
    assert [r["part"] for r in packing.size_parts(rows, "k", ["i"], "size", 10.0).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]
    pics = spark.createDataFrame([("k", i, 1.5) for i in range(7)], "k string, i long, aspect double")
    laid = packing.justified_rows(pics, "k", ["i"], "aspect", 1000.0, 220.0).orderBy("i").collect()
    assert [r["row"] for r in laid] == [0, 0, 0, 1, 1, 1, 2] and laid[-1]["row_height"] == 220.0


def test_merge_rules(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    old, new = frame([(1, "a"), (2, "b")]), frame([(2, "x"), (3, "y")])
    assert sorted(map(tuple, merge.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, merge.upsert(old, new, ["k"], replace=False).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, merge.reconcile(old, new, "k", ["v"]).collect())) == [(1, "delete"), (2, "update"), (3, "insert")]


def test_exclusion_keeps_rows_without_a_value(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    hidden = spark.createDataFrame([(1,), (None,)], "k long")
    assert sorted(str(r["k"]) for r in relational.without(rows, "k", hidden).collect()) == ["2", "None"]


def test_files(spark, tmp_path):
    for name in ("a.jpg", ".hidden.jpg", "b.txt", "d/c.MP4", "d/e.heic"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["name"] for r in files.scan_media(spark, str(tmp_path)).collect()) == ["a.jpg", "c.MP4"]
    assert sorted(r["name"] for r in files.scan_media(spark, str(tmp_path), importable=True).collect()) == ["a.jpg", "c.MP4", "e.heic"]
    (tmp_path / "_deep" / "er").mkdir(parents=True)
    (tmp_path / "_deep" / "er" / "_DSC0001.jpg").write_bytes(b"12345")
    hidden = files.scan_media(spark, str(tmp_path)).where("name = '_DSC0001.jpg'").first()
    assert hidden["size"] == 5 and hidden["path"].endswith("_deep/er/_DSC0001.jpg") and hidden["modified"] is not None
    (tmp_path / "_deep" / "er" / "_DSC0001.jpg").unlink()
    assert files.read_admin1(spark, str(tmp_path / "absent.tsv")).count() == 0
    known = files.scan_media(spark, str(tmp_path)).where("name = 'a.jpg'")
    assert [r["name"] for r in files.scan_media(spark, str(tmp_path), known).collect()] == ["c.MP4"]
    (tmp_path / "places.tsv").write_text("\n".join(["1\tBerlin\tBerlin\t\t52.5\t13.4\tP\tPPLC\tDE\t\t16\t\t\t\t3426354\t\t\t", "short\tline", "2\tBad\tBad\t\tx\ty\tP\tPPL\tDE\t\t16\t\t\t\t1\t\t\t"]))
    assert [tuple(r) for r in files.read_gazetteer(spark, str(tmp_path / "places.tsv")).collect()] == [("Berlin", 52.5, 13.4, "PPLC", "DE", "16", 3426354)]


def test_sidecars(spark):
    raw = '{"title":"t","imageViews":"383","photoTakenTime":{"timestamp":"1705329000"},"geoData":{"latitude":0.0,"longitude":5.0,"altitude":0.0}}'
    got = _one(spark, files.parse_sidecar(F.lit(raw)))
    assert got["views"] == 383 and got["latitude"] is None and got["longitude"] == 5.0 and got["created_at"] is None
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    sidecars = paths("a.jpg.supplemental-metadata.json", "b.json", "lost.json")
    pairs = files.pair_sidecars(paths("a.jpg", "b.jpg", "c.jpg"), sidecars)
    assert sorted(map(str, map(tuple, pairs.collect()))) == sorted(map(str, [("a.jpg", "a.jpg.supplemental-metadata.json"), ("b.jpg", "b.json"), ("c.jpg", None)]))
    assert [r["path"] for r in files.unpaired_sidecars(sidecars, pairs).collect()] == ["lost.json"]


def test_pictures(spark):
    assert [_one(spark, media.camera(F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in (("Canon", "Canon EOS"), ("Apple", "iPhone"), (None, "X"), ("Y", ""))] == ["Canon EOS", "Apple iPhone", "X", "Y"]
    assert tuple(_one(spark, media.upright(F.lit(4), F.lit(3), F.lit(6)))) == (3, 4) and tuple(_one(spark, media.upright(F.lit(4), F.lit(3), F.lit(None).cast("int")))) == (4, 3)
    docs = ["<x GCamera:MotionPhoto='1' GPano:ProjectionType='cylindrical'/>", "<x GPano:ProjectionType='equirectangular'/>", "<x GCamera:BurstID='b'/>", "<x hdrgm:Version='1'/>", "<x/>"]
    assert [_one(spark, media.xmp_subtype(F.lit(d))) for d in docs] == ["motion", "equirectangular", "burst", "hdr", None]


def test_lockouts(spark):
    from heliograph.streaming import rate

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, "u", at(s), bad) for i, (s, bad) in enumerate([(0, True), (1, False), (2, True), (3, True), (4, False), (5, True), (14, True), (15, False)])]
    got = rate.lockouts(spark.createDataFrame(rows, "id long, u string, at timestamp, bad boolean"), "u", ["at", "id"], "at", "bad", 2, 10).orderBy("id").collect()
    assert [r["locked"] for r in got] == [False, False, False, False, True, True, False, False]


def test_times_do_not_depend_on_the_session_zone(spark):
    from heliograph.sources.tables import load

    first = lambda: load(spark, "/root/testdata/sf0.001", "events").agg(F.unix_micros(F.min("ts")).alias("t")).first()["t"]
    utc = first()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert first() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_size_labels_of_every_document(spark, tmp_path):
    sizes = [(1, 10), (2, 2048), (3, 1048576), (4, 3 * 1024**3), (5, None)]
    spark.createDataFrame(sizes, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["size"] for r in texts.size_labels(spark, str(tmp_path)).collect()}
    assert got == {1: "10 B", 2: "2.0 KB", 3: "1.0 MB", 4: "3.0 GB", 5: None}


def test_checksum_of_many_edges(spark):
    from heliograph.operators.components import checksum

    n = 1 << 25
    edges = spark.range(n).select(F.col("id").alias("u"), (F.col("id") * 3 + 1).alias("v"))
    mark = checksum(edges)
    assert mark["n"] == n and mark != checksum(edges.where("u != 7"))


def test_motion_offsets(spark):
    assert _one(spark, media.motion_offset(F.lit('<x GCamera:MicroVideoOffset="12" MotionVideoOffset="13">'))) == 12
    assert _one(spark, media.motion_offset(F.lit("<x GCamera:MotionVideoOffset='13'>"))) == 13
    container = '<i Item:Mime="image/jpeg" Item:Length="0" Item:Padding="9"/><i Item:Mime="video/mp4" Item:Length="500" {}/>'
    assert _one(spark, media.motion_offset(F.lit(container.format('Item:Padding="8"')))) == 508
    assert _one(spark, media.motion_offset(F.lit(container.format("")))) == 500
    assert _one(spark, media.motion_offset(F.lit("<x/>"))) is None
    assert _one(spark, media.marked_offset(F.lit(b"\xff\xd8MotionPhoto_Data..MotionPhoto_Data\x00\xfffilm"))) == 6
    assert _one(spark, media.marked_offset(F.lit(b"\xff\xd8MotionPhoto_Data"))) is None
    assert _one(spark, media.marked_offset(F.lit(b"\xff\xd8"))) is None


def test_decoded_floats(spark):
    values = np.array([0.0, -1.5, 3.14159, 1e-42, -3.4e38, np.inf, -np.inf, 2.0**-126, 7e-45], "<f4")
    assert _one(spark, vector.decode_floats(F.lit(values.tobytes() + b"ab"))) == values.tolist()
    assert np.isnan(_one(spark, vector.decode_floats(F.lit(np.array([np.nan], "<f4").tobytes())))[0])
    assert _one(spark, vector.decode_floats(F.lit(b"abc"))) == []
    assert _one(spark, vector.decode_floats(F.lit(None).cast("binary"))) is None


@pytest.mark.parametrize("seconds,label", [(0, "0s"), (59, "59s"), (60, "1m 0s"), (86400, "1d 0s"), (191523, "2d 5h 12m 3s")])
def test_uptime_label(spark, seconds, label):
    assert _one(spark, time.uptime_label(F.lit(seconds))) == label


@pytest.mark.parametrize("seconds,label", [(-3.0, "00:00:00"), (89.2, "00:01:30"), (3599.5, "01:00:00"), (360000.0, "100:00:00")])
def test_eta_label(spark, seconds, label):
    assert _one(spark, time.eta_label(F.lit(seconds))) == label


@pytest.mark.parametrize("seconds,label", [(-5, "just now"), (59, "just now"), (60, "1m ago"), (3600, "1h ago"), (86399, "23h ago"), (86400, "1d ago")])
def test_ago_label(spark, seconds, label):
    now = dt.datetime(2024, 3, 1, 12, 0, 0)
    assert _one(spark, time.ago_label(F.lit(now - dt.timedelta(seconds=seconds)), F.lit(now))) == label


def test_assignment(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.2]), (3, "a", [-1.0, 0.1]), (4, None, [1.0, 0.0])], "id long, label string, v array<double>")
    got = clustering.assign(rows, clustering.centroids(rows, "label", "v"), "label", "v", 0.42)
    assert {r["id"]: r["assigned"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_album_members_takes_more_tasks_for_more_lines(spark, monkeypatch):
    from heliograph.plans import joins

    monkeypatch.setattr(joins, "LINES", 500)
    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert joins.album_members(spark, folder).rdd.getNumPartitions() == lines // 500 + 1
