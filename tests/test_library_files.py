"""Exports, synchronisation, tails and search indexes that leave files behind."""

import datetime as dt
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from heliograph.functions import text
from heliograph.operators import export, packing, search, sync
from heliograph.streaming import rate, tail


# --- folds


def _fold(spark, rows, schema, call):
    return {r["i"]: tuple(r[c] for c in call[1]) for r in call[0](spark.createDataFrame(rows, schema).repartition(3)).collect()}


def test_folds_over_null_keys_and_values(spark):
    rows = [(k, i, None if i == 3 else float("nan") if i == 4 else 4.0) for k in (None, 7) for i in range(8)]
    rows = [(k, i + (100 if k else 0), s) for k, i, s in rows]
    parts = _fold(spark, rows, "k long, i long, size double", (lambda d: packing.size_parts(d, "k", ["i"], "size", 10.0), ["part", "k", "size"]))
    want = [0, 0, 1, 1, 1, 1, 2, 2]
    assert [parts[i][0] for i in range(8)] == [parts[100 + i][0] for i in range(8)] == want
    assert parts[3][2] is None and parts[0][1] is None and parts[101][1] == 7
    big = [(2**60, 1, 6.0), (2**60 + 1, 2, 6.0), (None, 3, 6.0)]  # keys keep all their digits
    got = packing.size_parts(spark.createDataFrame(big, "k long, i long, size double"), "k", ["i"], "size", 10.0).collect()
    assert {(r["k"], r["part"]) for r in got} == {(2**60, 0), (2**60 + 1, 0), (None, 0)}
    laid = _fold(spark, [(None, i, 2.0) for i in range(7)], "k string, i long, aspect double", (lambda d: packing.justified_rows(d, "k", ["i"], "aspect", 1000.0, 220.0), ["row", "row_height"]))
    assert [laid[i][0] for i in range(7)] == [0, 0, 1, 1, 2, 2, 3] and laid[6][1] == 220.0
    at = dt.datetime(2024, 1, 1)
    asks = [(None, i, at + dt.timedelta(seconds=i) if i != 2 else None) for i in range(6)]
    allowed = _fold(spark, asks, "k long, i long, at timestamp", (lambda d: rate.admitted(d, "k", ["at", "i"], "at", 2, 60), ["allowed"]))
    assert [allowed[i][0] for i in range(6)] == [True, True, True, False, False, False]
    tries = [(None, i, at + dt.timedelta(seconds=i), None if i == 1 else True) for i in range(6)]
    locked = _fold(spark, tries, "k long, i long, at timestamp, bad boolean", (lambda d: rate.lockouts(d, "k", ["at", "i"], "at", "bad", 2, 3), ["locked"]))
    assert [locked[i][0] for i in range(6)] == [False, False, False, True, True, False]
    assert packing.size_parts(spark.createDataFrame([], "k long, i long, size double, part string"), "k", ["i"], "size", 1.0).columns == ["k", "i", "size", "part"]


def test_names_are_used_once(spark):
    names = ["a.jpg", "a.jpg", "a_(2).jpg", "a.jpg", "b", "b", "c.tar.gz", "c.tar.gz", None, "a_(2).jpg"]
    rows = [("k", i, n) for i, n in enumerate(names)] + [(None, 50, "a.jpg"), (None, 51, "a.jpg")]
    got = _fold(spark, rows, "k string, i long, name string", (lambda d: packing.named_once(d, ["k"], "name", ["i"]), ["entry"]))
    entries = [got[i][0] for i in range(10)]
    assert entries[:2] == ["a.jpg", "a_(2).jpg"] and entries[3:9] == ["a_(3).jpg", "b", "b_(2)", "c.tar.gz", "c.tar_(2).gz", None]
    assert len({e for e in entries if e}) == 9 and got[50][0] == "a.jpg" and got[51][0] == "a_(2).jpg"


# --- archives


def _files(spark):
    rows = [("u", i, "photo", "a.txt", bytearray(b"x" * 300)) for i in range(3)]
    rows += [("u", 3, "thumbnail", "t.jpg", bytearray(b"t")), ("u", 4, "video", None, bytearray(b"v" * 10)), ("u", 5, "album_manifest", None, bytearray(b"{}")), ("u", 6, "odd", "big.bin", bytearray(b"z" * 5000)), ("u", 7, None, None, bytearray(b""))]
    rows += [(None, 8, "photo", "a.txt", bytearray(b"n")), (None, 9, "photo", "gone.txt", None)]
    return spark.createDataFrame(rows, "owner string, ident long, kind string, name string, data binary")


def test_archives_are_whole_and_in_order(spark, tmp_path):
    planned = export.plan_export(_files(spark).repartition(4), "owner", ["ident"], 1000.0, fields=["ident", "kind"])
    export.write_archives(planned, "owner", f"file://{tmp_path}/out")
    made = sorted((tmp_path / "out").iterdir())
    assert len(made) == 5 and all(p.suffix == ".zip" for p in made)
    keys = {r["name"]: (r["owner"], r["part"]) for r in planned.select("owner", "part", export.archive_name("owner").alias("name")).distinct().collect()}
    found = {keys[p.name]: zipfile.ZipFile(p) for p in made}
    assert {k: z.namelist() for k, z in found.items()} == {
        ("u", 0): ["manifest.json", "photos/a.txt", "photos/a_(2).txt"],
        ("u", 1): ["photos/a.txt", "photos/4.mp4", "metadata/5.json"],
        ("u", 2): ["photos/big.bin"],
        ("u", 3): ["photos/7.dat"],
        (None, 0): ["manifest.json", "photos/a.txt"],
    }
    listed = json.loads(found["u", 0].read("manifest.json"))
    assert listed[0] == {"export_version": 1, "count": 8} and [f["ident"] for f in listed[1:]] == list(range(8))
    assert found["u", 2].read("photos/big.bin") == b"z" * 5000
    rows = export.list_archives(spark, f"file://{tmp_path}/out").collect()
    assert len(rows) == 10 and {r["crc"] for r in rows if r["entry"] == "photos/big.bin"} == {zlib.crc32(b"z" * 5000)}


def test_only_committed_attempts_leave_archives(tmp_path):
    rows = [{"name": "n.zip", "entry": "e", "data": b"12"}, {"name": "n.zip", "entry": "e", "data": b"3"}, {"name": "n.zip", "entry": "f", "data": b""}]
    writer = export.ZipPartsWriter(str(tmp_path))
    writer.write(iter(rows))  # this attempt is lost
    second = writer.write(iter(rows))
    writer.commit([second, None])
    assert [p.name for p in tmp_path.iterdir()] == ["n.zip"]
    with zipfile.ZipFile(tmp_path / "n.zip") as z:
        assert z.namelist() == ["e", "f"] and z.read("e") == b"123"
    other = export.ZipPartsWriter(str(tmp_path))
    with pytest.raises(KeyError):
        other.write(iter([rows[0], {"name": "m.zip"}]))
    other.abort([None])
    assert [p.name for p in tmp_path.iterdir()] == ["n.zip"]


# --- synchronisation


def _phases(spark, broken=(), failing=True):
    ran = []

    def send(name):
        def apply(rows):
            ran.append((name, sorted(r["id"] for r in rows.collect())))
            if name in broken:
                raise RuntimeError(name)
            return rows.select("id", F.when(F.lit(failing) & (F.col("id") % 3 == 0), "no").alias("error"))

        return apply

    todo = lambda n: lambda: spark.range(1, n + 1)
    return [sync.Phase("purge", todo(2), send("purge"), destructive=True), sync.Phase("photos", todo(4), send("photos")), sync.Phase("blobs", todo(0), send("blobs")), sync.Phase("trash", todo(3), send("trash"))], ran


def _said(phases, ledger, recovery=False):
    return [(r["phase"], r["done"], r["failed"], r["status"]) for r in sync.outcome(phases, ledger, recovery).orderBy("place").collect()]


def test_interrupted_synchronisation_goes_on(spark, tmp_path):
    ledger = sync.Ledger(spark, f"file://{tmp_path}/run")
    phases, _ = _phases(spark, broken=("blobs",))
    with pytest.raises(RuntimeError):
        sync.synchronise(phases, ledger)
    assert _said(phases, ledger) == [("purge", 2, 0, "success"), ("photos", 3, 1, "partial"), ("blobs", 0, 0, "pending"), ("trash", 0, 0, "pending")]
    phases, ran = _phases(spark)
    sync.synchronise(phases, ledger)
    assert [n for n, _ in ran] == ["blobs", "trash"]
    assert _said(phases, ledger)[2:] == [("blobs", 0, 0, "success"), ("trash", 2, 1, "partial")]
    phases, ran = _phases(spark, failing=False)
    sync.synchronise(phases, ledger, retry=True)
    assert ran == [("photos", [3]), ("trash", [3])]
    assert _said(phases, ledger) == [("purge", 2, 0, "success"), ("photos", 4, 0, "success"), ("blobs", 0, 0, "success"), ("trash", 3, 0, "success")]


def test_half_an_attempt_is_replaced(spark, tmp_path):
    ledger = sync.Ledger(spark, f"file://{tmp_path}/run")
    half = tmp_path / "run" / "phase=p" / "attempt=0"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"torn")
    ledger.record("p", spark.createDataFrame([(1, None), (2, "x")], "id long, error string"))
    assert ledger.attempts("p") == 1 and sorted(r["id"] for r in ledger.rows("p").collect()) == ["1", "2"]


def test_recovery_leaves_deletions_out(spark, tmp_path):
    ledger = sync.Ledger(spark, f"file://{tmp_path}/run")
    phases, ran = _phases(spark)
    sync.synchronise(phases, ledger, recovery=True)
    assert [n for n, _ in ran] == ["photos", "blobs", "trash"] and _said(phases, ledger, True)[0] == ("purge", 0, 0, "left out")


# --- streams

SCHEMA = "id long, user string, at timestamp, bad boolean"


def _attempts():
    start = dt.datetime(2024, 1, 1)
    return [(i, ["a", "b", None][i % 3], start + dt.timedelta(seconds=(i * 37) % 300), i % 5 > 0) for i in range(90)]


def test_lockouts_of_a_stream_as_of_a_batch(spark, tmp_path):
    rows = _attempts()
    batches = [rows[::3], rows[1::3], rows[2::3]]
    ends = [[(1000 + i, "end", dt.datetime(2024, 1, 2 + i), False)] for i in range(2)]
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states = []
        for batch in [*batches, *ends]:
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
            log = tail.read_log(spark, f"{tmp_path}/log", spark.read.parquet(f"{tmp_path}/log").schema)
            found = rate.lockouts_stream(log, "user", "id", "at", "bad", 3, 20, late="10 minutes")
            q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
            states.append(q.lastProgress.stateOperators[0].numRowsTotal)
    finally:
        spark.conf.unset(conf)
    got = {int(r["id"]): (r["user"], r["locked"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = rate.lockouts(spark.createDataFrame(rows, SCHEMA).withColumn("text", F.col("id").cast("string")), "user", ["at", "text"], "at", "bad", 3, 20)
    want = {r["id"]: (r["user"], r["locked"]) for r in batch.collect()}
    assert {i: v for i, v in got.items() if i < 1000} == want and any(x for _, x in want.values())
    assert states[-1] < max(states)


def test_a_slow_tail_is_told_and_loses_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(log)
    seen, notices = [], []
    listener = tail.LagNotice("slow", lambda: spark.read.parquet(log).count(), lambda batch, behind: notices.append((batch, behind)), most=5)
    spark.streams.addListener(listener)
    try:
        stream = tail.read_log(spark, log, "id long", files=1)
        tail.tail(stream, f"{tmp_path}/cp", lambda b, _: seen.extend(r["id"] for r in b.collect()), "slow").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert sorted(seen) == list(range(30)) and sorted(notices) == [(0, 20), (1, 10)]


def test_a_replayed_batch_replaces_itself(spark, tmp_path, monkeypatch):
    log, sink, cp = (str(tmp_path / n) for n in ("log", "sink", "cp"))
    spark.range(10).coalesce(1).write.mode("append").parquet(log)
    derive = lambda batch: batch.withColumn("year", F.lit(2024))
    stream = lambda: tail.read_log(spark, log, "id long")

    class Torn:
        """Writes its output, then fails before the batch is committed."""

        def __init__(self, batch):
            self.batch = derive(batch)

        @property
        def write(self):
            return self

        def mode(self, mode):
            self.writer = self.batch.write.mode(mode)
            return self

        def parquet(self, path):
            self.writer.parquet(path)
            raise RuntimeError("after the write")

    with pytest.raises(Exception, match="after the write"):
        tail.backfill(stream(), Torn, sink, cp).awaitTermination()
    assert tail.derived(spark, sink).count() == 10
    tail.backfill(stream(), derive, sink, cp).awaitTermination()
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(log)
    tail.backfill(stream(), derive, sink, cp).awaitTermination()
    rows = tail.derived(spark, sink).collect()
    assert sorted(r["id"] for r in rows) == list(range(15)) and {r["batch"] for r in rows} == {0, 1}


def test_wakes_during_a_run_make_one_more():
    ran = []

    def job():
        ran.append(1)
        if len(ran) == 1:
            for _ in range(5):
                wake.wake()
        else:
            wake.stop()

    wake = tail.Wake(job, every=60)
    wake.wake()
    wake.run()
    assert ran == [1, 1]
    timed = tail.Wake(lambda: timed.stop(), every=0.01)
    timed.run()
    assert timed.runs == 1


def test_fold_of_an_export_has_no_data(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(export, "archive_entries", lambda df, *a, inner=export.archive_entries: (seen.append(df.columns), inner(df, *a))[1])
    files = spark.createDataFrame([(k, i, "photo", f"n{i % 3}.jpg", bytes([i]) * (i + 1)) for k in ("a", None) for i in range(40)] * 2, "lang string, ident long, kind string, name string, data binary")
    planned = export.plan_export(files, "lang", ["ident"], 200.0, fields=["ident"]).where(F.col("entry") != export.MANIFEST)
    got = planned.select("lang", "at.ident", F.base64("data")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, files.select("lang", "ident", F.base64("data")).collect()), key=str)
    assert len(seen) == 1 and "data" not in seen[0]


# --- search


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    words = ["running", "run", "walking", "walked", "Berlin", "berlim", "bärlin", "mountain", "mountaim", "mount", "the", "an", "boxes", "nation", "a", "東京タワー"]
    rows = [(i if i % 19 else None, " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 4)) if i % 13 else None) for i in range(200)] + [(5, "again mountain"), (7, "")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    folder = f"file://{tmp_path}/index"
    search.build_index(docs, "id", F.col("text"), folder)
    for query in ("running", "mountain the", "berlin", "an", "walking boxes", "東京タ", "nothingness", "mountains", "", "ru mount", "nationly"):
        for fuzzy, matches in ((False, text.matches_all), (True, text.fuzzy_matches)):
            got = sorted((tuple(r) for r in search.search(spark, folder, query, fuzzy).collect()), key=str)
            assert got == sorted((tuple(r) for r in docs.where(matches("text", query)).collect()), key=str), (query, fuzzy)
    asked, whole = search.bytes_asked(spark, folder, "mountain")
    assert asked > 0 and whole > 0 and search.bytes_asked(spark, folder, "an")[0] == 0


def test_index_reads_a_part(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folder = f"file://{tmp_path}/index"
    search.build_index(docs, "doc_id", F.col("text"), folder)
    asked, whole = search.bytes_asked(spark, folder, "ononthing", fuzzy=True)
    assert asked * 3 < search.bytes_of(spark.read.parquet(f"{folder}/postings")) and whole > 0


def test_postings_share_rows(spark, tmp_path):
    rows = [(i if i % 7 else None, "the same words " + "東京xé𝄞"[: i % 7]) for i in range(300)] + [(1, "ab"), (2, "the end")]
    folder = f"file://{tmp_path}/index"
    search.build_index(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", F.col("text"), folder)
    found = spark.read.parquet(f"{folder}/postings").collect()
    assert len(found) == len({r["gram"] for r in found})  # one row a gram and batch
    want = {}
    for i, t in rows:
        for k in range(len(t) - 2):
            want.setdefault(t[k : k + 3], set()).add((i, t))
    assert {r["gram"]: set(r["ids"]) for r in found} == {g: {i for i, _ in s} for g, s in want.items()}
    grams, counts, places = search._grams(["abcab", "", "ab", "cabx"])
    assert sorted(zip(grams, counts.tolist())) == [("abc", 1), ("abx", 1), ("bca", 1), ("cab", 2)] and len(places) == 5


def test_index_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    search.build_index(spark.createDataFrame([], "id long, text string"), "id", F.col("text"), folder)
    assert search.search(spark, folder, "word").count() == 0 and search.search(spark, folder, "a").count() == 0
