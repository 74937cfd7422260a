"""Work that leaves files behind: exports, synchronisation, live tails, search indexes; the queries read them back."""

from __future__ import annotations

import contextlib
import threading

from pyspark.sql import functions as F

from heliograph.operators import export, search, sync
from heliograph.plans.family import family
from heliograph.plans.texts import ORACLES as TEXTS
from heliograph.shared import cut, new_folder, remove_folder
from heliograph.sources.tables import load
from heliograph.streaming import rate, tail

QUERIES, ORACLES, query = family()


@contextlib.contextmanager
def _folder(spark, name: str):
    folder = new_folder(spark, name)
    yield folder
    remove_folder(spark, folder)


#: The kinds of a library's files, by turns.
KINDS = ["photo", "thumbnail", "video", "album_manifest", "other", "gif", "video_thumbnail"]


@query(f"""
    WITH RECURSIVE f AS (
        SELECT lang, doc_id, {KINDS}[doc_id % 7 + 1] AS kind, CASE WHEN doc_id % 3 > 0 THEN source || '.' || doc_id % 4 END AS name, CASE WHEN text <> '' THEN octet_length(encode(text)) END AS size FROM documents
    ), firsts AS (
        SELECT lang, length('[{{"export_version":1,"count":' || count(*) || '}}') + 1 + sum(length(',{{"ident":' || doc_id || ',"kind":"' || kind || '"}}')) AS first FROM f GROUP BY lang
    ), o AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn, CASE WHEN kind = 'album_manifest' THEN 'metadata/' ELSE 'photos/' END
            || coalesce(name, doc_id || CASE kind WHEN 'photo' THEN '.jpg' WHEN 'gif' THEN '.gif' WHEN 'video' THEN '.mp4' WHEN 'album_manifest' THEN '.json' ELSE '.dat' END) AS path
        FROM f WHERE kind NOT LIKE '%thumbnail' AND size IS NOT NULL
    ), r AS (
        SELECT lang, rn, CAST(CASE WHEN first + size + 100 > 40000 THEN 1 ELSE 0 END AS BIGINT) AS part, CASE WHEN first + size + 100 > 40000 THEN size ELSE first + size END AS used FROM o JOIN firsts USING (lang) WHERE rn = 1
        UNION ALL
        SELECT o.lang, o.rn, CASE WHEN used > 0 AND used + size + 100 > 40000 THEN part + 1 ELSE part END, CASE WHEN used > 0 AND used + size + 100 > 40000 THEN size ELSE used + size END
        FROM r JOIN o ON o.lang = r.lang AND o.rn = r.rn + 1
    ), c AS (SELECT lang, part, path, size, rn, row_number() OVER (PARTITION BY lang, part, path ORDER BY rn) AS n FROM o JOIN r USING (lang, rn)
    ), e AS (
        SELECT lang, part, rn, CASE WHEN n = 1 THEN path ELSE regexp_replace(path, '([.][^.]*)$', '_(' || n || ')\\1') END AS entry, size FROM c
        UNION ALL SELECT lang, 0, 0, 'manifest.json', first FROM firsts
    )
    SELECT lang, part, CAST(row_number() OVER (PARTITION BY lang, part ORDER BY rn) - 1 AS INT) AS place, entry, CAST(size AS BIGINT) AS size, true AS whole FROM e""")
def export_entries(spark, sf_dir):
    """What the archives of an export of all documents hold, by language, read back from the files."""
    kind = F.array(*map(F.lit, KINDS))[(F.col("doc_id") % 7).cast("int")]
    name = F.when(F.col("doc_id") % 3 > 0, F.concat_ws(".", "source", (F.col("doc_id") % 4).cast("string")))
    files = load(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("ident"), kind.alias("kind"), name.alias("name"), F.encode(F.nullif(F.col("text"), F.lit("")), "UTF-8").alias("data"))
    planned = cut(export.plan_export(files, "lang", ["ident"], 40_000.0, fields=["ident", "kind"]), "export")
    with _folder(spark, "archives") as folder:
        export.write_archives(planned, "lang", folder)
        listed = cut(export.list_archives(spark, folder), "listed")
    sums = planned.where(F.col("entry") != export.MANIFEST).select(export.archive_name("lang").alias("name"), "entry", F.crc32("data").alias("want"))
    keys = planned.select(export.archive_name("lang").alias("name"), "lang", "part").distinct()
    return listed.join(keys, "name").join(sums, ["name", "entry"], "left").select("lang", "part", "place", "entry", "size", (F.coalesce("want", "crc") == F.col("crc")).alias("whole"))


@query("""
    WITH ids AS (
        SELECT 0 AS place, 'purge' AS phase, c_custkey AS id FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 1, 'users', c_custkey FROM customer WHERE c_acctbal >= 0
        UNION ALL SELECT 3, 'photos', o_orderkey FROM orders WHERE o_custkey % 3 > 0
        UNION ALL SELECT 4, 'galleries', s_suppkey FROM supplier
        UNION ALL SELECT 5, 'blobs', p_partkey FROM part WHERE p_size > 10
        UNION ALL SELECT 6, 'metadata', n_nationkey FROM nation
        UNION ALL SELECT 7, 'trash', r_regionkey * 97 + 5 FROM region
    ), modes AS (SELECT unnest([false, true]) AS recovery
    ), phases AS (SELECT * FROM (VALUES (0, 'purge', true), (1, 'users', false), (2, 'removed users', true), (3, 'photos', false), (4, 'galleries', false), (5, 'blobs', false), (6, 'metadata', false), (7, 'trash', false)) t(place, phase, deletes)
    ), counts AS (SELECT place, count(*) FILTER (id % 97 <> 5) AS done, count(*) FILTER (id % 97 = 5) AS failed FROM ids GROUP BY place)
    SELECT recovery, phase, CASE WHEN recovery AND deletes THEN 0 ELSE coalesce(done, 0) END AS done, CASE WHEN recovery AND deletes THEN 0 ELSE coalesce(failed, 0) END AS failed,
        CASE WHEN recovery AND deletes THEN 'left out' WHEN coalesce(failed, 0) = 0 THEN 'success' WHEN done = 0 THEN 'error' ELSE 'partial' END AS status
    FROM phases CROSS JOIN modes LEFT JOIN counts USING (place)""")
def phased_sync(spark, sf_dir):
    """The outcome of a synchronisation in phases, as usual and in a recovery; rows of some ids can't be sent."""
    rows = lambda t, key, where="true": lambda: load(spark, sf_dir, t).where(where).select(F.expr(key).alias("id"))
    send = lambda df: df.select("id", F.when(F.col("id") % 97 == 5, "refused").alias("error"))
    phases = [
        sync.Phase("purge", rows("customer", "c_custkey", "c_acctbal < 0"), send, destructive=True),
        sync.Phase("users", rows("customer", "c_custkey", "c_acctbal >= 0"), send),
        sync.Phase("removed users", rows("customer", "c_custkey", "c_custkey < 0"), send, destructive=True),
        sync.Phase("photos", rows("orders", "o_orderkey", "o_custkey % 3 > 0"), send),
        sync.Phase("galleries", rows("supplier", "s_suppkey"), send),
        sync.Phase("blobs", rows("part", "p_partkey", "p_size > 10"), send),
        sync.Phase("metadata", rows("nation", "n_nationkey"), send),
        sync.Phase("trash", rows("region", "r_regionkey * 97 + 5"), send),
    ]
    found = None
    with _folder(spark, "ledgers") as folder:
        for recovery in (False, True):
            ledger = sync.Ledger(spark, f"{folder}/{recovery}")
            sync.synchronise(phases, ledger, recovery)
            said = cut(sync.outcome(phases, ledger, recovery).select(F.lit(recovery).alias("recovery"), "phase", "done", "failed", "status"), "outcome")
            found = said if found is None else found.unionAll(said)
    return found


@query("""SELECT event_id, event_type, CAST(1 AS BIGINT) AS times, true AS told FROM events""")
def live_tail(spark, sf_dir):
    """Every event as a live tail wrote it, batch by batch, and whether the tail was told that it is behind."""
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    notices: list[tuple[int, int]] = []
    told = threading.Event()
    with _folder(spark, "tail") as folder:
        events.repartitionByRange(4, "ts").write.parquet(f"{folder}/log")
        total = spark.read.parquet(f"{folder}/log").count()
        name = folder.rsplit("/", 1)[-1]
        listener = tail.LagNotice(name, lambda: total, lambda batch, behind: (notices.append((batch, behind)), told.set()))
        spark.streams.addListener(listener)
        log = tail.read_log(spark, f"{folder}/log", events.schema, files=1)
        tail.tail(log, f"{folder}/checkpoint", lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"), name).awaitTermination()
        told.wait(30)
        spark.streams.removeListener(listener)
        seen = cut(spark.read.parquet(f"{folder}/out").groupBy("event_id", "event_type").agg(F.count(F.lit(1)).alias("times")), "seen")
    return seen.withColumn("told", F.lit(bool(notices) and all(behind > 0 for _, behind in notices)))


def _indexed(spark, rows, ident: str, searched, words: str, fuzzy: bool = False):
    with _folder(spark, "index") as folder:
        search.build_index(rows, ident, searched, folder)
        return cut(search.search(spark, folder, words, fuzzy).select(F.col("id").alias(ident)), "matches")


@query(TEXTS["token_search"])
def indexed_token_search(spark, sf_dir):
    """Documents whose joined fields hold every token or a stem of it, by the index."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = load(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return _indexed(spark, rows, "doc_id", F.concat_ws(" ", "text", "lang", "source", F.col("quality").cast("string")), "the thing src1")


@query(TEXTS["fuzzy_search"])
def indexed_fuzzy_search(spark, sf_dir):
    """Documents with a word like the token, by the index."""
    return _indexed(spark, load(spark, sf_dir, "documents"), "doc_id", F.col("text"), "ononthing", fuzzy=True)


@query("""
    WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS rn FROM events
    ), r AS (
        SELECT CAST(NULL AS BIGINT) AS event_id, user_id, CAST(0 AS BIGINT) AS rn, false AS locked, 0 AS n, CAST(0 AS BIGINT) AS until FROM o WHERE rn = 1
        UNION ALL
        SELECT o.event_id, o.user_id, o.rn, t < until, CASE WHEN t < until THEN n WHEN bad AND n < 1 THEN n + 1 ELSE 0 END, CASE WHEN t >= until AND bad AND n >= 1 THEN t + 86400000000 ELSE until END
        FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
    SELECT event_id, user_id, locked FROM r WHERE rn > 0""")
def locked_attempts_stream(spark, sf_dir):
    """Attempts that meet a lock, as a stream judges them that gets them out of order."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        with _folder(spark, "locks") as folder:
            # The last row closes the stream: it moves the watermark behind all others.
            end = events.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "ts", F.lit(False).alias("failed"))
            events.repartition(3, "event_id").unionAll(end).write.parquet(f"{folder}/log")
            log = tail.read_log(spark, f"{folder}/log", events.schema)
            judged = rate.lockouts_stream(log, "user_id", "event_id", "ts", "failed", 2, 86_400, late="365 days")
            judged.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
            return cut(spark.read.schema("user_id string, event_id string, locked boolean").parquet(f"{folder}/out").where("event_id != '-1'").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "locked"), "judged")
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
