"""Sessions, collapsing, paging and streaks over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heliograph.operators import relational, sessions
from heliograph.plans.family import family
from heliograph.sources.tables import load
from heliograph.streaming import rate, tail

QUERIES, ORACLES, query = family()

stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("""
    WITH marked AS (
        SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 1800 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), numbered AS (
        SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked
    )
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, min(event_id) AS first_event,
           strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended_at
    FROM numbered GROUP BY user_id, session""")
def gap_sessions(spark, sf_dir):
    """Events of a user, each at most 30 minutes after the one before."""
    runs = sessions.sessionize(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], lambda before: sessions.seconds_since(before, "ts") > 1800)
    return runs.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"), stamp(F.min("ts")).alias("started_at"), stamp(F.max("ts")).alias("ended_at"))


@query("""
    WITH marked AS (
        SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 7200 AND abs(value - lag(value) OVER w) <= 50 THEN 0 ELSE 1 END AS opens
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), numbered AS (
        SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM marked
    )
    SELECT user_id, min(event_id) AS burst_id, count(*) AS frames FROM numbered GROUP BY user_id, burst HAVING count(*) >= 2""")
def burst_groups(spark, sf_dir):
    """Bursts: near in time and near in value, of two frames or more; named by their smallest event."""
    events = load(spark, sf_dir, "events")
    new = lambda before: ~((sessions.seconds_since(before, "ts") <= 7200) & (F.abs(F.col("value") - before("value")) <= 50))
    runs = sessions.sessionize(events, ["user_id"], ["ts", "event_id"], new, least=2, name="burst")
    return runs.groupBy("user_id", "burst").agg(F.min("event_id").alias("burst_id"), F.count(F.lit(1)).alias("frames")).drop("burst")


@query("""
    WITH days AS (SELECT *, CAST(ts AS DATE) AS day FROM events
    ), marked AS (
        SELECT *, CASE WHEN day - lag(day) OVER w <= 3 THEN 0 ELSE 1 END AS opens FROM days WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
    ), numbered AS (
        SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS trip FROM marked
    )
    SELECT user_id, event_type, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS photo_count,
           arg_min(event_id, (ts, event_id)) AS cover, CAST(max(day) - min(day) + 1 AS BIGINT) AS day_count
    FROM numbered GROUP BY user_id, event_type, trip HAVING count(*) >= 5""")
def place_trips(spark, sf_dir):
    """Stays of a user with one kind of event: gaps of at most three days, five events or more."""
    found = sessions.trips(load(spark, sf_dir, "events").withColumn("thumb", F.col("event_id")), ["user_id", "event_type"], "ts", "event_id", "thumb")
    return found.select("user_id", "event_type", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "photo_count", "cover", F.col("day_count").cast("long").alias("day_count"))


@query("""
    WITH named AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) END AS burst_id FROM orders
    ), keyed AS (SELECT *, coalesce('g' || nullif(burst_id, ''), 'i' || o_orderkey) AS k FROM named
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY k) AS n FROM keyed)
    SELECT o_orderkey, burst_id, CASE WHEN nullif(burst_id, '') IS NOT NULL THEN n END AS burst_count FROM ranked WHERE rn = 1""")
def burst_collapse(spark, sf_dir):
    """One row of each group, the earliest; rows with no or an empty group name stay."""
    named = load(spark, sf_dir, "orders").withColumn("burst_id", F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")))
    return relational.collapse(named, "burst_id", "o_orderkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "burst_id", "burst_count")


@query("""
    SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text""")
def first_seen(spark, sf_dir):
    """The first document of each text, in display order."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("h")


@query("""
    SELECT o_custkey, o_orderkey, rank FROM (
        SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10""")
def latest_n_per_group(spark, sf_dir):
    """The latest ten orders of each customer."""
    found = relational.latest_per_group(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.col("o_orderdate").desc(), "o_orderkey"], 10)
    return found.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS taken_at, CAST(NULL AS BIGINT) AS burst_count FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500""")
def library_page(spark, sf_dir):
    """The first page of the library: newest first, at most 500 rows (the limit is the feature)."""
    return relational.page(load(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 5000).select("o_orderkey", stamp("o_orderdate").alias("taken_at"), F.lit(None).cast("long").alias("burst_count"))


@query("""
    SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 50 AS has_more FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def page_has_more(spark, sf_dir):
    """A page of fifty, and whether there are more (the limit is the feature)."""
    return relational.page_with_more(load(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_orderdate", "o_orderkey", 50).select("o_orderkey", "has_more")


@query("""
    WITH c AS (SELECT o_orderdate AS d, o_orderkey AS k FROM orders ORDER BY 1 DESC, 2 LIMIT 1 OFFSET 499)
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS taken_at FROM orders, c
    WHERE o_orderstatus = 'O' AND (o_orderdate < d OR (o_orderdate = d AND o_orderkey > k)) ORDER BY o_orderdate DESC, o_orderkey LIMIT 200""")
def keyset_page(spark, sf_dir):
    """The page after the last returned row of library_page, filtered by status."""
    orders = load(spark, sf_dir, "orders")
    last = relational.page(orders, "o_orderdate", "o_orderkey", 500).orderBy("o_orderdate", F.desc("o_orderkey")).limit(1)
    some = relational.where_all(orders, F.col("o_orderstatus") == "O", None)
    return relational.page_after(some, "o_orderdate", "o_orderkey", 200, last).select("o_orderkey", stamp("o_orderdate").alias("taken_at"))


@query("""
    WITH recent AS (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS added_at FROM recent WHERE rn = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def recently_added(spark, sf_dir):
    """The newest of each group, the latest hundred of them (the limit is the feature)."""
    newest = relational.first_of(load(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), "o_orderkey"])
    return relational.page(newest, "o_orderdate", "o_orderkey", 100).select("o_orderkey", stamp("o_orderdate").alias("added_at"))


@query("""
    SELECT p_partkey, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 WHEN 'Brand#3' THEN 2 ELSE 3 END, p_partkey) AS place FROM part""")
def conversion_order(spark, sf_dir):
    """A stable order by tier: each tier's rows are counted before they are numbered, so no task numbers them all."""
    parts = load(spark, sf_dir, "part").select("p_partkey", F.coalesce(*[F.when(F.col("p_brand") == f"Brand#{i + 1}", F.lit(i)) for i in range(3)], F.lit(3)).alias("tier"))
    return relational.numbered(parts, ["tier", "p_partkey"], "place").select("p_partkey", "place")


@query("""
    SELECT event_id, row_number() OVER (ORDER BY md5('7-' || event_id), event_id) AS place FROM events""")
def shuffled_order(spark, sf_dir):
    """Each row's place in a slideshow whose order is the same for a seed."""
    keyed = load(spark, sf_dir, "events").select("event_id", F.md5(F.concat(F.lit("7-"), F.col("event_id").cast("string"))).alias("key"))
    return relational.numbered(keyed, ["key", "event_id"], "place").select("event_id", "place")


_FRAMES_SQL = """SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'video' ELSE 'photo' END AS media_type, CASE user_id % 9 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'camera ' || user_id % 9 END AS camera, ts AS taken_at,
        CASE WHEN event_id % 11 = 0 THEN 'b' END AS burst_id, CASE WHEN event_id % 13 = 0 THEN 'hdr' END AS subtype, CASE WHEN event_id % 3 > 0 THEN 10 + (event_id % 2)::DOUBLE / 50 END AS lat, CASE WHEN event_id % 3 > 0 THEN 20::DOUBLE END AS lon FROM events"""


@query(f"""
    WITH f AS ({_FRAMES_SQL}
    ), c AS (
        SELECT * FROM f WHERE media_type = 'photo' AND camera <> '' AND burst_id IS NULL AND subtype IS NULL AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    ), l AS (
        SELECT *, epoch_us(taken_at) - lag(epoch_us(taken_at)) OVER w AS since, lag(lat) OVER w AS blat, lag(lon) OVER w AS blon FROM c WINDOW w AS (PARTITION BY camera ORDER BY taken_at, id)
    ), o AS (SELECT *, CASE WHEN since IS NULL OR since > 600000000 OR coalesce(abs(lat - blat) > 0.009, false) THEN 1 ELSE 0 END AS opens FROM l
    ), s AS (SELECT *, sum(opens) OVER (PARTITION BY camera ORDER BY taken_at, id ROWS UNBOUNDED PRECEDING) AS burst FROM o
    ), g AS (SELECT camera, min(id) OVER (PARTITION BY camera, burst) AS first, count(*) OVER (PARTITION BY camera, burst) AS frames, id FROM s)
    SELECT id, camera, first, frames FROM g WHERE frames >= 2""")
def detected_bursts(spark, sf_dir):
    """Frames of bursts among the candidates: one camera, ten minutes and one kilometre from the frame before."""
    k, user = F.col("event_id"), F.col("user_id") % 9
    photos = load(spark, sf_dir, "events").select(
        k.alias("id"), F.when(F.col("event_type") == "purchase", "video").otherwise("photo").alias("media_type"),
        F.when(user == 0, "").when(user != 1, F.concat(F.lit("camera "), user.cast("string"))).alias("camera"), F.col("ts").alias("taken_at"),
        F.when(k % 11 == 0, "b").alias("burst_id"), F.when(k % 13 == 0, "hdr").alias("subtype"), F.when(k % 3 > 0, 10 + (k % 2) / 50).alias("lat"), F.when(k % 3 > 0, 20.0).alias("lon"),
    )
    hidden = load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    found = sessions.bursts(sessions.burst_candidates(photos, hidden), "camera", "taken_at", "id", "lat", "lon", seconds=600)
    whole = Window.partitionBy("camera", "burst")
    return found.select("id", "camera", F.min("id").over(whole).alias("first"), F.count(F.lit(1)).over(whole).alias("frames"))


@query("""
    WITH q AS (
        SELECT o_orderkey AS id, o_orderkey % 4 AS priority, CASE WHEN (o_custkey % 7) >= 5 AND o_orderstatus <> 'F' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'uploading' END AS status FROM orders)
    SELECT id, status, CASE WHEN status = 'queued' THEN row_number() OVER (PARTITION BY status ORDER BY priority, id) END AS place FROM q""")
def upload_queue(spark, sf_dir):
    """The upload queue: by priority, without what has failed too often."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("uploading")
    entries = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderkey") % 4).alias("priority"), (F.col("o_custkey") % 7).alias("attempts"))
    return tail.upload_queue(entries).select("id", "status", "place")


@query("""
    WITH m AS (SELECT max(ts) AS now FROM events)
    SELECT event_type, count(*) AS total, count(*) FILTER (ts > now - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (ts > now - INTERVAL 7 DAY) AS last_week
    FROM events, m GROUP BY event_type""")
def trailing_activity(spark, sf_dir):
    """Counts by kind: all, the last day and the last week before the newest event."""
    events = load(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    recent = lambda d: F.count_if(F.col("ts") > F.col("now") - F.expr(f"INTERVAL {d} DAYS"))
    return events.join(F.broadcast(now)).groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), recent(1).alias("last_day"), recent(7).alias("last_week"))


@query("""
    SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def sliding_rate(spark, sf_dir):
    """Requests of each user in the hour that ends with each request."""
    return rate.trailing_counts(load(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "user_id", "in_window")


@query("""
    WITH RECURSIVE o AS (
        SELECT event_id, coalesce(nullif(user_id, 5), -1) AS user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
    ), r AS (  -- a, b: the last two that passed
        SELECT event_id, user_id, rn, true AS allowed, t AS a, CAST(NULL AS BIGINT) AS b FROM o WHERE rn = 1
        UNION ALL
        SELECT o.event_id, o.user_id, o.rn, b IS NULL OR t - b >= 3600000000, CASE WHEN b IS NULL OR t - b >= 3600000000 THEN t ELSE a END, CASE WHEN b IS NULL OR t - b >= 3600000000 THEN a ELSE b END
        FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
    SELECT event_id, nullif(user_id, -1) AS user_id, allowed FROM r""")
def rate_limited(spark, sf_dir):
    """Which requests a limit of two an hour lets pass; rejected ones do not count against later ones. One user is unknown."""
    user = F.nullif(F.col("user_id"), F.lit(5)).alias("user_id")
    return rate.admitted(load(spark, sf_dir, "events").select("event_id", user, "ts"), "user_id", ["ts", "event_id"], "ts", 2, 3600).select("event_id", "user_id", "allowed")


@query("""
    WITH marked AS (
        SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS streak FROM events)
    SELECT user_id, count(*) AS failures, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at
    FROM marked WHERE event_type = 'error' GROUP BY user_id, streak HAVING count(*) >= 2""")
def failure_streaks(spark, sf_dir):
    """Two failures or more of a user without a success between."""
    found = sessions.failure_streaks(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2)
    return found.select("user_id", "failures", stamp("first_at").alias("first_at"), stamp("last_at").alias("last_at"))


@query("""
    WITH RECURSIVE o AS (
        SELECT event_id, coalesce(nullif(user_id, 5), -1) AS user_id, epoch_us(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
    ), r AS (  -- n: failures in a row; until: the lock's end
        SELECT CAST(NULL AS BIGINT) AS event_id, user_id, CAST(0 AS BIGINT) AS rn, false AS locked, 0 AS n, CAST(0 AS BIGINT) AS until FROM o WHERE rn = 1
        UNION ALL
        SELECT o.event_id, o.user_id, o.rn, t < until, CASE WHEN t < until THEN n WHEN bad AND n < 1 THEN n + 1 ELSE 0 END, CASE WHEN t >= until AND bad AND n >= 1 THEN t + 86400000000 ELSE until END
        FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)
    SELECT event_id, nullif(user_id, -1) AS user_id, locked FROM r WHERE rn > 0""")
def locked_attempts(spark, sf_dir):
    """Attempts that meet a lock: a day after two failures in a row. One user is unknown."""
    attempts = load(spark, sf_dir, "events").select("event_id", F.nullif(F.col("user_id"), F.lit(5)).alias("user_id"), "ts", (F.col("event_type") == "error").alias("failed"))
    return rate.lockouts(attempts, "user_id", ["ts", "event_id"], "ts", "failed", 2, 86_400).select("event_id", "user_id", "locked")


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50""")
def recent_failures(spark, sf_dir):
    """The latest fifty failures (the limit is the feature)."""
    return relational.page(load(spark, sf_dir, "events").where("event_type = 'error'"), "ts", "event_id", 50).select("event_id", stamp("ts").alias("at"))


@query("""
    SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events
    WHERE event_type IN ('click', 'view') AND ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND user_id <= 100""")
def audit_filter(spark, sf_dir):
    """Only the conditions that are asked for are applied."""
    events = load(spark, sf_dir, "events")
    found = relational.where_all(events, F.col("event_type").isin("click", "view"), F.col("ts") > F.lit("2024-01-05").cast("timestamp"), F.col("ts") < F.lit("2024-01-12").cast("timestamp"), F.col("user_id") <= 100, None)
    return found.select("event_id", "event_type", stamp("ts").alias("at"))


@query("""
    SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS affected FROM (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def duplicate_timestamps(spark, sf_dir):
    """How many moments several orders share, and how many orders those are."""
    shared = load(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("affected"))
