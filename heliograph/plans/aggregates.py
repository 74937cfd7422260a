"""Counts, histograms, roll-ups, memories and packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators import packing, relational
from heliograph.plans.family import family
from heliograph.sources.tables import load

QUERIES, ORACLES, query = family()

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def placed(spark, sf_dir: str) -> DataFrame:
    """Orders with the nation and region they come from."""
    nation = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("country"))
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "city", "country")
    return load(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))


PLACED = """(SELECT o.*, n_name AS city, r_name AS country FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query("""
    SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users,
           count(DISTINCT user_id || ',' || event_type) AS pairs, round(coalesce(sum(value), 0), 2) AS total_value,
           strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events""")
def library_counts(spark, sf_dir):
    """All of a library's counters in one pass."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return load(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct(F.concat(F.col("user_id").cast("string"), F.lit(","), "event_type")).alias("pairs"),
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total_value"),
        stamp(F.min("ts")).alias("first_at"),
        stamp(F.max("ts")).alias("last_at"),
    )


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def class_summary(spark, sf_dir):
    """Number and mean of each class."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def media_type_counts(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT country, city, count(*) AS n FROM {PLACED} GROUP BY ALL")
def location_histogram(spark, sf_dir):
    return placed(spark, sf_dir).groupBy("country", "city").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), month(o_orderdate)) HAVING year(o_orderdate) IS NOT NULL""")
def timeline_rollup(spark, sf_dir):
    """Years and their months in one job; a year's total has no month."""
    orders = load(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return orders.rollup("year", "month").agg(F.count(F.lit(1)).alias("n")).where("year is not null")


@query(f"""
    WITH p AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM {PLACED}
    ), modes AS (
        SELECT country, city, day, o_orderpriority AS mode, row_number() OVER (PARTITION BY country, city, day ORDER BY count(*) DESC, o_orderpriority) AS rn
        FROM p GROUP BY country, city, day, o_orderpriority
    )
    SELECT p.country, p.city, CAST(p.day AS VARCHAR) AS day, count(*) AS n, min(o_orderkey) AS first_id, any_value(m.mode) AS mode,
           strftime(p.day, '%b %-d, %Y') AS label
    FROM p JOIN modes m ON p.country = m.country AND p.city = m.city AND p.day = m.day AND rn = 1 GROUP BY p.country, p.city, p.day HAVING count(*) >= 3""")
def day_place_memories(spark, sf_dir):
    """Days with three orders or more from one place, with their most frequent priority."""
    keys = ["country", "city", "day"]
    orders = placed(spark, sf_dir).withColumn("day", F.to_date("o_orderdate"))
    counts = orders.groupBy(*keys, "o_orderpriority").agg(F.count(F.lit(1)).alias("k"), F.min("o_orderkey").alias("low"))
    found = counts.groupBy(*keys).agg(F.sum("k").alias("n"), F.min("low").alias("first_id"), F.min_by("o_orderpriority", F.struct(-F.col("k"), "o_orderpriority")).alias("mode")).where("n >= 3")
    return found.select("country", "city", F.col("day").cast("string").alias("day"), "n", "first_id", "mode", F.date_format("day", "MMM d, yyyy").alias("label"))


@query("""
    SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS DOUBLE) AS photo_bytes, count(*) FILTER (l_returnflag = 'A') AS photos,
           CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS DOUBLE) AS video_bytes, count(*) FILTER (l_returnflag = 'N') AS videos,
           CAST(sum(CASE WHEN l_returnflag NOT IN ('A', 'N') THEN l_quantity ELSE 0 END) AS DOUBLE) AS other_bytes, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS others
    FROM lineitem GROUP BY l_suppkey""")
def storage_breakdown(spark, sf_dir):
    """Bytes and numbers of each owner by kind, folded to three."""
    kind = F.when(F.col("l_returnflag") == "A", "photo").when(F.col("l_returnflag") == "N", "video").otherwise("other")
    parts = [x for k in ("photo", "video", "other") for x in (F.sum(F.when(F.col("kind") == k, F.col("l_quantity")).otherwise(0.0)).alias(f"{k}_bytes"), F.count_if(F.col("kind") == k).alias(f"{k}s"))]
    return load(spark, sf_dir, "lineitem").withColumn("kind", kind).groupBy("l_suppkey").agg(*parts)


@query("SELECT l_suppkey AS cluster, count(DISTINCT l_orderkey) AS photo_count, count(*) AS detections FROM lineitem GROUP BY ALL")
def cluster_sizes(spark, sf_dir):
    """Photos, not detections, of each cluster."""
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.countDistinct("l_orderkey").alias("photo_count"), F.count(F.lit(1)).alias("detections"))


@query("""
    SELECT cluster, photo_count, best FROM (
        SELECT l_suppkey AS cluster, count(DISTINCT l_orderkey) AS photo_count, arg_max(l_orderkey, (l_extendedprice, -l_orderkey, -l_linenumber)) AS best FROM lineitem GROUP BY 1) WHERE photo_count >= 2""")
def cluster_cards(spark, sf_dir):
    """Clusters of two photos or more, with the surest detection's photo."""
    best = F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("best")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.countDistinct("l_orderkey").alias("photo_count"), best).where("photo_count >= 2")


@query("""
    WITH RECURSIVE o AS (
        SELECT *, coalesce(owner, -1) AS k, coalesce(size, 0) AS n, row_number() OVER (PARTITION BY owner ORDER BY l_orderkey, l_linenumber, l_partkey, size NULLS FIRST) AS rn
        FROM (SELECT nullif(l_suppkey, 3) AS owner, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 6 THEN l_quantity END AS size FROM lineitem)
    ), r AS (
        SELECT k, rn, CAST(0 AS BIGINT) AS part, n AS used FROM o WHERE rn = 1
        UNION ALL
        SELECT o.k, o.rn, CASE WHEN used > 0 AND used + n > 500 THEN part + 1 ELSE part END, CASE WHEN used > 0 AND used + n > 500 THEN n ELSE used + n END
        FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1
    )
    SELECT owner, l_orderkey, l_linenumber, l_partkey, size, part FROM o JOIN r USING (k, rn)""")
def size_packing(spark, sf_dir):
    """Export parts of at most 500 units of each supplier's lines, in order; one supplier and some sizes are unknown."""
    owner, size = F.nullif(F.col("l_suppkey"), F.lit(3)).alias("owner"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity")).alias("size")
    lines = load(spark, sf_dir, "lineitem").select(owner, "l_orderkey", "l_linenumber", "l_partkey", size)
    return packing.size_parts(lines, "owner", ["l_orderkey", "l_linenumber", "l_partkey", "size"], "size", 500.0)


@query("""
    WITH RECURSIVE o AS (
        SELECT CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_brand END AS p_brand, p_partkey, CASE WHEN p_size = 7 THEN 1 ELSE 0.5 + p_size / CAST(20 AS DOUBLE) END AS aspect, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part
    ), r AS (  -- row: of this picture; open, s, n: the row that is open after it, its aspects and pictures
        SELECT p_brand, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS row, CAST(0 AS BIGINT) AS open, CAST(0 AS DOUBLE) AS s, 0 AS n FROM o WHERE rn = 1
        UNION ALL
        SELECT p_brand, rn, CASE WHEN back THEN open + 1 ELSE open END, CASE WHEN NOT filled THEN open WHEN NOT back THEN open + 1 WHEN 1200 / aspect <= 220 THEN open + 2 ELSE open + 1 END,
               CASE WHEN NOT filled THEN s + aspect WHEN back AND 1200 / aspect > 220 THEN aspect ELSE 0 END, CASE WHEN NOT filled THEN n + 1 WHEN back AND 1200 / aspect > 220 THEN 1 ELSE 0 END
        FROM (
            SELECT *, filled AND n > 0 AND abs((1200 - 4 * (n - 1)) / CASE WHEN s > 0 THEN s ELSE 1 END - 220) < abs((1200 - 4 * n) / (s + aspect) - 220) AS back
            FROM (SELECT o.p_brand, o.rn, o.aspect, r.open, r.s, r.n, (1200 - 4 * r.n) / (r.s + o.aspect) <= 220 AS filled FROM r JOIN o ON o.p_brand = r.p_brand AND o.rn = r.rn + 1))
    ), laid AS (SELECT o.*, r.row, max(r.rn) OVER (PARTITION BY o.p_brand) = r.rn AND r.n > 0 AS ends_open FROM o JOIN r ON o.p_brand = r.p_brand AND o.rn = r.rn
    ), heights AS (SELECT p_brand, row, (1200 - 4 * (count(*) - 1)) / sum(aspect ORDER BY rn) AS h, bool_or(ends_open) AS last FROM laid GROUP BY p_brand, row)
    SELECT nullif(p_brand, '') AS p_brand, p_partkey, row, round(CASE WHEN last THEN least(220, h) ELSE h END, 6) AS row_height FROM laid JOIN heights USING (p_brand, row)""")
def justified_rows(spark, sf_dir):
    """Rows of pictures, each brand's parts; one brand and some proportions are unknown."""
    brand, aspect = F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("p_brand"), F.when(F.col("p_size") != 7, F.lit(0.5) + F.col("p_size") / 20).alias("aspect")
    rows = packing.justified_rows(load(spark, sf_dir, "part").select(brand, "p_partkey", aspect), "p_brand", ["p_partkey"], "aspect", 1200.0, 220.0)
    return rows.select("p_brand", "p_partkey", "row", F.round("row_height", 6).alias("row_height"))


@query("""
    SELECT o_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def tags_per_item(spark, sf_dir):
    """Each order's tags, sorted; none is null."""
    tags = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("tags"))
    return load(spark, sf_dir, "orders").select("o_orderkey").join(tags, "o_orderkey", "left")


@query("""
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id) AS place FROM events""")
def day_groups(spark, sf_dir):
    """Every event with its day and its place in it, newest first."""
    return relational.day_groups(load(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select(F.col("day").cast("string").alias("day"), "event_id", "place")


@query("""
    SELECT CAST(CAST(ts + INTERVAL 345 MINUTE AS DATE) AS VARCHAR) AS day, event_id, row_number() OVER (PARTITION BY CAST(ts + INTERVAL 345 MINUTE AS DATE) ORDER BY ts DESC, event_id) AS place FROM events""")
def local_day_groups(spark, sf_dir):
    """The same by the clocks of a place, which are 5:45 ahead."""
    return relational.day_groups(load(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", "Asia/Kathmandu").select(F.col("day").cast("string").alias("day"), "event_id", "place")


@query("""
    WITH e AS (
        SELECT event_id, CASE event_type WHEN 'view' THEN 'photo' WHEN 'click' THEN 'gif' WHEN 'purchase' THEN 'video' ELSE 'audio' END AS kind, CASE WHEN event_id % 3 = 0 THEN user_id WHEN event_id % 3 = 1 THEN NULL END AS burst, event_id % 3 = 2 AS none FROM events
    ), b AS (SELECT *, CASE WHEN burst IS NULL THEN 'i' || event_id ELSE 'g' || burst END AS g FROM e
    ), a AS (SELECT * FROM (VALUES ('all', ['photo', 'gif', 'video', 'audio'], true), ('photos', ['photo', 'gif'], true), ('gifs', ['gif'], false), ('videos', ['video'], false), ('audio', ['audio'], false)) t(album, kinds, phone))
    SELECT client, album, CASE WHEN client = 'web' OR phone THEN (SELECT count(DISTINCT g) FROM b WHERE list_contains(kinds, kind)) ELSE (SELECT count(*) FROM b WHERE list_contains(kinds, kind)) END AS items
    FROM a, (SELECT unnest(['web', 'phone']) AS client)""")
def smart_albums(spark, sf_dir):
    """Sizes of the smart albums as each client shows them: phones collapse bursts in two of them only."""
    kind = F.when(F.col("event_type") == "view", "photo").when(F.col("event_type") == "click", "gif").when(F.col("event_type") == "purchase", "video").otherwise("audio")
    burst = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 2, "")
    return relational.smart_albums(load(spark, sf_dir, "events").select("event_id", kind.alias("kind"), burst.alias("burst")), "event_id", "kind", "burst")


@query("""
    SELECT count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS pending, greatest(count(*) - count(*) FILTER (l.doc_id IS NULL), 0) AS done,
           count(*) FILTER (l.doc_id IS NULL) > 0 AS active FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def pipeline_progress(spark, sf_dir):
    """Total, pending and done of a stage, from its processed set."""
    done = load(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    pending = F.count_if(F.col("hit").isNull())
    total = F.count(F.lit(1))
    return load(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left").agg(total.alias("total"), pending.alias("pending"), F.greatest(total - pending, F.lit(0)).alias("done"), (pending > 0).alias("active"))


@query("""
    WITH s AS (
        SELECT 'ai' AS stage, count(*) AS total, count(*) FILTER (quality IS NULL) AS pending FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, 1 AS quality FROM labels) l ON d.doc_id = l.doc_id
        UNION ALL SELECT 'geo', count(*), count(*) FILTER (v IS NULL) FROM documents d LEFT JOIN (SELECT DISTINCT vec_id AS v FROM embeddings) e ON d.doc_id = v
        UNION ALL SELECT 'import', count(*), count(*) FILTER (n_chars IS NULL) FROM documents)
    SELECT stage, total, pending, greatest(total - pending, 0) AS done, pending > 0 AND NOT (stage <> 'import' AND (SELECT pending FROM s WHERE stage = 'import') > 0) AS active,
           stage <> 'import' AND (SELECT pending FROM s WHERE stage = 'import') > 0 AS waits FROM s""")
def stage_gates(spark, sf_dir):
    """Each stage's progress, and whether it waits for one before it that is not through."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    done = lambda t, c, name: load(spark, sf_dir, t).select(F.col(c).alias("doc_id")).distinct().withColumn(name, F.lit(True))
    rows = docs.join(done("labels", "doc_id", "ai"), "doc_id", "left").join(done("embeddings", "vec_id", "geo"), "doc_id", "left")
    return relational.stage_progress(rows, {"import": F.col("n_chars").isNull(), "ai": F.col("ai").isNull(), "geo": F.col("geo").isNull()}, {"ai": ["import"], "geo": ["import"]})


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark, sf_dir):
    return reduce(DataFrame.unionAll, [load(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES])


@query("""
    SELECT count(*) AS every, count(*) FILTER (event_type IN ('view', 'click')) AS photos, count(*) FILTER (event_type = 'purchase') AS videos, count(*) FILTER (value > 100) AS favourites FROM events""")
def smart_album_counts(spark, sf_dir):
    """Sizes of the albums that are defined by conditions."""
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("every"), F.count_if(kind.isin("view", "click")).alias("photos"), F.count_if(kind == "purchase").alias("videos"), F.count_if(F.col("value") > 100).alias("favourites"))


@query("""
    SELECT p_brand, min(p_partkey) AS part FROM part GROUP BY p_brand""")
def best_of_dedup(spark, sf_dir):
    """One row of each group: the lowest score, here the smallest key."""
    return relational.best_with_fill(load(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("part")), ["p_brand"], "part", "part", [])


@query("""
    SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey,
           arg_min(note, (o_totalprice, o_orderkey)) FILTER (note IS NOT NULL) AS note
    FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS note FROM orders) GROUP BY o_custkey""")
def best_of_merge(spark, sf_dir):
    """The cheapest order of each customer; its missing note comes from the next one that has it."""
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("note"))
    return relational.best_with_fill(rows, ["o_custkey"], "o_totalprice", "o_orderkey", ["note"]).select("o_custkey", "o_orderkey", "note")
