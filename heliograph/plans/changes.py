"""Upserts, merges, deletes and retention, as the rows they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions.text import content_hash
from heliograph.operators import merge, relational
from heliograph.plans.family import family
from heliograph.sources.tables import load
from heliograph.streaming import tail

QUERIES, ORACLES, query = family()


@query("""
    SELECT substr(sha256(text), 1, 12) AS hash, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1""")
def hash_dedup(spark, sf_dir):
    """Insert if absent by content hash: the row that stays and how many there were."""
    return load(spark, sf_dir, "documents").groupBy(content_hash("text").alias("hash")).agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("copies"))


@query("""
    SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def insert_absent(spark, sf_dir):
    """Rows are inserted where no row has their key."""
    new = load(spark, sf_dir, "documents").select("doc_id", F.lit(9).alias("quality"))
    return merge.upsert(load(spark, sf_dir, "labels").select("doc_id", "quality"), new, ["doc_id"], replace=False)


@query("""
    SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.lang END, 'q' || l.quality) AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def coalesce_merge(spark, sf_dir):
    """Missing values are filled from another table, others stay."""
    old = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    new = load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return merge.fill_nulls(old, new, "doc_id", ["lang"])


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id")
def failure_counters(spark, sf_dir):
    """What counting every failure up leaves."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"))


@query("""
    WITH payload AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus = 'O')
    SELECT * FROM payload UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM payload)""")
def scoped_full_state_merge(spark, sf_dir):
    """A full state for some customers replaces all of theirs; customers it does not mention keep what they have."""
    orders = load(spark, sf_dir, "orders")
    payload = orders.where("o_custkey % 3 = 0 and o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_totalprice")
    return merge.scoped_merge(orders, payload, "o_custkey", ["o_orderkey"])


@query("""
    SELECT doc_id, CAST(DATE '2024-01-31' + INTERVAL 30 DAY AS DATE)::VARCHAR AS expires FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def soft_delete(spark, sf_dir):
    """Rows in the trash with their day of expiry."""
    _, gone = merge.soft_delete(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", F.lit("2024-01-31").cast("timestamp"), 30)
    return gone.select("doc_id", F.to_date("expires_at").cast("string").alias("expires"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) OR doc_id % 2 = 0")
def restored(spark, sf_dir):
    """The library after a soft delete and the return of some rows."""
    docs = load(spark, sf_dir, "documents").select("doc_id")
    live, trash = merge.soft_delete(docs, load(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", F.lit("2024-01-31").cast("timestamp"), 30)
    return merge.restore(live, trash, trash.where("doc_id % 2 = 0").select("doc_id"), "doc_id")[0]


@query("""
    WITH t AS (SELECT substr(sha256(text), 1, 12) AS file, doc_id % 4 = 0 AS expired, doc_id % 2 = 0 AS trashed FROM documents)
    SELECT DISTINCT file FROM t WHERE trashed AND expired AND file NOT IN (SELECT file FROM t WHERE NOT trashed OR NOT expired)""")
def ttl_purge_refcount(spark, sf_dir):
    """Files of expired rows that nothing refers to any more."""
    rows = load(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("file"))
    trash = rows.where("doc_id % 2 = 0").withColumn("expires_at", F.when(F.col("doc_id") % 4 == 0, F.lit("2024-01-01")).otherwise(F.lit("2025-01-01")).cast("timestamp"))
    return merge.purge(trash, rows.where("doc_id % 2 != 0"), F.lit("2024-06-01").cast("timestamp"), "file")[1]


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY")
def retention(spark, sf_dir):
    """Events of the last fourteen days before the newest."""
    events = load(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))  # one row
    return events.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("INTERVAL 14 DAYS")).select("event_id")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def orphan_cleanup(spark, sf_dir):
    """Parents that still have a child."""
    return load(spark, sf_dir, "supplier").select("s_suppkey").join(load(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")


@query("SELECT o_orderkey, CASE WHEN o_custkey <= 50 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders")
def rekeyed(spark, sf_dir):
    """Orders under their customers' new ids."""
    mapping = load(spark, sf_dir, "customer").where("c_custkey <= 50").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1_000_000).alias("new"))
    return merge.rekey(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), mapping, "o_custkey")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE source END AS source, CASE WHEN lang = 'en' THEN NULL ELSE n_chars END AS n_chars FROM documents")
def scrubbed(spark, sf_dir):
    """Some columns emptied for some rows."""
    return merge.scrub(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), ["source", "n_chars"], F.col("lang") == "en").drop("lang")


@query("SELECT CASE WHEN l_suppkey <= 5 THEN 1 ELSE l_suppkey END AS cluster, count(DISTINCT l_orderkey) AS photo_count FROM lineitem GROUP BY 1")
def merged_clusters(spark, sf_dir):
    """Cluster sizes after some clusters were merged into one."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), "l_orderkey")
    mapping = load(spark, sf_dir, "supplier").where("s_suppkey <= 5").select(F.col("s_suppkey").alias("old"), F.lit(1).cast("long").alias("new"))
    return merge.rekey(lines, mapping, "cluster").groupBy("cluster").agg(F.countDistinct("l_orderkey").alias("photo_count"))


@query("""
    SELECT user_id, CASE WHEN f = 0 THEN 'success' WHEN d = 0 THEN 'error' ELSE 'partial' END AS status FROM (
        SELECT user_id, count(*) FILTER (event_type <> 'error') AS d, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id)""")
def run_status(spark, sf_dir):
    counts = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("d"), F.count_if(F.col("event_type") == "error").alias("f"))
    return counts.select("user_id", merge.run_status("d", "f").alias("status"))


@query("""
    WITH c AS (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0), s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 4 <> 0)
    SELECT coalesce(c.doc_id, s.doc_id) AS doc_id, CASE WHEN c.doc_id IS NULL THEN 'insert' WHEN s.doc_id IS NULL THEN 'delete' ELSE 'update' END AS action
    FROM c FULL JOIN s ON c.doc_id = s.doc_id WHERE c.doc_id IS NULL OR s.doc_id IS NULL OR c.lang IS DISTINCT FROM s.lang""")
def reconcile_diff(spark, sf_dir):
    """What a cache has to insert, update and delete to equal the server."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    server = docs.where("doc_id % 4 != 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")))
    return merge.reconcile(docs.where("doc_id % 3 != 0"), server, "doc_id", ["lang"])


@query("""
    WITH l AS (SELECT doc_id, substr(sha256(text), 1, 12) AS h FROM documents WHERE doc_id % 2 = 0), s AS (SELECT min(doc_id) AS sid, substr(sha256(text), 1, 12) AS h FROM documents WHERE doc_id % 2 = 1 GROUP BY 2)
    SELECT l.doc_id, s.sid AS server_id FROM l LEFT JOIN s ON l.h = s.h""")
def local_server_merge(spark, sf_dir):
    """Local rows with the server's row of the same content."""
    rows = load(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("h"))
    server = rows.where("doc_id % 2 = 1").groupBy("h").agg(F.min("doc_id").alias("server_id"))
    return rows.where("doc_id % 2 = 0").join(server, "h", "left").select("doc_id", "server_id")


@query("""
    SELECT user_id, count(*) FILTER (event_type = 'error') AS failures,
           CASE WHEN bool_or(event_type <> 'error') THEN 'done' WHEN count(*) FILTER (event_type = 'error') >= 3 THEN 'dead' ELSE 'pending' END AS state FROM events GROUP BY user_id""")
def retry_state(spark, sf_dir):
    return tail.retry_state(load(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unprocessed(spark, sf_dir):
    return tail.unprocessed(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), "doc_id")


@query("""
    SELECT o_orderkey, o_custkey, (o_totalprice > 0) AS ok FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) = 1""")
def upsert_latest(spark, sf_dir):
    """Later rows replace earlier ones of their key."""
    orders = load(spark, sf_dir, "orders")
    return relational.first_of(orders, ["o_custkey", "o_orderstatus"], [F.col("o_orderdate").desc(), "o_orderkey"]).select("o_orderkey", "o_custkey", (F.col("o_totalprice") > 0).alias("ok"))


@query("""
    WITH m AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 1000000 + c_custkey % 7 END AS stored FROM customer)
    SELECT c_custkey, coalesce((SELECT arg_min(stored, s.c_custkey) FROM m s WHERE s.c_nationkey = m.c_nationkey AND s.stored IS NOT NULL), (SELECT min(s.c_custkey) FROM m s WHERE s.c_nationkey = m.c_nationkey)) AS cluster FROM m""")
def stored_clusters(spark, sf_dir):
    """Components (here nations) under the stored cluster of their first member that has one."""
    stored = F.when(F.col("c_custkey") % 5 == 0, 1_000_000 + F.col("c_custkey") % 7)
    members = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", stored.alias("stored"))
    return merge.stored_groups(members, "c_nationkey", "c_custkey", "stored").select("c_custkey", F.col("group").alias("cluster"))


@query("""
    SELECT cluster, CASE WHEN cluster = 'n1' THEN 'Someone' WHEN cluster = 'n1b' THEN NULL ELSE cluster END AS name, count(*) AS members FROM (
        SELECT CASE WHEN c_nationkey = 1 AND c_acctbal < 0 THEN 'n1b' ELSE 'n' || c_nationkey END AS cluster FROM customer) GROUP BY 1""")
def split_clusters(spark, sf_dir):
    """A cluster split in two, and one of them named."""
    members = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("cluster"), "c_acctbal")
    split = merge.split_group(members, members.where("cluster = 'n1' and c_acctbal < 0"), "c_custkey", "cluster", F.lit("n1b"))
    sizes = split.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    name = F.when(F.col("cluster") == "n1", "Someone").when(F.col("cluster") != "n1b", F.col("cluster"))
    return sizes.select("cluster", name.alias("name"), "members")


@query("""
    WITH d AS (SELECT doc_id, substr(sha256(text), 1, 12) AS h, source, n_chars, lang FROM documents), l AS (SELECT * FROM d WHERE doc_id % 2 = 0), s AS (SELECT * FROM d WHERE doc_id % 2 = 1),
    l1 AS (SELECT h, min(doc_id) AS doc_id FROM l GROUP BY h), s1 AS (SELECT h, min(doc_id) AS sid FROM s GROUP BY h), m1 AS (SELECT doc_id, sid FROM l1 JOIN s1 USING (h)),
    l2 AS (SELECT source, n_chars, min(doc_id) AS doc_id FROM l WHERE doc_id NOT IN (SELECT doc_id FROM m1) GROUP BY 1, 2), s2 AS (SELECT source, n_chars, min(doc_id) AS sid FROM s WHERE doc_id NOT IN (SELECT sid FROM m1) GROUP BY 1, 2),
    m AS (SELECT * FROM m1 UNION ALL SELECT doc_id, sid FROM l2 JOIN s2 USING (source, n_chars))
    SELECT l.doc_id, m.sid AS server_id, coalesce(s.lang, l.lang) AS lang FROM l LEFT JOIN m USING (doc_id) LEFT JOIN s ON s.doc_id = m.sid""")
def duplicate_merge(spark, sf_dir):
    """Local rows with the server's language: of the row with the same content, else with the same source and length."""
    rows = load(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("h"), "source", "n_chars", "lang")
    found = merge.match_local(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "doc_id", [["h"], ["source", "n_chars"]], ["lang"])
    return found.select("doc_id", "server_id", "lang")


@query("""
    SELECT 'nation' AS name, CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS row FROM nation
    UNION ALL SELECT 'labels', CAST(to_json({'doc_id': doc_id, 'quality': quality, 'toxic': toxic}) AS VARCHAR) FROM labels""")
def state_document(spark, sf_dir):
    """The whole of some tables as lines of one JSON document."""
    return merge.state_document({t: load(spark, sf_dir, t) for t in ("nation", "labels")})
