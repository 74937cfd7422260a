"""Decorations, exclusions, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import relational
from heliograph.plans.family import family
from heliograph.sources.tables import load

QUERIES, ORACLES, query = family()

#: Lines that one task joins, about.
LINES = 400_000


@query("SELECT event_id, event_type, c_name AS user_name FROM events LEFT JOIN customer ON user_id = c_custkey")
def audit_names(spark, sf_dir):
    """Events with the user's name, if there is one."""
    names = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return load(spark, sf_dir, "events").join(names, "user_id", "left").select("event_id", "event_type", "user_name")


@query("""
    SELECT d.doc_id, coalesce(a.quality, b.quality, -1) AS shown FROM documents d
    LEFT JOIN labels a ON a.doc_id = d.doc_id AND a.toxic = 0 LEFT JOIN labels b ON b.doc_id = d.doc_id + 1""")
def gallery_items(spark, sf_dir):
    """What to show for an item: its own clean label, else its neighbour's, else nothing."""
    labels = load(spark, sf_dir, "labels")
    own = labels.where("toxic = 0").select("doc_id", F.col("quality").alias("own"))
    next_one = labels.select((F.col("doc_id") - 1).alias("doc_id"), F.col("quality").alias("next"))
    return load(spark, sf_dir, "documents").select("doc_id").join(own, "doc_id", "left").join(next_one, "doc_id", "left").select("doc_id", F.coalesce("own", "next", F.lit(-1)).alias("shown"))


@query("""
    SELECT DISTINCT o_orderkey, n_name, s_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def album_members(spark, sf_dir):
    """Orders with the suppliers of their lines and those suppliers' nations, once each."""
    supplier = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "n_name")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    parts = lines.count() // LINES + 1
    orders = load(spark, sf_dir, "orders").select("o_orderkey").repartition(parts, "o_orderkey")
    # Dealt once, by order: the join and the last step find their rows in place.
    return lines.join(supplier, "l_suppkey").select("o_orderkey", "n_name", "s_name").repartition(parts, "o_orderkey").join(orders, "o_orderkey", "left_semi").distinct()


@query("""
    SELECT DISTINCT l.doc_id AS label_id, e.vec_id FROM labels l JOIN embeddings e ON l.doc_id = e.vec_id OR l.doc_id = e.vec_id + 500""")
def disjunctive_join(spark, sf_dir):
    """Labels that meet a vector under either of its ids."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") + 500).alias("other_id"))
    return relational.join_either(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id")), vectors, "label_id", ["vec_id", "other_id"]).select("label_id", "vec_id").distinct()


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def delta_anti_join(spark, sf_dir):
    """Local rows that the other side has not."""
    return relational.without(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", load(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("""
    SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS in_group FROM orders""")
def group_counts(spark, sf_dir):
    """The size of each order's group beside it; sizes are counted apart, so a large group is not one task."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("in_group")), "o_custkey").select("o_orderkey", "in_group")


@query("""
    SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey""")
def argmax_pick(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query("""
    SELECT o_custkey, o_orderpriority AS usual FROM (
        SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) WHERE rn = 1""")
def mode_pick(spark, sf_dir):
    return relational.mode_of(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "usual")


@query("""
    SELECT e.event_id FROM events e LEFT JOIN (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS v FROM customer WHERE c_custkey % 2 = 0) s ON user_id = c_custkey
    WHERE coalesce(v = 'true', true)""")
def enabled_events(spark, sf_dir):
    """Events of users who opted in, or said nothing where the default is on."""
    settings = load(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user"), F.when(F.col("c_acctbal") > 0, "true").otherwise("false").alias("value"))
    return relational.with_default_setting(load(spark, sf_dir, "events"), settings, "user_id", True).select("event_id")


@query("""
    SELECT doc_id FROM documents WHERE doc_id NOT IN (
        SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND vec_id NOT IN (SELECT conv_id FROM conversations))""")
def nested_exclusion(spark, sf_dir):
    """Documents but those that a low label hides, unless a conversation still refers to them."""
    low = load(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    hidden = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")).join(low, "doc_id", "left_semi")
    hidden = relational.without(hidden, "doc_id", load(spark, sf_dir, "conversations").select("conv_id"))
    return relational.without(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", hidden)


@query("""
    SELECT DISTINCT CAST(id AS VARCHAR) AS id FROM (SELECT l_orderkey AS id FROM lineitem UNION SELECT l_partkey FROM lineitem UNION SELECT l_suppkey FROM lineitem)""")
def hidden_id_set(spark, sf_dir):
    """All ids in several columns, in one pass over the table."""
    return relational.ids_of(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


@query("""
    SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) IN (
        SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R' UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')""")
def polymorphic_membership(spark, sf_dir):
    """Orders whose id is any of the aliases of a returned line."""
    ids = relational.ids_of(load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), ["l_orderkey", "l_partkey"])
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"))
    return orders.join(ids, "id", "left_semi").select("o_orderkey")


@query("SELECT url AS path FROM pages WHERE url <> '' UNION SELECT source FROM documents WHERE source <> '' UNION SELECT role FROM conversations WHERE role <> ''")
def known_paths_union(spark, sf_dir):
    """Distinct non-empty paths of several tables."""
    paths = [load(spark, sf_dir, t).select(F.col(c).alias("path")) for t, c in (("pages", "url"), ("documents", "source"), ("conversations", "role"))]
    return paths[0].unionAll(paths[1]).unionAll(paths[2]).where("path != ''").distinct()


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_tags(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("""
    SELECT doc_id, 'server' AS origin FROM labels UNION ALL SELECT doc_id, 'local' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def merged_lists(spark, sf_dir):
    """Two result lists as one; the server's row wins."""
    server = load(spark, sf_dir, "labels").select("doc_id", F.lit("server").alias("origin"))
    local = load(spark, sf_dir, "documents").select("doc_id", F.lit("local").alias("origin"))
    return server.unionByName(local.join(server.select("doc_id"), "doc_id", "left_anti"))


@query("""
    SELECT DISTINCT o2.o_orderkey FROM orders o1 JOIN orders o2 ON o1.o_custkey = o2.o_custkey WHERE o1.o_totalprice > 400000""")
def expanded_selection(spark, sf_dir):
    """A selection grown to the whole groups of its members."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(orders.where("o_totalprice > 400000").select("o_custkey"), "o_custkey", "left_semi").select("o_orderkey")


@query("""
    SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS slug FROM part
    WHERE lower(replace(p_name, ' ', '-')) = 'red-widget' OR starts_with(p_name, 'small ') OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-04')""")
def slug_filter(spark, sf_dir):
    """Parts by slug, by prefix, or shipped between two days."""
    from heliograph.functions.text import slug

    shipped = load(spark, sf_dir, "lineitem").where(F.to_date("l_shipdate").between(F.lit("1998-03-01").cast("date"), F.lit("1998-03-04").cast("date"))).select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name").join(shipped, "p_partkey", "left")
    return parts.where((slug("p_name") == "red-widget") | F.col("p_name").startswith("small ") | F.col("hit")).select("p_partkey", slug("p_name").alias("slug"))


@query("""
    WITH a AS (SELECT url, min(page_id) AS p FROM pages WHERE page_id % 3 = 0 GROUP BY 1),
         b AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, min(page_id) AS p FROM pages WHERE page_id % 3 = 0 GROUP BY 1)
    SELECT pages.page_id, coalesce(a.p, b.p) AS match FROM pages LEFT JOIN a ON pages.url = a.url LEFT JOIN b ON regexp_extract(pages.url, '://([^/?#]*)', 1) = b.host""")
def metadata_cascade(spark, sf_dir):
    """Each page's source: the one of its whole address, else of its host."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return relational.match_cascade(pages, pages.where("page_id % 3 = 0"), "page_id", [(F.col("url"), F.col("url")), (host, host)], "page_id").select("page_id", "match")


@query("""
    SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING list_contains(list(event_type), 'error')""")
def users_with_kind(spark, sf_dir):
    """Users whose set of event kinds holds one, by a look into the array."""
    kinds = load(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.where(F.array_contains("kinds", "error")).select("user_id", F.size("kinds").cast("long").alias("kinds"))
