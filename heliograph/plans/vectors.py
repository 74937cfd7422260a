"""Similar pairs, clusters and centroids of embeddings; boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import vector
from heliograph.operators import boxes, clustering
from heliograph.plans.family import family
from heliograph.shared import cut
from heliograph.sources.tables import load

QUERIES, ORACLES, query = family()

#: Similarity from which two faces are one person's.
FACE = 0.42


@query(f"""
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {FACE}""")
def embedding_pairs(spark, sf_dir):
    """All pairs at or above the threshold."""
    return clustering.similar_pairs(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", FACE).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""
    WITH RECURSIVE e AS (
        SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {FACE}
    ), r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id)
    SELECT id, min(c) AS cluster FROM r GROUP BY id""")
def embedding_clusters(spark, sf_dir):
    """Single-linkage clusters."""
    return clustering.clusters(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", FACE)


@query("""
    WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings
    ), m AS (SELECT label, position, avg(CAST(x AS DOUBLE)) AS m FROM p GROUP BY ALL
    ), l AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
    SELECT m.label, CAST(position AS INT) AS position, round(m / n, 6) AS value FROM m JOIN l ON m.label = l.label""")
def cluster_centroids(spark, sf_dir):
    return clustering.centroids(load(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "position", F.round("value", 6).alias("value"))


@query("""
    WITH p AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS class FROM embeddings
    ), s AS (SELECT vec_id, class, exp(CAST(x AS DOUBLE)) / sum(exp(CAST(x AS DOUBLE))) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, class) AS rank FROM p)
    SELECT vec_id, rank, CAST(class AS INT) AS class, round(p, 6) AS p FROM s WHERE rank <= 5""")
def top_classes(spark, sf_dir):
    """The five likeliest classes of each vector, taken as logits."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    ranked = F.slice(F.array_sort(F.transform(vector.softmax(logits), lambda p, i: F.struct((-p).alias("n"), i.alias("class")))), 1, 5)
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(ranked).alias("i", "c"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("rank"), F.col("c.class").alias("class"), F.round(-F.col("c.n"), 6).alias("p"))


@query("""
    WITH p AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS class FROM embeddings
    ), s AS (SELECT vec_id, class, exp(CAST(x AS DOUBLE)) / sum(exp(CAST(x AS DOUBLE))) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, class) AS rank FROM p)
    SELECT vec_id, CAST(class % 6 AS INT) AS category, CAST(class AS INT) AS class, round(p, 6) AS p FROM s WHERE rank <= 5 QUALIFY row_number() OVER (PARTITION BY vec_id, class % 6 ORDER BY rank) = 1""")
def top_categories(spark, sf_dir):
    """Of the five likeliest classes of each vector, the first of every category."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    ranked = F.slice(F.array_sort(F.transform(vector.softmax(logits), lambda p, i: F.struct((-p).alias("n"), i.alias("class")))), 1, 5)
    first = lambda r: F.filter(r, lambda c, i: ~F.exists(F.slice(r, F.lit(1), i), lambda b: b["class"] % 6 == c["class"] % 6))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", ranked.alias("r")).select("vec_id", F.explode(first(F.col("r"))).alias("c"))
    return rows.select("vec_id", (F.col("c.class") % 6).alias("category"), F.col("c.class").alias("class"), F.round(-F.col("c.n"), 6).alias("p"))


@query("""
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity FROM embeddings""")
def similarity_to_centroid(spark, sf_dir):
    """The similarity of every vector to one stated vector."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    one = vectors.where("vec_id = 0").agg(F.min_by("embedding", "vec_id").alias("one"))  # one row
    return vectors.join(one).select("vec_id", F.round(vector.cosine("embedding", "one"), 6).alias("similarity"))


@query(f"""
    WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS position FROM embeddings
    ), m AS (SELECT label, position, avg(CAST(x AS DOUBLE)) AS m FROM p GROUP BY ALL
    ), c AS (SELECT label, list(m ORDER BY position) AS centroid FROM m GROUP BY label)
    SELECT vec_id, e.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) >= {FACE} AS assigned FROM embeddings e JOIN c ON e.label = c.label""")
def centroid_assignment(spark, sf_dir):
    """Whether each vector is as close to the centroid of its label as one person's faces are."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return clustering.assign(vectors, clustering.centroids(vectors, "label", "embedding"), "label", "embedding", FACE).select("vec_id", "label", "assigned")


@query("""
    SELECT o_orderkey, (CASE WHEN b >> 31 = 1 THEN -1 ELSE 1 END) * pow(2, ((b >> 23) & 255) - 127) * (1 + (b & 8388607) / 8388608.0) AS value
    FROM (SELECT o_orderkey, ((o_orderkey * 40503) & 2281701375) | 939524096 AS b FROM orders)""")
def decoded_floats(spark, sf_dir):
    """Floats read from their four bytes, whose bits are made from the key."""
    bits = (F.col("o_orderkey") * 40503).bitwiseAND(0x87FFFFFF).bitwiseOR(0x38000000)
    h = F.lpad(F.hex(bits), 8, "0")
    data = F.unhex(F.concat(*[F.substr(h, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1)]))
    return load(spark, sf_dir, "orders").select("o_orderkey", vector.decode_floats(data)[0].cast("double").alias("value"))


_BOXES_SQL = """SELECT l_suppkey AS image, l_orderkey * 10 + l_linenumber AS id, (l_partkey * 13 % 1009) / 4::DOUBLE AS x, (l_orderkey * 7 % 499) / 4::DOUBLE AS y,
        l_quantity * 2 AS w, (l_partkey % 41 + 10)::DOUBLE AS h, l_extendedprice % 997 AS score FROM lineitem"""


@query(f"""
    WITH RECURSIVE boxes AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, id, x, y, w, h) AS rank FROM ({_BOXES_SQL})
    ), walk AS (
        SELECT DISTINCT image, 0::BIGINT AS rank, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS kept FROM boxes
        UNION ALL
        SELECT b.image, b.rank, CASE WHEN len(list_filter(kept, lambda k: greatest(least(b.x + b.w, k.x + k.w) - greatest(b.x, k.x), 0) * greatest(least(b.y + b.h, k.y + k.h) - greatest(b.y, k.y), 0)
            > 0.4 * (b.w * b.h + k.w * k.h - greatest(least(b.x + b.w, k.x + k.w) - greatest(b.x, k.x), 0) * greatest(least(b.y + b.h, k.y + k.h) - greatest(b.y, k.y), 0)))) > 0
            THEN kept ELSE list_append(kept, {{'id': b.id, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) END
        FROM walk w JOIN boxes b ON b.image = w.image AND b.rank = w.rank + 1
    ), ends AS (SELECT image, unnest(kept) AS k FROM walk QUALIFY rank = max(rank) OVER (PARTITION BY image))
    SELECT image, k.id AS id FROM ends""")
def box_nms(spark, sf_dir):
    """Of the boxes made from line items, a picture for each supplier, those that no better one covers."""
    made = {
        "image": F.col("l_suppkey"), "id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "x": (F.col("l_partkey") * 13 % 1009) / 4, "y": (F.col("l_orderkey") * 7 % 499) / 4,
        "w": F.col("l_quantity") * 2, "h": (F.col("l_partkey") % 41 + 10).cast("double"), "score": F.col("l_extendedprice") % 997,
    }
    return boxes.suppress(load(spark, sf_dir, "lineitem").select(*[c.alias(n) for n, c in made.items()]), "image").select("image", "id")


_LINKS_SQL = f"""SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s
        FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {FACE}"""


@query(f"""
    WITH RECURSIVE l AS ({_LINKS_SQL}), e AS (SELECT a AS u, b AS v FROM l WHERE la = lb UNION ALL SELECT b, a FROM l WHERE la = lb
    ), r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id)
    SELECT id, min(c) AS cluster FROM r GROUP BY id""")
def species_clusters(spark, sf_dir):
    """Single-linkage clusters within each label."""
    return clustering.clusters(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", FACE, within="label")


@query(f"""
    WITH RECURSIVE l AS ({_LINKS_SQL}
    ), e AS (SELECT row_number() OVER (ORDER BY s DESC, a, b) AS step, a, b FROM l
    ), u AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e
    ), r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT u.v, r.c FROM r JOIN u ON u.u = r.id
    ), first AS (SELECT id, min(c) AS cluster FROM r GROUP BY id
    ), pins AS (SELECT id, CASE WHEN id % 4 < 2 THEN cluster * 2 + id % 2 END AS pin FROM first
    ), rows AS (SELECT id, pin, coalesce(min(id) OVER (PARTITION BY pin), id) AS part FROM pins WHERE pin IS NOT NULL UNION ALL SELECT id, NULL, id FROM pins WHERE pin IS NULL
    ), walk AS (
        SELECT 0::BIGINT AS step, list({{'id': id, 'part': part, 'pin': pin}} ORDER BY id) AS now FROM rows
        UNION ALL
        SELECT step, CASE WHEN x.part = y.part OR x.pin IS NOT NULL AND y.pin IS NOT NULL THEN now
            ELSE list_transform(now, lambda n: CASE WHEN n.part = x.part OR n.part = y.part THEN {{'id': n.id, 'part': least(x.part, y.part), 'pin': coalesce(x.pin, y.pin)}} ELSE n END) END AS now
        FROM (SELECT e.step, now, list_filter(now, lambda n: n.id = e.a)[1] AS x, list_filter(now, lambda n: n.id = e.b)[1] AS y FROM walk JOIN e ON e.step = walk.step + 1)
    ), ends AS (SELECT unnest(now) AS n FROM (SELECT now FROM walk ORDER BY step DESC LIMIT 1))
    SELECT n.id AS id, min(n.id) OVER (PARTITION BY n.part) AS cluster, n.pin AS pin FROM ends""")
def split_kept_clusters(spark, sf_dir):
    """A second pass over clusters of which some members were split by hand: the split stays, the others follow their links."""
    vectors = load(spark, sf_dir, "embeddings")
    links = clustering.heaviest_links(vectors, "vec_id", "embedding", FACE)
    first = clustering.clusters_of(vectors, "vec_id", "embedding", links)
    pins = cut(first.where("id % 4 < 2").select("id", (F.col("cluster") * 2 + F.col("id") % 2).alias("pin")), "pins")
    return clustering.constrained_clusters(vectors, "vec_id", "embedding", FACE, pins, links=links)
