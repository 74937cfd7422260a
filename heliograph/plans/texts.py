"""Search, text cleaning, times, shapes and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import geo, media, text, time, vector
from heliograph.operators import geocode, packing, relational
from heliograph.plans.family import family
from heliograph.sources import files as sources
from heliograph.sources.tables import load

QUERIES, ORACLES, query = family()


@query("""
    SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE contains(lower(concat_ws(' ', text, lang, source, CAST(quality AS VARCHAR))), 'the')
      AND (contains(lower(concat_ws(' ', text, lang, source, CAST(quality AS VARCHAR))), 'thing') OR contains(lower(concat_ws(' ', text, lang, source, CAST(quality AS VARCHAR))), 'th'))
      AND contains(lower(concat_ws(' ', text, lang, source, CAST(quality AS VARCHAR))), 'src1')""")
def token_search(spark, sf_dir):
    """Documents whose joined fields hold every token or a stem of it."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = load(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return rows.where(text.matches_all(F.concat_ws(" ", "text", "lang", "source", F.col("quality").cast("string")), "the thing src1")).select("doc_id")


@query("""
    SELECT doc_id FROM documents WHERE contains(lower(text), 'ononthing') OR contains(lower(text), 'ononth')
       OR len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 3 AND starts_with('ononthing', w))) > 0
       OR len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: starts_with(w, 'o') AND levenshtein(w, 'ononthing') <= 1)) > 0""")
def fuzzy_search(spark, sf_dir):
    """Documents with a word like the token: inside, by stem, by prefix or one edit away."""
    return load(spark, sf_dir, "documents").where(text.fuzzy_matches("text", "ononthing")).select("doc_id")


@query("""
    SELECT doc_id, length(trim(regexp_replace(chr(8206) || ' ' || text || chr(7) || chr(8203), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x84\\x86-\\x9F\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{FEFF}\\x{FFF9}-\\x{FFFC}\\x{FFFE}]', '', 'g'), E' \\t\\n\\r')) AS n,
           left(regexp_replace(trim(text, E' \\t\\n\\r'), '\\s+', ' ', 'g'), 20) AS shown FROM documents""")
def text_sanitize(spark, sf_dir):
    """Lengths without unsafe characters, and display names."""
    dressed = F.concat(F.lit("‎ "), F.col("text"), F.lit("\u0007​"))
    return load(spark, sf_dir, "documents").select("doc_id", F.length(text.sanitize(dressed)).cast("long").alias("n"), text.display_name("text", 20).alias("shown"))


@query("""
    WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'IMG_' || (p_partkey // 3) || '-Edited.jpg' ELSE 'img_' || (p_partkey // 2) || '.JPG' END AS name FROM part)
    SELECT p_partkey, name FROM f WHERE lower(name) NOT IN (SELECT lower(regexp_replace(name, '-edited(\\.[^.]*)$', '\\1', 'i')) FROM f WHERE regexp_matches(name, '-edited\\.[^.]*$', 'i'))""")
def edited_variant_dedup(spark, sf_dir):
    """Files without the originals whose edited twin is there."""
    files = load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("IMG_"), F.floor(F.col("p_partkey") / 3).cast("string"), F.lit("-Edited.jpg"))).otherwise(F.concat(F.lit("img_"), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit(".JPG"))).alias("name"))
    edited = files.select(F.lower(text.original_of_edited("name")).alias("low"))
    return relational.without(files.withColumn("low", F.lower("name")), "low", edited).select("p_partkey", "name")


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def timestamp_normalize(spark, sf_dir):
    """Nine spellings of the same moments, read back as one."""
    ts = F.date_trunc("second", "ts")
    spell = F.pmod("event_id", F.lit(9))
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss 'UTC'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"]
    written = F.coalesce(*[F.when(spell == i, F.date_format(ts, f)) for i, f in enumerate(forms)], F.when(spell == 7, F.unix_millis(ts)).otherwise(F.unix_timestamp(ts)).cast("string"))
    return load(spark, sf_dir, "events").select("event_id", time.normalise_timestamp(written).alias("at"))


@query("""
    WITH t AS (SELECT event_id, floor(date_diff('millisecond', ts, max(ts) OVER ()) / 60000.0) AS m, CAST(floor(abs(value) * 1000) AS BIGINT) AS s, abs(value) AS v FROM events)
    SELECT event_id,
           CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || 'm ago' WHEN m < 1440 THEN CAST(floor(m / 60) AS BIGINT) || 'h ago' ELSE CAST(floor(m / 1440) AS BIGINT) || 'd ago' END AS ago,
           CASE WHEN s IS NULL THEN NULL ELSE concat_ws(' ', CASE WHEN s >= 86400 THEN (s // 86400) || 'd' END, CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || 'h' END,
                     CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60) || 'm' END, (s % 60) || 's') END AS uptime,
           lpad(CAST(CAST(ceil(v) AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(ceil(v) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(ceil(v) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS eta
    FROM t""")
def time_labels(spark, sf_dir):
    """How long ago each event was, and its value as an uptime and as a time that is left."""
    events = load(spark, sf_dir, "events").select("event_id", "ts", F.abs("value").alias("v"))
    now = events.agg(F.max("ts").alias("now"))  # one row
    seconds = F.floor(F.col("v") * 1000).cast("long")
    return events.join(now).select("event_id", time.ago_label("ts", "now").alias("ago"), F.when(seconds.isNotNull(), time.uptime_label(seconds)).alias("uptime"), time.eta_label("v").alias("eta"))


@query("""
    SELECT o_orderkey, lower(dayname(o_orderdate)) || ' ' || lower(monthname(o_orderdate)) AS words, CAST(dayofweek(o_orderdate) AS INT) AS weekday FROM orders""")
def search_dates(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", time.search_words("o_orderdate").alias("words"), (F.dayofweek("o_orderdate") - 1).alias("weekday"))


@query("""
    SELECT p_partkey, CASE WHEN greatest(w, h) >= 2048 AND w / h >= 2 AND w / h BETWEEN 1.97 AND 2.03 AND w >= 4000 THEN 'equirectangular'
                           WHEN greatest(w, h) >= 2048 AND (w / h >= 2 OR h / w >= 2.5) THEN 'panorama' END AS subtype
    FROM (SELECT p_partkey, CAST(p_size * 100 AS DOUBLE) AS w, CAST((p_partkey % 40 + 1) * 50 AS DOUBLE) AS h FROM part)""")
def aspect_subtype(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", media.aspect_subtype(F.col("p_size") * 100, (F.col("p_partkey") % 40 + 1) * 50).alias("subtype"))


@query("""
    SELECT p_partkey, CASE e WHEN 'jpg' THEN 'image/jpeg' WHEN 'heic' THEN 'image/jpeg' WHEN 'mov' THEN 'video/mp4' WHEN 'opus' THEN 'audio/mpeg' ELSE 'application/octet-stream' END AS mime
    FROM (SELECT p_partkey, ['jpg', 'heic', 'mov', 'opus', 'xyz'][CAST(p_partkey % 5 AS INT) + 1] AS e FROM part)""")
def mime_types(spark, sf_dir):
    name = F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ["JPG", "heic", "MOV", "opus", "xyz"])), (F.col("p_partkey") % 5 + 1).cast("int")))
    return load(spark, sf_dir, "part").select("p_partkey", media.mime_type(name).alias("mime"))


@query("""
    SELECT c_custkey, round(2 * 6371 * asin(sqrt(pow(sin(radians(52.52 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(52.52)) * pow(sin(radians(13.405 - lon) / 2), 2))), 3) AS km
    FROM (SELECT c_custkey, CAST(c_custkey % 170 AS DOUBLE) - 85 AS lat, CAST(c_custkey % 350 AS DOUBLE) - 175 AS lon FROM customer)""")
def haversine(spark, sf_dir):
    """Kilometres from made-up points to a city."""
    lat, lon = (F.col("c_custkey") % 170).cast("double") - 85, (F.col("c_custkey") % 350).cast("double") - 175
    return load(spark, sf_dir, "customer").select("c_custkey", F.round(geo.haversine_km(lat, lon, F.lit(52.52), F.lit(13.405)), 3).alias("km"))


#: Kinds of place, by turns.
PLACE_KINDS = ["PPLC", "PPLA", "PPL", "PPLX", "OTHER"]


def _located(key: str) -> dict:
    """Coordinates from a key: a quarter each near the pole, on the date line, in one city, and anywhere."""
    k = F.col(key)
    turn = k % 4
    lat = F.when(turn == 0, 89.9 + (k % 9) / 100).when(turn == 1, (k % 13) / 50 - 16).when(turn == 2, 48.8 + (k % 17) / 250).otherwise((k * 7919 % 1600) / 10 - 80)
    lon = F.when(turn == 0, (k * 47 % 360) - 180.0).when(turn == 1, F.when(k % 8 == 1, 179.95).otherwise(-179.95)).when(turn == 2, 2.3 + (k % 23) / 250).otherwise((k * 10473 % 3600) / 10 - 180)
    return {"lat": lat, "lon": lon}


_LOCATED_SQL = """CASE k % 4 WHEN 0 THEN 89.9::DOUBLE + (k % 9) / 100::DOUBLE WHEN 1 THEN (k % 13) / 50::DOUBLE - 16 WHEN 2 THEN 48.8::DOUBLE + (k % 17) / 250::DOUBLE ELSE (k * 7919 % 1600) / 10::DOUBLE - 80 END AS lat,
        CASE k % 4 WHEN 0 THEN (k * 47 % 360)::DOUBLE - 180 WHEN 1 THEN CASE WHEN k % 8 = 1 THEN 179.95::DOUBLE ELSE -179.95::DOUBLE END WHEN 2 THEN 2.3::DOUBLE + (k % 23) / 250::DOUBLE ELSE (k * 10473 % 3600) / 10::DOUBLE - 180 END AS lon"""


@query(f"""
    WITH places AS (
        SELECT s_name AS name, (k * 31 % 1000) * 1000 + 1 AS people, [10.0, 6.0, 1.0, 0.05, 0.5][k % 5 + 1]::DOUBLE AS kind, {_LOCATED_SQL} FROM (SELECT s_name, s_suppkey AS k FROM supplier)
    ), points AS (SELECT k AS c_custkey, {_LOCATED_SQL} FROM (SELECT c_custkey AS k FROM customer)
    ), pairs AS (
        SELECT c_custkey, name, kind * people AS weight, pow(sin((radians(l.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(l.lat)) * pow(sin((radians(l.lon) - radians(p.lon)) / 2), 2) AS h FROM points p, places l
    ), far AS (SELECT c_custkey, name, weight, 2 * 6371.0::DOUBLE * asin(sqrt(least(h, 1))) AS km FROM pairs
    ), near AS (SELECT *, min(km) OVER (PARTITION BY c_custkey) AS d FROM far
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(weight / (1 + km), 6) DESC, round(km, 6), name) AS rank
        FROM near WHERE d <= 315 AND km <= least(greatest(d * 2.5, d + 5), d + 12)
    )
    SELECT p.c_custkey, name AS place, round(km, 3) AS km FROM points p LEFT JOIN ranked r ON p.c_custkey = r.c_custkey AND rank = 1""")
def geo_nearest_place(spark, sf_dir):
    """The best of the suppliers' places for each customer's point, poles and date line included."""
    kind = F.array(*map(F.lit, PLACE_KINDS))[(F.col("s_suppkey") % 5).cast("int")]
    places = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), kind.alias("feature_code"), (F.col("s_suppkey") * 31 % 1000 * 1000).alias("population"), F.lit("XX").alias("country_code"), *[c.alias(n) for n, c in _located("s_suppkey").items()])
    points = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *[c.alias(n) for n, c in _located("c_custkey").items()])
    return geocode.nearest_place(points, places).select(F.col("id").alias("c_custkey"), "place", F.round("km", 3).alias("km"))


@query("""
    WITH b AS (SELECT p_partkey, CAST(p_partkey % 7 AS DOUBLE) AS x, CAST(p_partkey % 5 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS w, CAST(p_size % 9 + 1 AS DOUBLE) AS h FROM part
    ), o AS (SELECT *, greatest(least(x + w, 13.0) - greatest(x, 3.0), 0) * greatest(least(y + h, 8.0) - greatest(y, 2.0), 0) AS shared FROM b)
    SELECT p_partkey, round(shared / (w * h + 60 - shared), 6) AS iou FROM o""")
def bbox_iou(spark, sf_dir):
    """How much a box of each part overlaps one stated box."""
    boxes = load(spark, sf_dir, "part").select("p_partkey", *[c.cast("double").alias(k) for k, c in zip("abcd", (F.col("p_partkey") % 7, F.col("p_partkey") % 5, F.col("p_size"), F.col("p_size") % 9 + 1))])
    boxes = boxes.withColumns({k: F.lit(v) for k, v in zip("efgh", (3.0, 2.0, 10.0, 6.0))})
    return boxes.select("p_partkey", F.round(vector.iou(*"abcdefgh"), 6).alias("iou"))


@query("""
    WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'P_' || (doc_id // 3) || '-edited.JPG' WHEN doc_id % 7 = 0 THEN 'note_' || doc_id || '.txt' ELSE 'p_' || (doc_id // 2) || '.jpg' END AS name, n_chars AS size FROM documents
    ), kept AS (SELECT * FROM f WHERE lower(name) LIKE '%.jpg' AND lower(name) NOT IN (SELECT lower(replace(name, '-edited', '')) FROM f WHERE name LIKE '%-edited.JPG'))
    SELECT doc_id, name, size, CAST((SELECT sum(size) FROM kept) AS BIGINT) AS total_size, row_number() OVER (ORDER BY lower(name), doc_id) AS place FROM kept""")
def import_listing(spark, sf_dir):
    """Files to import, without originals whose edited twin is there, by name, with the size of all."""
    n = F.col("doc_id")
    name = F.when(n % 3 == 0, F.concat(F.lit("P_"), F.floor(n / 3).cast("string"), F.lit("-edited.JPG"))).when(n % 7 == 0, F.concat(F.lit("note_"), n.cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("p_"), F.floor(n / 2).cast("string"), F.lit(".jpg")))
    files = load(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.col("n_chars").alias("size"))
    return sources.import_listing(files, "doc_id")


@query("""
    WITH j AS (
        SELECT o_orderkey, o_orderdate, o_custkey, lower(concat_ws(' ', l_returnflag || l_linestatus, o_orderpriority, o_orderstatus, lower(dayname(o_orderdate)), lower(monthname(o_orderdate)))) AS searched FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    ), hit AS (SELECT DISTINCT o_orderkey, o_orderdate, o_custkey FROM j WHERE contains(searched, 'rf') AND contains(searched, 'urgent') AND contains(searched, 'march')
    ), g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS burst_count FROM hit
    ), top AS (SELECT * FROM g WHERE rn = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100)
    SELECT o_orderkey, burst_count, (SELECT string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey) AS tags FROM top""")
def library_search(spark, sf_dir):
    """The newest hundred matches over joined fields, row by row, collapsed and with their tags (the limit is the feature)."""
    tags = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus").alias("tag"))
    rows = load(spark, sf_dir, "orders").join(tags, "o_orderkey", "left").withColumn("words", time.search_words("o_orderdate"))
    found = relational.library_search(rows, ["tag", "o_orderpriority", "o_orderstatus", "words"], text.matches_all("searched", "rf urgent march"), "o_orderdate", "o_orderkey", "o_custkey")
    return found.select("o_orderkey", "burst_count", "tags")


@query("""
    WITH j AS (SELECT o_orderkey, o_orderdate, o_custkey, lower(string_agg(l_returnflag || l_linestatus, ' ')) AS searched FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
    ), g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS burst_count FROM j WHERE contains(searched, 'rf') AND contains(searched, 'no'))
    SELECT o_orderkey, burst_count FROM g WHERE rn = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def library_search_whole(spark, sf_dir):
    """As library_search, but the words may stand in different tags of an item (the limit is the feature)."""
    tags = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_returnflag", "l_linestatus").alias("tag"))
    rows = load(spark, sf_dir, "orders").join(tags, "o_orderkey", "left")
    found = relational.library_search(rows, ["tag"], text.matches_all("searched", "rf no"), "o_orderdate", "o_orderkey", "o_custkey", whole=True)
    return found.select("o_orderkey", "burst_count")


@query("""
    SELECT doc_id, CASE WHEN n < 1024 THEN printf('%d B', CAST(n AS BIGINT)) WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round(n / 1048576, 1))
                        WHEN n IS NOT NULL THEN printf('%.1f GB', round(n / 1073741824, 1)) END AS size
    FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n FROM documents)""")
def size_labels(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.bytes_label("n_chars").alias("size"))


@query("""
    WITH RECURSIVE o AS (SELECT doc_id, lang, source || '.txt' AS name, coalesce(n_chars, 0) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents
    ), r AS (
        SELECT lang, rn, CAST(0 AS BIGINT) AS part, n AS used FROM o WHERE rn = 1
        UNION ALL
        SELECT o.lang, o.rn, CASE WHEN used > 0 AND used + n + 100 > 50000 THEN part + 1 ELSE part END, CASE WHEN used > 0 AND used + n + 100 > 50000 THEN n ELSE used + n END
        FROM r JOIN o ON o.lang = r.lang AND o.rn = r.rn + 1
    ), c AS (SELECT doc_id, lang, part, name, row_number() OVER (PARTITION BY lang, part, name ORDER BY doc_id) AS n FROM o JOIN r USING (lang, rn))
    SELECT doc_id, lang, part, CASE WHEN n = 1 THEN name ELSE replace(name, '.txt', '_(' || n || ').txt') END AS entry FROM c""")
def archive_names(spark, sf_dir):
    """The part and the entry name of each document in an export of its language; names are free in their part."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.concat("source", F.lit(".txt")).alias("name"))
    return packing.archive_entries(docs, "lang", ["doc_id"], "n_chars", "name", 50_000.0).select("doc_id", "lang", "part", "entry")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    """A field of the events' JSON documents."""
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_SIDECARS_SQL = """SELECT CASE doc_id % 4 WHEN 0 THEN 'a/' || doc_id || '.jpg.supplemental-metadata.json' WHEN 1 THEN 'a/' || doc_id || '.json' WHEN 2 THEN 'a/' || doc_id || '.gone.json' ELSE 'b/' || doc_id || '.json' END AS path, doc_id FROM documents"""


def _library_files(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id")
    k, turn = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    path = F.when(turn == 0, F.concat(F.lit("a/"), k, F.lit(".jpg.supplemental-metadata.json"))).when(turn == 1, F.concat(F.lit("a/"), k, F.lit(".json"))).when(turn == 2, F.concat(F.lit("a/"), k, F.lit(".gone.json"))).otherwise(F.concat(F.lit("b/"), k, F.lit(".json")))
    return docs.select(F.concat(F.lit("a/"), k, F.lit(".jpg")).alias("path")), docs.select(path.alias("path"))


@query(f"""
    WITH s AS ({_SIDECARS_SQL})
    SELECT 'pair' AS found, 'a/' || doc_id || '.jpg' AS path, CASE WHEN doc_id % 4 < 2 THEN path END AS sidecar FROM s
    UNION ALL SELECT 'unpaired', path, NULL FROM s WHERE doc_id % 4 >= 2 UNION ALL SELECT 'unpaired by name', path, NULL FROM s WHERE doc_id % 4 >= 1""")
def sidecar_pairs(spark, sf_dir):
    """Files with their sidecars, and the sidecars without a file, by either rule."""
    files, sidecars = _library_files(spark, sf_dir)
    pairs = sources.pair_sidecars(files, sidecars)
    alone = lambda rule, by_name: sources.unpaired_sidecars(sidecars, pairs, by_name).select(F.lit(rule).alias("found"), "path", F.lit(None).cast("string").alias("sidecar"))
    return pairs.select(F.lit("pair").alias("found"), "path", "sidecar").unionAll(alone("unpaired", False)).unionAll(alone("unpaired by name", True))


@query("""
    WITH f AS (SELECT doc_id, doc_id || CASE WHEN doc_id % 6 IN (3, 4) THEN '-edited.jpg' ELSE '.jpg' END AS name FROM documents)
    SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN NULL ELSE doc_id END AS match FROM f""")
def matched_metadata(spark, sf_dir):
    """The sidecar of each file by name, title, stem, the original's name and the original's stem; every sixth has none."""
    k, turn = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    docs = load(spark, sf_dir, "documents").select("doc_id")
    files = docs.withColumn("name", F.concat(k, F.when(turn.isin(3, 4), "-edited.jpg").otherwise(".jpg")))
    key = F.when(turn.isin(0, 3), F.concat(k, F.lit(".jpg"))).when(turn.isin(2, 4), k).otherwise(F.concat(F.lit("other "), k))
    title = F.when(turn == 1, F.concat(k, F.lit(".jpg")))
    sidecars = docs.select(key.alias("key"), title.alias("title"), F.col("doc_id").alias("value"))
    return sources.match_metadata(files, sidecars, "doc_id", "value").select("doc_id", "match")
